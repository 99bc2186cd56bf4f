"""Structure of nested documents: leaf paths, their types and samples, repeated parts, fingerprints and mapping hints.

Documents are walked on the JVM (nested.py); everything across documents is grouped by Spark. Whole documents and all items
of a list count by default; limits are parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab
from . import nested


def leaf_rows(docs: DataFrame, text_col: str = "text", items: int | None = None) -> DataFrame:
    """docs with a row (path, kind, value, n, keys) for each leaf and each list of objects (kind objects) of its JSON text.

    The documents are written once, parsed, with their depth: what makes them may be costlier than the walk.
    """
    made, levels = nested.written_docs(nested.read_json_docs(docs, text_col).drop("top_type", "top_keys"))
    return nested.leaf_rows(made, "doc", items, levels=levels)


def _cut() -> Column:
    return F.when(F.length("value") > 80, F.concat(F.left("value", F.lit(77)), F.lit("..."))).otherwise(F.col("value"))


def path_samples(rows: DataFrame, by: str) -> DataFrame:
    """(by, path, sample): every distinct value of a path, cut at 80 characters, as a row."""
    return rows.where("kind <> 'objects' and value is not null").select(by, "path", _cut().alias("sample")).distinct()


def path_profile(rows: DataFrame, by: str, samples: int = 5) -> DataFrame:
    """(by, path, type, n, samples): types of a path collapsed to one name, filled leaves, and the smallest distinct values.

    A group is a few numbers however many values a path has: each task sends on no more than the samples asked for. The rows
    are made once: counts and samples both go by the same count of every cut value.
    """
    counted = rows.where("kind <> 'objects'").select(by, "path", "kind", _cut().alias("sample")).groupBy(by, "path", "kind", "sample").agg(F.count(F.lit(1)).alias("c"))
    filled = F.col("kind") != "null"
    made = counted.groupBy(by, "path").agg(F.array_sort(F.collect_set(F.when(filled, F.col("kind")))).alias("kinds"), F.coalesce(F.sum(F.when(filled, F.col("c"))), F.lit(0)).alias("n"))
    kinds = F.col("kinds")
    name = F.when(F.size(kinds) == 0, "null").when(F.size(kinds) == 1, F.get(kinds, 0)).when((F.size(kinds) == 2) & F.array_contains(kinds, "int") & F.array_contains(kinds, "float"), "float").otherwise(
        F.concat(F.lit("mixed:"), F.array_join(kinds, ",")))
    # The filter asks the count too and the join is null-safe: nothing is pushed below the exchange, which both sides then share.
    given = counted.where((F.col("c") > 0) & F.when(F.col("c") > 0, F.col("sample")).isNotNull())
    few = given.withColumn("__k", F.dense_rank().over(Window.partitionBy(by, "path").orderBy("sample"))).where(F.col("__k") <= samples)
    listed = few.select(F.col(by).alias("__by"), F.col("path").alias("__path"), "sample").distinct().groupBy("__by", "__path").agg(F.array_sort(F.collect_list("sample")).alias("samples"))
    joined = made.join(listed, made[by].eqNullSafe(listed["__by"]) & made["path"].eqNullSafe(listed["__path"]), "left")
    return joined.select(by, "path", name.alias("type"), "n", F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))


def record_boundaries(rows: DataFrame, by: str) -> DataFrame:
    """(by, path, n, keys): lists of objects, how many items they have in all, and the items' keys."""
    lists = rows.where(F.col("kind") == "objects").where(F.col(by).isNotNull())
    # The items are counted with the first key; a key is one row for a path before the keys come together.
    named = lists.select(by, "path", "n", F.posexplode_outer("keys").alias("__p", "k"))
    keys = named.groupBy(by, "path", "k").agg(F.sum(F.when(F.coalesce("__p", F.lit(0)) == 0, F.col("n")).otherwise(0)).alias("n"))
    return keys.groupBy(by, "path").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list("k")).alias("keys"))


def structure_summary(rows: DataFrame, by: str, most: int | None = None) -> DataFrame:
    """(by, paths, repeated): sorted leaf paths and sorted lists of objects of a document; `most` limits the paths."""
    seen = rows.select(by, "path", (F.col("kind") == "objects").alias("many")).distinct()
    made = seen.groupBy(by).agg(
        F.array_sort(F.collect_list(F.when(~F.col("many"), F.col("path")))).alias("paths"), F.array_sort(F.collect_list(F.when(F.col("many"), F.col("path")))).alias("repeated")
    )
    return made if most is None else made.withColumn("paths", F.slice("paths", 1, most))


def schema_family(paths: Column) -> Column:
    """Family of a document by its top-level names."""
    top = F.transform(paths, lambda p: F.regexp_extract(p, r"^([^.\[]*)", 1))
    return F.when(F.array_contains(top, "ControlJob"), "control_job").when(F.exists(paths, lambda p: p.startswith("events[]")), "events").when(
        F.array_contains(top, "sensor_data"), "sensor_data").otherwise("generic")


def schema_fingerprint(paths: Column, repeated: Column) -> Column:
    """Sixteen hex digits that depend on the sorted paths alone."""
    return F.left(F.sha2(F.to_json(F.struct(paths.alias("paths"), repeated.alias("repeated"))), 256), F.lit(16))


def suggest_mappings(profile: DataFrame, by: str) -> DataFrame:
    """(by, field, paths, confidence): paths that end in or contain a spelling of a canonical field, ignoring case.

    The spellings are a fixed list that rides in the row: no join. One path gives 0.9, several give 0.7.
    """
    path = F.lower("path")
    hits = F.array_compact(F.array(*[
        F.when(F.greatest(*[F.contains(path, F.lit(a.lower())).cast("int") for a in [*aliases, aliases[0]]]) > 0, field) for field, aliases in vocab.MAPPING_ALIASES.items()
    ]))
    found = profile.select(by, "path", F.explode(hits).alias("field")).groupBy(by, "field").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    return found.withColumn("confidence", F.when(F.size("paths") == 1, 0.9).otherwise(0.7))


def prune_structure(spec: DataFrame, profile: DataFrame, by: str) -> DataFrame:
    """Spec rows (by, path) whose path has a filled scalar in the profile."""
    return spec.join(profile.where("n > 0").select(by, "path"), [by, "path"], "left_semi")


def uncovered_paths(rows: DataFrame, groups: DataFrame, by: str) -> DataFrame:
    """(by, path): innermost lists of objects that no record group (by, path) covers."""
    lists = rows.where("kind = 'objects'").select(by, "path").distinct()
    pieces = F.split("path", r"\[\]")
    parts = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda k: F.concat(F.array_join(F.slice(pieces, F.lit(1), k), "[]"), F.lit("[]")))
    # Every list beside those above it, in one go: it is listed itself, and inner ones may have named it. A null group is never named.
    each = lists.select(by, F.col("path").alias("p"), F.explode(parts).alias("path"))
    found = each.groupBy(by, "path").agg(F.bool_or(F.col("p") == F.col("path")).alias("listed"), F.bool_or((F.col("p") != F.col("path")) & F.col(by).isNotNull()).alias("named"))
    return found.where("listed and not named").select(by, "path").join(groups.select(by, "path"), [by, "path"], "left_anti")


def parse_observations(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with record_no and record (JSON text) of {"records": [...]} or a bare list; only objects count."""
    text = F.col(text_col)
    listed = F.when(F.ltrim(text).startswith("["), text).otherwise(F.get_json_object(text, "$.records"))
    items = F.transform(F.from_json(listed, "array<variant>"), lambda x: F.to_json(x))
    names = [c for c in docs.columns if c != text_col]
    made = docs.where(F.try_parse_json(text).isNotNull()).select(*names, F.posexplode(items).alias("__p", "record"))
    made = made.where(F.col("record").startswith("{"))
    order = Window.partitionBy(*names).orderBy("__p") if names else Window.orderBy("__p")
    return made.select(*names, F.row_number().over(order).alias("record_no"), "record")
