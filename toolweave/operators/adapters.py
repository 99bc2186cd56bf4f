"""Adapter specs: vendor keys to standard names, types by rules, fill-ins, defaults.

A spec is data: rows (fingerprint, kind, n, source, field, key, target) in a table, or a Python mapping for one vendor.
Column functions take one spec's rules as literals, which ride in the expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.frames import exists, without
from ..functions.maps import first_of, literal_map
from ..functions.text import canonical_key, present

def lookup(fields: Column, wanted: str) -> Column:
    """Value of the first entry whose key spells the wanted one, ignoring case and punctuation."""
    norm = "".join(c for c in wanted.lower() if c.isalnum())
    return F.get(F.filter(F.map_entries(fields), lambda e: (canonical_key(e["key"]) == norm) & e["value"].isNotNull()), 0)["value"]


def alias_inject(fields: Column, aliases: dict[str, str]) -> Column:
    """fields with each empty standard field filled from its vendor keys, the first key with a value counting."""
    found = F.filter(
        F.array(*[F.struct(F.lit(target).alias("key"), lookup(fields, source).alias("value")) for source, target in aliases.items()]),
        lambda e: e["value"].isNotNull(),
    )
    made = first_of(F.filter(found, lambda e: ~present(fields[e["key"]])))
    return F.map_concat(F.map_filter(fields, lambda k, v: ~F.map_contains_key(made, k)), made)


def dispatch_type(source_type: Column, fields: Column, current: Column, rules=(), mapping: dict | None = None) -> Column:
    """Record type by the rules (source type, field, value -> type), else by the source type, else the current one."""
    steps = [F.when(source_type == source, literal_map(values)[lookup(fields, field)]) for source, field, values in rules]
    direct = literal_map(mapping)[source_type] if mapping else F.lit(None).cast("string")
    return F.coalesce(*steps, direct, F.when(current != "", current), source_type)


def fallback_fill(fields: Column, record_type: Column, rules=tuple(vocab.DEFAULT_FALLBACKS)) -> Column:
    """fields with empty targets copied from their sources where the record type matches."""
    wanted = F.array(*[
        F.struct(F.lit(t).alias("key"), F.when((record_type == kind) & ~present(fields[t]) & present(fields[s]), fields[s]).alias("value")) for kind, t, s in rules
    ])
    made = first_of(F.filter(wanted, lambda e: e["value"].isNotNull()))
    return F.map_concat(F.map_filter(fields, lambda k, v: ~F.map_contains_key(made, k)), made)


def spec_rules(source_format: str) -> list[tuple]:
    """The built-in rules for json, event_csv, step_csv or xml: (kind, n, source, field, key, target)."""
    types = dict(vocab.DEFAULT_TYPE_MAPPING) | (vocab.STEP_CSV_TYPE_MAPPING if source_format == "step_csv" else {})
    aliases = {"json": vocab.JSON_ALIASES, "event_csv": vocab.EVENT_CSV_ALIASES, "step_csv": vocab.STEP_CSV_ALIASES, "xml": vocab.XML_ALIASES}[source_format]
    dispatch = {"event_csv": [vocab.EVENT_CSV_DISPATCH], "xml": [vocab.WAFER_EVENT_DISPATCH]}.get(source_format, [])
    rows = [("type", k, s, None, s, t) for k, (s, t) in enumerate(types.items())]
    rows += [("alias", k, None, None, s, t) for k, (s, t) in enumerate(aliases.items())]
    rows += [("dispatch", k, s, f, v, t) for s, f, m in dispatch for k, (v, t) in enumerate(m.items())]
    return rows + [("fallback", k, kind, None, s, t) for k, (kind, t, s) in enumerate(vocab.DEFAULT_FALLBACKS)]


def spec_sanitize(specs: DataFrame) -> DataFrame:
    """Rules with a known kind, a key, and an allowed target."""
    field, kind = F.col("target").isin(*vocab.CANONICAL_FIELDS), F.col("target").isin(*vocab.CANONICAL_TYPES)
    named = F.coalesce(F.col("key") != "", F.lit(False))
    return specs.where(named & (
        (F.col("kind") == "alias") & field | (F.col("kind") == "type") & kind
        | (F.col("kind") == "dispatch") & kind & (F.col("source") != "") & (F.col("field") != "")
        | (F.col("kind") == "fallback") & field & F.col("source").isin(*vocab.CANONICAL_TYPES)
    ))


def spec_defaults(specs: DataFrame, source_format: str) -> DataFrame:
    """specs (fingerprint, rule) with the built-in rules added where a spec has none for the same source, field and key."""
    names = ("kind", "n", "source", "field", "key", "target")
    rules = F.array(*[F.struct(*[F.lit(v).cast("int" if c == "n" else "string").alias(c) for c, v in zip(names, rule)]) for rule in spec_rules(source_format)])
    own = specs.select("fingerprint").distinct().select("fingerprint", F.inline(rules))
    same = ["fingerprint", "kind", "source", "field", "key"]
    met = own.alias("o").join(specs.alias("s"), [F.col(f"o.{c}").eqNullSafe(F.col(f"s.{c}")) for c in same], "left_anti")
    return specs.unionByName(met.select(*specs.columns))


SPEC = ["fingerprint", "kind", "n", "source", "field", "key", "target"]
SPEC_BUCKETS = 64


def spec_upsert(existing: DataFrame | None, incoming: DataFrame) -> DataFrame:
    """Stored rules (SPEC and version) after saving specs: one that comes in replaces all rules of its fingerprint and has
    the next version. Rules without a fingerprint go; repeated ones stay once."""
    new = incoming.where("fingerprint <> ''").select(*SPEC).distinct()
    if existing is None:
        return new.withColumn("version", F.lit(1))
    held = existing.groupBy("fingerprint").agg(F.max("version").alias("__v"))
    new = new.join(held, "fingerprint", "left").select(*SPEC, (F.coalesce("__v", F.lit(0)) + 1).alias("version"))
    return existing.select(*SPEC, "version").join(new.select("fingerprint").distinct(), "fingerprint", "left_anti").unionByName(new)


def save_specs(incoming: DataFrame, path: str) -> None:
    """spec_upsert() into the store at path, which lies in hash buckets of the fingerprint; only touched ones are replaced."""
    spark = incoming.sparkSession
    bucket = F.pmod(F.xxhash64("fingerprint"), F.lit(SPEC_BUCKETS)).cast("int")
    existing = None
    if exists(spark, path):
        touched = [r[0] for r in incoming.select(bucket).distinct().collect()]  # SPEC_BUCKETS at most
        existing = read_specs(spark, path).where(F.col("bucket").isin(touched))
    merged = spec_upsert(existing, incoming).withColumn("bucket", bucket)
    merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def read_specs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("fingerprint string, kind string, n int, source string, field string, key string, target string, version int, bucket int").parquet(path)


def adapter_specs_scan(documents: DataFrame, specs: DataFrame) -> DataFrame:
    """documents (fingerprint) with version and rules (an array in their order) of the stored spec of their fingerprint;
    without one both are null. A spec is one row, so documents don't multiply."""
    order = F.array_sort(F.collect_list(F.struct("kind", "n", "source", "field", "key", "target")))
    stored = specs.groupBy("fingerprint").agg(F.max("version").alias("version"), order.alias("rules"))
    return without(documents, "version", "rules").join(stored, "fingerprint", "left")


def sample_by_type(records: DataFrame, key: str, n: int = 3, bag: str | None = None, most_keys: int | None = None) -> DataFrame:
    """The n records of the smallest keys for each source type; every task keeps its own n first. most_keys bounds the
    entries of a sampled bag."""
    if bag and most_keys is not None:
        records = records.withColumn(bag, F.map_from_entries(F.slice(F.map_entries(bag), 1, most_keys)))
    best = Window.partitionBy("source_record_type").orderBy(key)
    return records.withColumn("sample_no", F.row_number().over(best)).where(F.col("sample_no") <= n)
