"""Standard vocabulary: alias resolution and measurements embedded in field names.

Both work inside the row on the record's own entries, so standardizing is one narrow
projection and one explode whatever the number of files, vendors or records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.fence import fence
from ..functions.maps import literal_array, literal_map, sql_text
from ..functions.text import canonical_key, present, to_number

SPLIT_NAME = r"[_\-\s/]+"


def _alias_targets() -> Column:
    """Literal map: canonical spelling -> array of (field position, alias rank)."""
    targets: dict[str, list[tuple[int, int]]] = {}
    for position, aliases in enumerate(vocab.FIELD_ALIASES.values()):
        for rank, alias in enumerate(aliases, start=1):
            key = "".join(ch for ch in alias.lower() if ch.isalnum())
            slots = targets.setdefault(key, [])
            if position not in [p for p, _ in slots]:
                slots.append((position, rank))
    rows = [
        f"{sql_text(key)}, array("
        + ", ".join(f"named_struct('field', {p}, 'rank', {r})" for p, r in slots) + ")"
        for key, slots in targets.items()]
    return F.expr("map(" + ", ".join(rows) + ")")


def _ordered_entries(fields: Column) -> Column:
    """The record's entries, last first, with their canonical spelling."""
    return F.transform(
        F.reverse(F.map_entries(fields)),
        lambda e: F.struct(canonical_key(e["key"]).alias("norm"), e["key"].alias("raw"),
                           e["value"].alias("value")))


def _field_hits(entries: Column, norms: Column) -> Column:
    """Raw keys for each standard field, best first: array of (field, rank, raw).

    ``entries`` and ``norms`` are columns made before: inside the lambdas an expression would be
    evaluated again for every entry, and cost would grow with the square of the record's width.
    """
    names = literal_array(vocab.FIELD_ALIASES)
    exact = F.transform(
        F.filter(entries, lambda e: F.array_contains(names, e["raw"]) & present(e["value"])),
        lambda e: F.struct((F.array_position(names, e["raw"]).cast("int") - 1).alias("field"),
                           F.lit(0).alias("rank"), e["raw"].alias("raw")))
    latest = F.filter(entries, lambda e, i: (F.array_position(norms, e["norm"]) == i + 1)
                      & present(e["value"]))
    by_alias = F.flatten(F.transform(
        latest,
        lambda e: F.coalesce(
            F.transform(_alias_targets()[e["norm"]],
                        lambda t: F.struct(t["field"].alias("field"), t["rank"].alias("rank"),
                                           e["raw"].alias("raw"))),
            F.array().cast("array<struct<field:int,rank:int,raw:string>>"))))
    return F.array_sort(F.concat(exact, by_alias))


def _first_per_field(hits: Column) -> Column:
    """Of sorted hits the first of each field: the one whose neighbour before has another field."""
    return F.filter(hits, lambda h, i: (i == 0) | (F.get(hits, i - 1)["field"] != h["field"]))


def expand_param_name(name: Column) -> Column:
    """Lower-case tokens with the short measurement words written out."""
    tokens = F.filter(F.split(F.lower(F.trim(name)), r"[_\-\s]+"), lambda t: t != "")
    words = literal_map(vocab.PARAMETER_TOKEN_WORDS)
    return F.array_join(F.transform(tokens, lambda t: F.coalesce(words[t], t)), "_")


def embedded_measurements(fields: Column, numeric_only: bool = False) -> Column:
    """Array of (parameter, value, unit, source_key) for keys that end in a unit."""
    suffixes = literal_map(vocab.UNIT_SUFFIXES)
    join = lambda parts, n: F.array_join(F.slice(parts, F.lit(1), F.greatest(n, F.lit(0))), "_")

    # Each step binds what the next one uses several times: inside a lambda nothing is shared, and the
    # splitting was done again for each use. Most names carry no unit and go before theirs is written out.
    def cut(e: Column) -> Column:
        return F.struct(F.filter(F.split(e["key"], SPLIT_NAME), lambda p: p != "").alias("parts"), e["value"].alias("value"), e["key"].alias("key"))

    def ends(e: Column) -> Column:
        last = F.lower(F.try_element_at(e["parts"], F.lit(-1)))
        return F.struct(e["parts"].alias("parts"), e["value"].alias("value"), e["key"].alias("key"), last.alias("last"),
                        F.when(F.size(e["parts"]) >= 3, F.concat(F.lower(F.try_element_at(e["parts"], F.lit(-2))), last)).alias("pair"))

    def units(e: Column) -> Column:
        return F.struct(e["parts"].alias("parts"), e["value"].alias("value"), e["key"].alias("key"), suffixes[e["pair"]].alias("two"), suffixes[e["last"]].alias("one"))

    def measured(e: Column) -> Column:
        n = F.size(e["parts"]) - F.when(e["two"].isNotNull(), 2).otherwise(1)
        return F.struct(expand_param_name(join(e["parts"], n)).alias("parameter"), e["value"].alias("value"),
                        F.coalesce(e["two"], e["one"]).alias("unit"), e["key"].alias("source_key"))

    def usable(e: Column) -> Column:
        ok = present(e["value"])
        return ok & to_number(e["value"]).isNotNull() if numeric_only else ok

    several = F.filter(F.transform(F.filter(F.map_entries(fields), usable), cut), lambda e: F.size(e["parts"]) >= 2)
    found = F.filter(F.transform(F.transform(several, ends), units), lambda e: e["two"].isNotNull() | e["one"].isNotNull())
    return F.filter(F.transform(found, measured), lambda m: m["parameter"] != "")


def standardize_fields(records: DataFrame) -> DataFrame:
    """Adds ``matched``: per standard field the raw key that feeds it."""
    listed = fence(records, {"__e": _ordered_entries(F.col("candidate_fields"))})
    named = fence(listed, {"__n": F.transform("__e", lambda e: e["norm"])})
    hits = fence(named, {"__h": _field_hits(F.col("__e"), F.col("__n"))}, drop=("__e", "__n"))
    return fence(hits, {"matched": _first_per_field(F.col("__h"))}, drop=("__h",))


def standardize(records: DataFrame, keep_base: bool = False,
                numeric_only: bool = False) -> DataFrame:
    """Canonical records to standardized records; may emit several rows per record.

    Every key that carries a unit suffix becomes its own sensor row with the other standard
    fields as context.  ``keep_base`` also emits the record itself; ``numeric_only`` takes
    only numeric values as measurements.
    """
    names = literal_array(vocab.FIELD_ALIASES)
    cand = F.col("candidate_fields")
    measured = standardize_fields(records).withColumn(
        "measurements", embedded_measurements(cand, numeric_only))
    if keep_base:
        none = F.array(F.lit(None).cast(
            "struct<parameter:string,value:string,unit:string,source_key:string>"))
        measured = measured.withColumn("measurements", F.concat(none, F.col("measurements")))
    carried = [F.col(c) for c in measured.columns if c != "measurements"]
    rows = measured.select(*carried, F.posexplode_outer("measurements").alias("measurement_no", "m"))

    m, matched = F.col("m"), F.col("matched")
    is_measurement = m.isNotNull()
    used = F.transform(matched, lambda h: h["raw"])
    # A raw key can feed two fields: the later assignment names it (alias hits after exact).
    by_lateness = F.array_sort(F.transform(matched, lambda h: F.struct(
        (-F.least(h["rank"], F.lit(1))).alias("pass"), (-h["field"]).alias("order"),
        h["raw"].alias("key"), F.element_at(names, h["field"] + 1).alias("value"))))
    rows = fence(rows, {"__used": used})
    parts = fence(rows, {
        "named": F.transform(matched, lambda h: F.struct(
            F.element_at(names, h["field"] + 1).alias("key"), cand[h["raw"]].alias("value"))),
        "unused": F.filter(F.map_entries(cand), lambda e: ~F.array_contains("__used", e["key"])),
        "lineage": F.transform(by_lateness, lambda h: F.struct(h["key"].alias("key"),
                                                               h["value"].alias("value"))),
    }, drop=("matched", "__used", "candidate_fields"))
    parts = fence(parts, {
        "unused_keys": F.transform("unused", lambda e: e["key"]),
        "lineage_keys": F.transform("lineage", lambda e: e["key"]),
    })

    named, unused, lineage = F.col("named"), F.col("unused"), F.col("lineage")
    own = F.array(
        F.struct(F.lit("parameter").alias("key"), m["parameter"].alias("value")),
        F.struct(F.lit("value").alias("key"), m["value"].alias("value")),
        F.struct(F.lit("unit").alias("key"), m["unit"].alias("value")))
    own_lineage = F.array(F.struct(m["source_key"].alias("key"),
                                   F.lit("parameter/value/unit").alias("value")))
    measured_keys = literal_array(["parameter", "value", "unit"])
    unused_keys = F.col("unused_keys")
    # An unused key that spells a standard name is passed through over the resolved value.
    hidden = F.when(is_measurement, measured_keys).otherwise(unused_keys)
    context = F.filter(named, lambda e: ~F.array_contains(hidden, e["key"]))
    added = F.when(is_measurement, own).otherwise(unused)
    lineage_keys = F.col("lineage_keys")
    lineage_once = F.filter(
        lineage, lambda e, i: (F.array_position(lineage_keys, e["key"]) == i + 1)
        & ~F.equal_null(e["key"], m["source_key"]))
    left_over = F.filter(unused, lambda e: ~F.equal_null(e["key"], m["source_key"]))
    return fence(parts, {
        "record_type": F.when(is_measurement, "sensor_reading").otherwise(F.col("record_type")),
        "measurement_no": F.coalesce(F.col("measurement_no") + 1, F.lit(0)),
        "standardized_fields": F.map_from_entries(F.concat(context, added)),
        "raw_to_standard_map": F.map_from_entries(
            F.when(is_measurement, F.concat(lineage_once, own_lineage)).otherwise(lineage_once)),
        "unmapped_fields": F.map_from_entries(left_over),
    }, drop=("m", "named", "unused", "lineage", "unused_keys", "lineage_keys"))
