"""Field bags: MAP<STRING,STRING> helpers.

The order of a bag's entries decides which of two colliding keys counts, so a bag comes from ``map_from_entries`` over an
ordered array or from ``bag``, never from an unordered Python mapping of unknown origin.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


ENTRIES = "array<struct<key:string,value:string>>"
BAG = "map<string,string>"


def sql_text(value) -> str:
    """A SQL literal for a Python string, number, None or list of those."""
    if value is None:
        return "CAST(NULL AS STRING)"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(sql_text(v) for v in value) + ")"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_map(mapping: dict) -> Column:
    """Map literal; one parsed expression instead of a call per entry."""
    return F.expr("map(" + ", ".join(
        f"{sql_text(k)}, {sql_text(v)}" for k, v in mapping.items()) + ")")


def literal_array(values) -> Column:
    values = list(values)
    return F.expr(sql_text(values)) if values else F.array().cast("array<string>")


def empty_bag() -> Column:
    return F.create_map().cast(BAG)


def bag(pairs: dict) -> Column:
    """Bag from a dict of name -> text column, keeping null values."""
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v.cast("string"))])


def bag_of_present(pairs: dict) -> Column:
    """Bag from a dict of name -> text column, leaving out the null values."""
    return F.map_filter(bag(pairs), lambda k, v: v.isNotNull())


def let(value: Column, make) -> Column:
    """make(value), with value evaluated once however often make uses it."""
    return F.get(F.transform(F.array(value), make), 0)


def has_any(m: Column, keys) -> Column:
    return F.arrays_overlap(F.map_keys(m), literal_array(keys))


def _one_of_each(entries: Column, last: bool) -> Column:
    """Entries with one of each key, by one sort on key and place; entries without a key go."""
    placed = F.transform(entries, lambda e, i: F.struct(e["key"].alias("key"), (-i if last else i).alias("at"), e["value"].alias("value")))
    ordered = F.array(F.array_sort(F.filter(placed, lambda e: e["key"].isNotNull())))
    heads = F.get(F.transform(ordered, lambda s: F.filter(s, lambda e, i: (i == 0) | (e["key"] != F.get(s, i - 1)["key"]))), 0)
    back = F.array_sort(F.transform(heads, lambda e: F.struct((-e["at"] if last else e["at"]).alias("at"), e["key"].alias("key"), e["value"].alias("value"))))
    return F.map_from_entries(F.transform(back, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))


def first_of(entries: Column) -> Column:
    """A bag of ordered entries; of a repeated key the first stays."""
    return _one_of_each(entries, False)


def last_of(entries: Column) -> Column:
    """A bag of ordered entries; of a repeated key the last stays."""
    return _one_of_each(entries, True)
