"""Engineering units as Column expressions over literal lookup maps.

The tables have a fixed size (tens of entries), so they ride in the expression itself:
no join, no broadcast, no shuffle, and the whole chain stays in one stage.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab
from .maps import literal_map, sql_text
from .text import strip


def unit_symbol(unit: Column) -> Column:
    """Canonical symbol of a unit spelling; an unknown spelling is kept, a blank is null."""
    t = strip(unit)
    key = F.lower(F.replace(t, F.lit(" "), F.lit("")))
    return F.when(t != "", F.coalesce(literal_map(vocab.UNIT_ALIASES)[key], t))


def _family_of_unit() -> dict:
    return {u: family for family in vocab.UNIT_FAMILY_ORDER
            for u in vocab.CONVERSIONS[family][1]}


def hinted_family(parameter: Column) -> Column:
    """Family from the parameter name; null if it has no hint."""
    name = F.lower(F.coalesce(parameter, F.lit("")))
    return reduce(
        lambda acc, hint: (F.when if acc is None else acc.when)(name.rlike(hint[1]), hint[0]),
        vocab.FAMILY_HINTS, None)


def family_of_unit(symbol: Column) -> Column:
    return literal_map(_family_of_unit())[symbol]


def measurement_family(parameter: Column, symbol: Column) -> Column:
    """Family from the parameter name, else from the unit symbol."""
    return F.coalesce(hinted_family(parameter), family_of_unit(symbol))


def _conversion_table() -> Column:
    rows = [
        f"{sql_text(f'{family}|{unit}')}, named_struct('shift', {sql_text(shift)}, "
        f"'factor', {sql_text(factor)}, 'divisor', {sql_text(divisor)}, 'unit', {sql_text(canonical)})"
        for family, (canonical, units) in vocab.CONVERSIONS.items()
        for unit, (shift, factor, divisor) in units.items()]
    return F.expr("map(" + ", ".join(rows) + ")")


def conversion(family: Column, symbol: Column) -> Column:
    """Struct ``shift, factor, divisor, unit`` of the pair, null when it is unsupported."""
    return _conversion_table()[F.concat_ws("|", family, symbol)]


def apply_conversion(value: Column, rule: Column) -> Column:
    return F.when(rule.isNull(), value).otherwise(
        (value - rule["shift"]) * rule["factor"] / rule["divisor"])
