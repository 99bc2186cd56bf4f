"""Scalar text helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

INT_TEXT = r"^[+-]?\d+$"
FLOAT_TEXT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def strip(c: Column) -> Column:
    """Trim every kind of edge white space (Spark's ``trim`` only knows the space)."""
    return F.btrim(c, F.lit(WHITESPACE))


def present(c: Column) -> Column:
    """True unless the value is null or one of the empty spellings; never null."""
    return c.isNotNull() & ~c.isin("", "[]", "{}")


def first_present(*cols: Column) -> Column:
    return F.coalesce(*[F.when(present(c), c) for c in cols])


def canonical_key(c: Column) -> Column:
    """Letters and digits only, lower case: ``Lot_ID`` and ``@lot-id`` collide on purpose."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def coerce_text(c: Column, blank_to_null: bool = False) -> Column:
    """Canonical text of the scalar a value would be read as.

    Integers lose leading zeros and a plus sign, floats are re-rendered as doubles,
    booleans are lower-cased, other text is trimmed.  ``1_000`` stays text.
    """
    t = strip(c)
    out = (
        F.when(F.lower(t).isin("true", "false"), F.lower(t))
        .when(t.rlike(INT_TEXT), int_text(t))
        .when(t.rlike(FLOAT_TEXT), float_text(t))
        .otherwise(t)
    )
    return F.when(t != "", out) if blank_to_null else out


def int_text(t: Column) -> Column:
    body = F.regexp_replace(t, r"^\+?(-?)0*(\d)", "$1$2")
    return F.when(body == "-0", "0").otherwise(body)


def float_text(t: Column) -> Column:
    """A float as digits with a point (``10000000.0``); below 1e-4 and from 1e16 on as ``1e-05``, ``1e+16``."""
    number = t.try_cast("double")
    plain = number.cast("string")
    digits = F.regexp_replace(number.cast("decimal(38,18)").cast("string"), r"0+$", "")
    power = F.regexp_extract(plain, r"E-?(\d+)$", 1)
    short = F.concat(F.regexp_replace(plain, r"(\.0)?E.*$", ""), F.when(plain.contains("E-"), "e-").otherwise("e+"),
                     F.lpad(power, F.greatest(F.length(power), F.lit(2)), F.lit("0")))
    middle = (F.abs(number) >= 1e-4) & (F.abs(number) < 1e16)
    return (F.when(~plain.contains("E"), plain)
            .when(middle, F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits))
            .otherwise(short))


def _flag(t: Column) -> Column:
    """1.0 and 0.0 for true and false, else null."""
    return F.when(F.lower(t) == "true", 1.0).when(F.lower(t) == "false", 0.0)


def to_number(c: Column) -> Column:
    """Double after dropping thousands commas; booleans count as 1 and 0; null when the text is not a number."""
    t = F.replace(strip(c), F.lit(","), F.lit(""))
    return F.coalesce(_flag(t), F.when(t.rlike(FLOAT_TEXT), t.try_cast("double")))


def to_plain_number(c: Column) -> Column:
    """Like to_number, but text with thousands commas is no number."""
    t = strip(c)
    return F.coalesce(_flag(t), F.when(t.rlike(FLOAT_TEXT), t.try_cast("double")))


def to_finite(c: Column) -> Column:
    """Numeric value of a text or numeric column; null for text, NaN and infinities."""
    s = strip(c.cast("string"))
    return F.when(s.rlike(FLOAT_TEXT), s.try_cast("double"))


def to_int(c: Column) -> Column:
    """64-bit whole numbers only: ``7``, ``7.0`` and ``true`` give a number, ``7.9`` and other text give null."""
    t = strip(c)
    number = t.try_cast("double")
    whole = F.when(t.rlike(FLOAT_TEXT) & (number == F.floor(number)), number.try_cast("bigint"))
    return F.coalesce(_flag(t).cast("bigint"), F.when(t.rlike(INT_TEXT), t.try_cast("bigint")).otherwise(whole))


def non_blank_lines(c: Column) -> Column:
    return F.filter(F.split(c, LINE_BREAK), lambda x: strip(x) != "")


def stripped_lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, LINE_BREAK), strip), lambda x: x != "")
