"""Normalized fields: scalar coercion, field fill-ins and unit conversion, in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.fence import fence
from ..functions.maps import bag_of_present, let
from ..functions.text import coerce_text, present, strip, to_number
from ..functions.units import apply_conversion, conversion, family_of_unit, hinted_family, measurement_family, unit_symbol


def coerce_scalars(fields: Column, keep_text=tuple(vocab.ID_FIELDS)) -> Column:
    """Every value re-rendered as the scalar it reads as; identifiers keep their text."""
    return F.transform_values(
        fields, lambda k, v: F.when(k.isin(*keep_text), strip(v)).otherwise(coerce_text(v)))


def _take(fields: Column, target: str, sources: list[str]) -> Column:
    """Value for an absent target key: that of the first source key that exists."""
    wanted = F.array(*[F.lit(s) for s in sources])
    source = F.try_element_at(
        F.filter(wanted, lambda s: F.map_contains_key(fields, s)), F.lit(1))
    return F.when(~F.map_contains_key(fields, F.lit(target)), source)


def harmonize_fields(fields: Column) -> Column:
    """Ordered fill-ins for keys that are absent; present keys are never touched."""
    sources = F.filter(
        F.array(*[F.struct(F.lit(t).alias("key"), _take(fields, t, s).alias("source"))
                  for t, s in vocab.HARMONIZED.items()]),
        lambda x: x["source"].isNotNull())
    added = F.map_from_entries(F.transform(
        sources, lambda x: F.struct(x["key"].alias("key"), fields[x["source"]].alias("value"))))
    return F.map_concat(fields, added)


def measure(value: Column, unit: Column, parameter: Column) -> dict[str, Column]:
    """The three inputs of a conversion: number, unit symbol and family."""
    symbol = unit_symbol(unit)
    return {"number": value, "symbol": symbol, "family": measurement_family(parameter, symbol)}


def converted(number: Column, symbol: Column, family: Column) -> dict[str, Column]:
    """Converted value and unit; an unsupported pair keeps both."""
    return by_rule(number, symbol, family, conversion(family, symbol))


def by_rule(number: Column, symbol: Column, family: Column, rule: Column) -> dict[str, Column]:
    return {
        "value": apply_conversion(number, rule),
        "unit": F.when(number.isNull(), symbol).otherwise(F.coalesce(rule["unit"], symbol)),
        "family": family,
    }


def convert_units(df: DataFrame, value: str, unit: str, parameter: str) -> DataFrame:
    """Adds ``canonical_value, canonical_unit, measurement_family`` for columns of a frame.

    ``value`` is text or a number.  An unsupported (family, unit) pair keeps value and unit and
    still reports its family; a value that is no number gives null.
    """
    numeric = (F.col(value) if dict(df.dtypes)[value] in ("double", "float", "int", "bigint")
               else to_number(F.col(value).cast("string")))
    staged = fence(df, {f"__{k}": c for k, c in
                        measure(numeric.cast("double"), F.col(unit), F.col(parameter)).items()})
    out = converted(F.col("__number"), F.col("__symbol"), F.col("__family"))
    return fence(staged, {"canonical_value": out["value"], "canonical_unit": out["unit"],
                          "measurement_family": out["family"]},
                 drop=("__number", "__symbol", "__family"))


MEASURES = ("main", "measured", "expected")


def normalize(records: DataFrame) -> DataFrame:
    """Standardized records to normalized records: adds ``normalized_fields``."""
    coerced = fence(records, {"__c": coerce_scalars(F.col("standardized_fields"))})
    filled = fence(coerced, {"__f": harmonize_fields(F.col("__c"))}, drop=("__c",))
    f = F.col("__f")
    has = lambda key: F.map_contains_key(f, F.lit(key))
    text = lambda key: F.when(present(f[key]), f[key])

    parameter = F.coalesce(text("parameter"), text("sensor_id"), text("event_name"))
    values = {"main": f["value"], "measured": f["measured_value"], "expected": f["expected_value"]}
    # The measured and expected values fall back to the unit as logged, not as converted.
    units = {"main": f["unit"], "measured": F.coalesce(text("measured_unit"), text("unit")),
             "expected": F.coalesce(text("expected_unit"), text("unit"))}
    # The three measures go through one lambda a step. Written out side by side, without a lambda, the steps became
    # methods of more than 8,000 bytes of byte code, which the JVM never compiles.
    present_in = {"main": has("value") & has("unit"), "measured": has("measured_value"), "expected": has("expected_value")}
    given = F.array(*[F.struct(present_in[m].alias("on"), values[m].alias("value"), units[m].alias("unit")) for m in MEASURES])
    read = F.transform(given, lambda s: F.struct(
        s["on"].alias("on"), F.when(s["on"], to_number(s["value"])).alias("number"), unit_symbol(s["unit"]).alias("symbol")))
    staged = fence(filled, {"__h": let(F.coalesce(parameter, F.lit("")), hinted_family), "__m": read})
    named = F.transform("__m", lambda s: F.struct(
        s["on"].alias("on"), s["number"].alias("number"), s["symbol"].alias("symbol"),
        F.when(s["on"], F.coalesce(F.col("__h"), family_of_unit(s["symbol"]))).alias("family")))
    ruled = F.transform(named, lambda s: F.struct(
        s["on"].alias("on"), s["number"].alias("number"), s["symbol"].alias("symbol"), s["family"].alias("family"),
        conversion(s["family"], s["symbol"]).alias("rule")))
    made = F.transform(ruled, lambda s: F.struct(
        s["on"].alias("on"), s["symbol"].alias("symbol"),
        *[v.alias(k) for k, v in by_rule(s["number"], s["symbol"], s["family"], s["rule"]).items()]))
    staged = fence(staged, {"__m": made}, drop=("__h",))

    main, meas, exp = (F.get("__m", i) for i in range(len(MEASURES)))
    on_main = main["on"]
    on_meas = meas["on"] & meas["symbol"].isNotNull()
    on_exp = exp["on"] & exp["symbol"].isNotNull()
    as_text = lambda c: c.cast("string")
    staged = fence(staged, {"__u": bag_of_present({
        "value": F.when(on_main, as_text(main["value"])),
        "unit": F.when(on_main, main["unit"]).when(has("unit"), main["symbol"])
                 .when(on_meas, meas["unit"]),
        "units": F.when(has("units"), unit_symbol(f["units"])),
        "measured_value": F.when(on_meas, as_text(meas["value"])),
        "measured_unit": F.when(on_meas, meas["unit"]),
        "expected_value": F.when(on_exp, as_text(exp["value"])),
        "expected_unit": F.when(on_exp, exp["unit"])
                          .when(has("expected_unit"), unit_symbol(f["expected_unit"])),
        "measurement_family": F.coalesce(F.when(on_exp, exp["family"]),
                                         F.when(on_meas, meas["family"]),
                                         F.when(on_main, main["family"])),
    })}, drop=("__m",))
    u = F.col("__u")
    return fence(staged, {"normalized_fields": F.map_concat(
        F.map_filter(f, lambda k, v: ~F.map_contains_key(u, k)), u)}, drop=("__f", "__u"))
