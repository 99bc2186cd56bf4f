"""Validation reasons, per-file counts and routing to domain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.fence import fence
from ..functions.maps import has_any, literal_map
from ..functions.text import first_present


def validation_reason(record_type: Column, confidence: Column, fields: Column) -> Column:
    """``ok``, ``ok_generic`` or the reason the record is rejected."""
    has = lambda key: F.map_contains_key(fields, F.lit(key))
    out = F.when(F.coalesce(confidence, F.lit(0.0)) < vocab.MIN_CONFIDENCE,
                 "confidence_below_threshold")
    for kind, (keys, reason) in vocab.ACCEPT_RULES.items():
        out = out.when(record_type == kind, F.when(has_any(fields, keys), "ok").otherwise(reason))
    reading = (has("parameter") & has("value")) | has("acceptable_range")
    rich = F.size(fields) >= vocab.MIN_GENERIC_FIELDS
    return (
        out.when(record_type == "sensor_reading",
                 F.when(reading, "ok").otherwise("missing_parameter_or_value"))
        .when(record_type == "generic_operational_observation",
              F.when(rich, "ok_generic").otherwise("generic_too_thin"))
        .otherwise("unknown_record_type")
    )


def validate(records: DataFrame) -> DataFrame:
    """Adds ``validation_reason`` and ``accepted``; split with ``accepted_of``/``rejected_of``."""
    reason = validation_reason(F.col("record_type"), F.col("confidence"), F.col("normalized_fields"))
    judged = fence(records, {"validation_reason": reason})
    return judged.withColumn("accepted", F.col("validation_reason").isin("ok", "ok_generic"))


def accepted_of(validated: DataFrame) -> DataFrame:
    return validated.filter("accepted")


def rejected_of(validated: DataFrame) -> DataFrame:
    return validated.filter("NOT accepted").select("filename", "record_type", "validation_reason")


def accept_reject_counts(validated: DataFrame, by: str = "file_id") -> DataFrame:
    """Accepted and rejected totals per file, combined map-side before the shuffle."""
    return validated.groupBy(by).agg(
        F.count_if(F.col("accepted")).alias("accepted_count"),
        F.count_if(~F.col("accepted")).alias("rejected_count"))


def reject_summary(validated: DataFrame) -> DataFrame:
    """Rows per rejection reason."""
    return (validated.filter("NOT accepted").groupBy("validation_reason")
            .agg(F.count(F.lit(1)).alias("n")))


def target_table(record_type: Column) -> Column:
    return F.coalesce(literal_map(vocab.TABLE_OF_TYPE)[record_type],
                      F.lit("generic_observations_staging"))


def route(validated: DataFrame) -> DataFrame:
    """Accepted records with their destination table and flattened lineage columns.

    Lineage columns are separate from the field bag, so a log that happens to contain
    ``filename`` or ``file_id`` cannot overwrite them.
    """
    fields = F.col("normalized_fields")
    ok = accepted_of(validated)
    tool_source = F.try_element_at(F.filter(
        F.array(*[F.lit(k) for k in vocab.ROUTE_TOOL_KEYS]),
        lambda k: F.map_contains_key(fields, k)), F.lit(1))
    return ok.select(
        target_table(F.col("record_type")).alias("target_table"),
        *[F.col(c) for c in ("file_id", "filename", "parser_route", "parser_version",
                             "source_record_type", "source_reference") if c in ok.columns],
        F.col("record_type"),
        F.col("measurement_no"),
        F.col("confidence").alias("parser_confidence"),
        F.col("evidence_text"),
        F.to_json("raw_fields").alias("raw_field_map"),
        F.to_json("raw_to_standard_map").alias("raw_to_standard_map"),
        F.col("validation_reason"),
        fields[tool_source].alias("tool_id"),
        fields.alias("fields"),
    )


def sink_tool_id(fields: Column, routed: Column) -> Column:
    return first_present(routed, *[fields[k] for k in vocab.SINK_TOOL_KEYS])


def sink_event_ts(fields: Column) -> Column:
    return first_present(*[fields[k] for k in vocab.SINK_TIME_KEYS])
