"""Canonical records: parsed records plus lineage, defaults and a canonical type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.maps import empty_bag, literal_map

LINEAGE = ["filename", "ingestion_time", "source_format", "parser_route"]


def canonical_type(record_type: Column, fields: Column) -> Column:
    """Canonical type a parser's record type stands for; unknown types pass through."""
    by_attribute = literal_map(vocab.TYPE_OF_EVENT_ATTRIBUTE)[F.upper(fields["@type"])]
    return F.when(
        record_type == "event",
        F.coalesce(by_attribute, F.lit("generic_operational_observation")),
    ).otherwise(F.coalesce(literal_map(vocab.TYPE_OF_SOURCE)[record_type], record_type))


def with_lineage(records: DataFrame, files: DataFrame) -> DataFrame:
    """Attach file lineage to records that only know their ``file_id``.

    A plain equi-join: Spark broadcasts the catalog only when its measured size is under
    the threshold, and splits a hot file's partition through AQE otherwise.
    """
    have = [c for c in LINEAGE if c in records.columns]
    return records.drop(*have).join(files.select("file_id", *LINEAGE), "file_id", "left")


def _or(df: DataFrame, name: str, default: Column) -> Column:
    return F.coalesce(F.col(name), default) if name in df.columns else default


def canonicalize(records: DataFrame) -> DataFrame:
    """Parsed records to canonical records: a narrow projection, no shuffle."""
    text = F.lit(None).cast("string")
    filled = lambda c: F.when(F.col(c) != "", F.col(c))  # noqa: E731  an empty name falls through like a missing one
    parsed_type = F.coalesce(filled("record_type") if "record_type" in records.columns else text, F.lit("unknown_record"))
    source_type = F.coalesce(*[filled(c) for c in ("coarse_type", "source_record_type")
                               if c in records.columns], parsed_type)
    number = (F.col("seq") if "seq" in records.columns else F.monotonically_increasing_id() + 1).cast("string")
    confidence = F.col("confidence").cast("string").try_cast("double") if "confidence" in records.columns else text.cast("double")
    data = _or(records, "data", empty_bag())
    keep = [c for c in ("file_id", "seq") if c in records.columns]
    return records.select(
        *keep,
        _or(records, "filename", text).alias("filename"),
        _or(records, "ingestion_time", F.lit(None).cast("timestamp")).alias("ingestion_time"),
        _or(records, "source_format", F.lit("unknown")).alias("source_format"),
        _or(records, "parser_route", F.lit("unknown_route")).alias("parser_route"),
        F.lit(vocab.PARSER_VERSION).alias("parser_version"),
        canonical_type(parsed_type, data).alias("record_type"),
        source_type.alias("source_record_type"),
        _or(records, "source_reference", F.concat(F.lit("record:"), number)).alias("source_reference"),
        F.coalesce(confidence, F.lit(1.0)).alias("confidence"),
        _or(records, "evidence_text", F.lit("")).alias("evidence_text"),
        data.alias("raw_fields"),
        data.alias("candidate_fields"),
        empty_bag().alias("unmapped_fields"),
        _or(records, "extra", empty_bag()).alias("extra"),
    )
