"""Sinks and the record chain: no loss, no doubling, one parse."""

import os
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from toolweave.functions.text import float_text, to_int, to_number, to_plain_number
from toolweave.operators import sinks
from toolweave.operators.canonical import canonicalize
from toolweave.operators.standardize import standardize_fields
from toolweave.queries import records

SF = "/root/testdata/sf0.001"


def catalog(spark, rows):
    names = sinks.FILE_COLUMNS
    kinds = {"accepted_count": "int", "rejected_count": "int", "ingestion_time": "timestamp"}
    schema = ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names)
    df = spark.createDataFrame([(i, n, t) for i, n, t in rows], "file_id string, filename string, t string")
    return df.select(*[F.col(n) if n in df.columns else (F.to_timestamp("t") if n == "ingestion_time" else F.lit(None).cast(kinds.get(n, "string"))).alias(n) for n in names]), schema


def test_numbers(spark):
    df = spark.createDataFrame([(x,) for x in ("true", "1,200", "7.0", "7.9", "x", None, "3000000000", " +5 ")], "v string")
    got = [tuple(r) for r in df.select(to_number(F.col("v")), to_plain_number(F.col("v")), to_int(F.col("v"))).collect()]
    assert got == [(1.0, 1.0, 1), (1200.0, None, None), (7.0, 7.0, 7), (7.9, 7.9, None), (None, None, None), (None, None, None), (3e9, 3e9, 3_000_000_000), (5.0, 5.0, 5)]


def test_float_text(spark):
    values = ["1e7", "12345678.25", "1e16", "2.5e-5", "0.0001", "3.50", "-1e20", "1e300", "0.00012"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r[0] for r in df.select(float_text(F.col("v"))).collect()] == [repr(float(v)) for v in values]


def test_canonical_defaults(spark):
    df = spark.createDataFrame([("", "", "nope", 1), ("event", "x", None, 2)], "record_type string, coarse_type string, confidence string, seq long")
    rows = canonicalize(df.withColumn("data", F.create_map(F.lit("@type"), F.lit("alarm")))).collect()
    assert [(r.record_type, r.source_record_type, r.confidence, r.source_reference) for r in rows] == [
        ("unknown_record", "unknown_record", 1.0, "record:1"), ("fault_event", "x", 1.0, "record:2")]
    assert canonicalize(df.drop("seq")).first().source_reference.startswith("record:")


def test_matching_grows_linearly(spark):
    def seconds(keys):
        bag = F.map_from_entries(F.transform(F.sequence(F.lit(1), F.lit(keys)), lambda i: F.struct(F.concat(F.lit("key_"), i.cast("string"), F.lit("_"), F.col("id").cast("string")).alias("key"), F.lit("v").alias("value"))))
        df = standardize_fields(spark.range(3000).select(bag.alias("candidate_fields")))
        began = time.time()
        df.write.format("noop").mode("overwrite").save()
        return time.time() - began

    seconds(20)
    assert seconds(160) < 25 * max(0.4, seconds(20))  # eight times the keys; the square would be 64


def test_catalog_upsert(spark, tmp_path):
    path = str(tmp_path / "files")
    first, _ = catalog(spark, [("a", "1", "2024-01-02"), ("b", "1", "2024-01-02")])
    sinks.save_files(spark, first, path)
    older, _ = catalog(spark, [("a", "2", "2024-01-01"), ("c", "2", "2024-01-01"), ("c", "3", "2024-01-03")])
    sinks.save_files(spark, older, path)
    sinks.save_files(spark, older, path)
    assert sorted((r.file_id, r.filename) for r in spark.read.parquet(path).collect()) == [("a", "2"), ("b", "1"), ("c", "3")]


def test_failing_read_keeps_the_catalog(spark, tmp_path):
    path = tmp_path / "files"
    first, _ = catalog(spark, [("a", "1", "2024-01-02")])
    sinks.save_files(spark, first, str(path))
    part = next(path.rglob("*.parquet"))
    good = part.read_bytes()
    part.write_bytes(b"broken")
    for crc in part.parent.glob(".*.crc"):
        os.rename(crc, crc.with_suffix(".old"))
    with pytest.raises(Exception):
        sinks.save_files(spark, first, str(path))
    assert part.read_bytes() == b"broken"
    part.write_bytes(good)


def test_tables_hold_everything_once(spark, tmp_path):
    validated = records.validated(spark, SF)
    base, staging = str(tmp_path / "tables"), str(tmp_path / "staging")
    for _ in range(2):
        sinks.write_tables(validated, base, staging, "load-1")
    n = 0
    for name in [*sinks.DOMAIN_COLUMNS, sinks.REJECTED]:
        if any(Path(base, name).rglob("*.parquet")):
            n += spark.read.parquet(f"{base}/{name}").count()
    assert n == validated.count()
    states = spark.read.parquet(f"{base}/equipment_states")
    assert {r.event_date.isoformat() if hasattr(r.event_date, "isoformat") else r.event_date for r in states.select("event_date").distinct().collect()} <= {f"2024-01-{d:02}" for d in range(1, 32)}


def test_results_replace_their_load(spark, tmp_path):
    rows = spark.range(5).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("filename"), "id")
    for _ in range(2):
        sinks.write_results(rows, str(tmp_path / "r"), "x")
    sinks.write_results(rows, str(tmp_path / "r"), "y")
    assert spark.read.json(str(tmp_path / "r")).count() == 10
