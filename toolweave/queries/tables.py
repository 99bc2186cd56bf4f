"""Domain tables bound to the given tables: every event becomes a reading, errors are faults, orders give states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


DEALT_ROWS = 100_000  # costly rows a task


def dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for costly work on each row, its rows dealt out evenly: as many tasks for each core as keep them at
    DEALT_ROWS. The scan's own splits say little: a row group is read by one of them, and the others are empty. The count
    reads the files' footers alone."""
    rows, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return rows.repartition(cores * max(1, -(-rows.count() // (DEALT_ROWS * cores))))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, event_ts, tool_id, parameter, value (text), unit, step, severity, status of every event."""
    k = F.col("event_id")
    pick = lambda n, *values: F.get(F.array(*[F.lit(v).cast("string") for v in values]), (k % n).cast("int"))
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("event_ts"),
        F.concat(F.lit("T"), (F.col("user_id") % 17).cast("string")).alias("tool_id"),
        F.col("event_type").alias("parameter"),
        F.when(k % 11 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("value"),
        pick(3, "C", "Pa", "").alias("unit"),
        F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("S"), (k % 7).cast("string"))).alias("step"),
        pick(5, "INFO", "WARN", "error", None, "Critical").alias("severity"),
        pick(4, "ok", "ok", "open", None).alias("status"),
    )


READINGS_SQL = """
  SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS event_ts, 'T' || CAST(user_id % 17 AS VARCHAR) AS tool_id, event_type AS parameter,
    CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS x,
    CASE WHEN event_id % 11 = 0 THEN 'n/a' END AS value_text,
    CASE event_id % 3 WHEN 0 THEN 'C' WHEN 1 THEN 'Pa' ELSE '' END AS unit,
    CASE WHEN event_id % 7 = 0 THEN '' ELSE 'S' || CAST(event_id % 7 AS VARCHAR) END AS step,
    CASE event_id % 5 WHEN 0 THEN 'INFO' WHEN 1 THEN 'WARN' WHEN 2 THEN 'error' WHEN 4 THEN 'Critical' END AS severity,
    CASE event_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'ok' WHEN 2 THEN 'open' END AS status
  FROM events"""


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's order states in time order, each with the one before."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey"), F.col("o_orderstatus").alias("curr_state"), F.lag("o_orderstatus").over(w).alias("prev_state")
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a file catalog."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("file_id"), F.concat(F.lit("order_"), F.col("o_orderkey").cast("string"), F.lit(".log")).alias("filename"),
        F.col("o_orderdate").alias("ingestion_time"),
    )
