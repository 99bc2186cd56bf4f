"""Domain tables: fixed schemas, projection of routed rows, writers and the file catalog."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import exists
from ..functions import vocab
from ..functions.text import first_present, present, to_int, to_plain_number
from .validate import rejected_of, route, sink_event_ts, sink_tool_id, target_table

FILES_PER_DATE = 8
RESULT_BUCKETS = 256
CATALOG_BUCKETS = 256

# The columns of each domain table besides filename, tool_id and event_ts.
DOMAIN_COLUMNS = {
    "equipment_states": ["curr_state", "prev_state", "lot", "wafer", "recipe", "step",
                         "severity", "event_name"],
    "process_parameters_recipes": ["recipe", "step", "parameter", "value", "unit", "status",
                                   "lot", "wafer"],
    "sensor_readings": ["parameter", "value", "unit", "lot", "wafer", "recipe", "step",
                        "severity"],
    "fault_events": ["fault_code", "fault_summary", "severity", "lot", "wafer", "recipe",
                     "step", "status"],
    "wafer_processing_sequences": ["lot", "wafer", "slot", "recipe", "step", "status",
                                   "action", "event_name", "duration_s", "wafer_count"],
    "generic_observations_staging": ["record_type", "note"],
}
FILE_COLUMNS = ["file_id", "filename", "extension", "sha256", "source_format",
                "parser_version", "schema_fingerprint", "accepted_count", "rejected_count",
                "ingestion_time"]


def safe_text(c: Column) -> Column:
    """Text for a column; a JSON list becomes ``a, b``, an empty value becomes null."""
    items = F.from_json(c, "array<string>")
    listed = F.array_join(F.filter(items, present), ", ")
    return (F.when(~present(c), None)
            .when(c.startswith("[") & items.isNotNull(), F.when(listed != "", listed))
            .otherwise(c))


def _domain_column(table: str, name: str, fields: Column) -> Column:
    if name == "value" and table == "sensor_readings":
        return to_plain_number(F.coalesce(fields["value"], fields["measured_value"]))
    if name in ("value", "duration_s"):
        return to_plain_number(fields[name])
    if name == "wafer_count":
        return to_int(fields[name])
    if name == "record_type":
        return F.col("record_type")
    if name == "note":
        return F.coalesce(first_present(*[fields[k] for k in vocab.NOTE_KEYS]),
                          F.lit(vocab.DEFAULT_NOTE))
    return safe_text(fields[name])


def project_domain_rows(routed: DataFrame, table: str) -> DataFrame:
    """Rows of one domain table in its fixed schema."""
    fields = F.col("fields")
    return routed.filter(F.col("target_table") == table).select(
        F.col("filename"),
        sink_tool_id(fields, F.col("tool_id")).alias("tool_id"),
        sink_event_ts(fields).alias("event_ts"),
        *[_domain_column(table, c, fields).alias(c) for c in DOMAIN_COLUMNS[table]],
    )


def with_event_date(rows: DataFrame) -> DataFrame:
    """Adds ``event_date`` from the spellings of time that logs use; a time without a year, or none, gives ``unknown``."""
    ts = F.coalesce("event_ts", F.lit(""))
    dashed = F.regexp_extract(ts, r"^(\d{4}-\d{2}-\d{2})", 1)
    slashed = F.regexp_replace(F.regexp_extract(ts, r"^(\d{4}/\d{2}/\d{2})", 1), "/", "-")
    return rows.withColumn("event_date", F.coalesce(F.nullif(dashed, F.lit("")), F.nullif(slashed, F.lit("")), F.lit("unknown")))


REJECTED = "rejected_records"


def stage(validated: DataFrame, staging_path: str) -> DataFrame:
    """Parse once: all validated rows written by target table, rejects as one more target, and read back.

    The folder is this run's own, so loads side by side don't overwrite each other's rows; a written table also
    survives the loss of any executor.
    """
    target = F.when(F.col("accepted"), target_table(F.col("record_type"))).otherwise(REJECTED)
    rows = validated.withColumn("target_table", target)
    path = f"{staging_path}/run-{uuid.uuid4().hex}"
    rows.write.partitionBy("target_table").parquet(path)
    order = [c for c in rows.columns if c != "target_table"] + ["target_table"]
    return validated.sparkSession.read.schema(rows.select(*order).schema).parquet(path)


def write_tables(validated: DataFrame, base_path: str, staging_path: str, load_id: str) -> None:
    """Load accepted rows into the six domain tables and the rest into ``rejected_records``.

    Rows lie in partitions (load_id, event_date); each date's rows are gathered into a few files by a salt. A load that
    failed half-way or runs again under its id replaces its own partitions and doubles nothing. Each target reads its own
    staged rows alone; targets without any are left out, the others are written side by side.
    """
    rows = stage(validated, staging_path)
    filled = {r[0] for r in rows.select("target_table").distinct().collect()}  # eight at most
    now = F.current_timestamp()

    def save(df: DataFrame, name: str, *by: str) -> None:
        made = df.withColumns({"inserted_at": now, "load_id": F.lit(load_id)})
        salt = F.pmod(F.xxhash64(*[c for c in df.columns]), F.lit(FILES_PER_DATE))
        made = made.repartition(*[F.col(c) for c in by], salt)
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("load_id", *by).parquet(f"{base_path}/{name}")

    def load(name: str) -> None:
        part = rows.where(F.col("target_table") == name)
        if name == REJECTED:
            save(rejected_of(part), name)
        else:
            save(with_event_date(project_domain_rows(route(part), name)), name, "event_date")

    with ThreadPoolExecutor(len(filled) or 1) as side_by_side:
        for done in [side_by_side.submit(load, name) for name in sorted(filled)]:
            done.result()


def write_results(validated: DataFrame, path: str, load_id: str) -> None:
    """Full per-record result as JSON, in hash buckets of the file; a load replaces its own rows."""
    bucket = F.pmod(F.xxhash64("filename"), F.lit(RESULT_BUCKETS))
    rows = validated.withColumns({"load_id": F.lit(load_id), "bucket": bucket})
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("load_id", "bucket").json(path)


def upsert_files(existing: DataFrame | None, incoming: DataFrame) -> DataFrame:
    """Catalog after inserting or updating by ``file_id``: an incoming row replaces what was there.

    Of several incoming rows of a file the newest wins. ``max_by`` keeps one candidate per key before the shuffle, so
    repeated ingests of one file never meet in a sorted window.
    """
    both = incoming.select(*FILE_COLUMNS).withColumn("__new", F.lit(1))
    if existing is not None:
        both = existing.select(*FILE_COLUMNS).withColumn("__new", F.lit(0)).unionByName(both)
    rest = [c for c in FILE_COLUMNS if c != "file_id"]
    latest = both.groupBy("file_id").agg(
        F.max_by(F.struct(*rest), F.struct("__new", "ingestion_time", *[c for c in rest if c != "ingestion_time"])).alias("r"))
    return latest.select("file_id", *[F.col(f"r.{c}").alias(c) for c in rest])


def save_files(spark: SparkSession, incoming: DataFrame, path: str) -> None:
    """Upsert into the catalog table at ``path``, which lies in hash buckets of the file.

    Only buckets with incoming files are read and replaced. The catalog is created where the path is absent; any
    failure to read what is there is raised and leaves it untouched.
    """
    bucket = F.pmod(F.xxhash64("file_id"), F.lit(CATALOG_BUCKETS))
    existing = None
    if exists(spark, path):
        touched = [r["b"] for r in incoming.select(bucket.alias("b")).distinct().collect()]  # CATALOG_BUCKETS at most
        existing = spark.read.parquet(path).where(F.col("bucket").isin(touched))
    merged = upsert_files(existing, incoming).withColumn("bucket", bucket)
    merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
