"""Costly rows are dealt out evenly, however the file is cut."""

from pyspark.sql import functions as F

from toolweave.queries import tables


def test_a_table_of_one_row_group_is_dealt_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "DEALT_ROWS", 100, raising=False)
    spark.range(2000).select(F.col("id").alias("event_id"), F.sha2(F.col("id").cast("string"), 256).alias("props")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")  # many splits, of which one has all the rows
    try:
        rows = tables.dealt(spark, str(tmp_path), "events")
        sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
        ids = rows.agg(F.count_distinct("event_id")).first()[0]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert ids == sum(sizes) == 2000 and len(sizes) == 20 and max(sizes) <= 200
