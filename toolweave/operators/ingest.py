"""The catalog of a landing path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LARGEST = 1 << 30  # bytes of a file that is read to be hashed


def extension_of(filename: Column) -> Column:
    """The last dot and what follows, lower-cased; nothing for names that start with their only dot or end with one."""
    return F.lower(F.regexp_extract(filename, r"^.+(\.[^.]+)$", 1))


def ingest_files(spark: SparkSession, path: str, largest: int = LARGEST) -> DataFrame:
    """(file_id, filename, extension, size_bytes, raw_path, ingestion_time, sha256) of each file under a path or glob.

    file_id depends on path and content alone, so a rerun gives the same ids. A file is one row while it is hashed: those
    beyond `largest` bytes are listed without being read, with a null sha256 and an id of path, size and time of change.
    Spark's file source leaves out empty files and names that start with a dot or an underscore.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    common = lambda df, sha, key: df.select(
        F.sha2(F.concat_ws("\n", "path", key), 256).alias("file_id"), name.alias("filename"), F.col("length").alias("size_bytes"), F.col("path").alias("raw_path"), sha.alias("sha256"))
    read = common(files.where(F.col("length") <= largest), F.sha2("content", 256), F.sha2("content", 256))
    listed = common(files.where(F.col("length") > largest), F.lit(None).cast("string"), F.concat_ws(" ", F.col("length").cast("string"), F.col("modificationTime").cast("string")))
    both = read.unionByName(listed)
    return both.select("file_id", "filename", extension_of(F.col("filename")).alias("extension"), "size_bytes", "raw_path", F.current_timestamp().alias("ingestion_time"), "sha256")
