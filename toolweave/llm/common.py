"""Helpers shared by the operators of this subpackage.

Rules that hold for every operator here:

* an input column named like an output column (in any case) is replaced by the output;
* a null text is an empty text: zero words, nothing found;
* a repeated row is judged like its first copy and stays in the result, unless an operator says otherwise;
* an empty table gives an empty result of the same schema.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Bytes to bytes: A-Z to a-z; digits, a-z and all bytes of non-ASCII characters stay; the rest become spaces.
ALNUM_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let the session hand texts to Python in batches of this many rows at most: a batch lies in memory several times."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop the columns of these names, in any case."""
    gone = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in gone])


def alnum_words(data: bytes | None) -> list[bytes]:
    """Words of letters, digits and non-ASCII characters of a UTF-8 text, A-Z lower-cased."""
    return data.translate(ALNUM_TABLE).split() if data else []


def space_words(data: bytes | None) -> list[bytes]:
    """Words between ASCII white space (space, \\t, \\n, \\v, \\f, \\r); bytes.split() cuts at just these."""
    return data.split() if data else []


def utf8(column) -> list[bytes | None]:
    """The UTF-8 bytes of an Arrow string array."""
    import pyarrow as pa

    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = "file://" + os.path.join(tempfile.gettempdir(), "toolweave-checkpoints")
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to a new folder beside the checkpoints and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BROADCAST_BYTES = 32 << 20


def fingerprint(text_col: str) -> Column:
    """Tells rows of one id and different texts apart (64 bits)."""
    return F.xxhash64(F.col(text_col).cast("binary"))


def sized(df: DataFrame, row_bytes: int = 48) -> DataFrame:
    """A written table of fixed-width rows, marked for broadcast if it is small enough."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def drop_rows(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs without the rows that gone (doc, print; written) names."""
    gone = sized(gone)
    keyed = docs.withColumns({"__doc": F.col(id_col).cast("long"), "__print": fingerprint(text_col)})
    same = keyed["__doc"].eqNullSafe(gone["doc"]) & keyed["__print"].eqNullSafe(gone["print"])
    return keyed.join(gone, same, "left_anti").drop("__doc", "__print")
