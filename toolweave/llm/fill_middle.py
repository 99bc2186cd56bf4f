"""Fill-in-the-middle samples with a learned rank index.

A text is cut twice into prefix, middle and suffix. Cuts are ranks of units (code points, words or lines), texts are bytes,
so each cut needs the byte offset of a rank. The offsets of all unit boundaries of a text are held as a piecewise linear
model: segments whose lines miss no boundary by more than a given error, fitted in one pass by narrowing the cone of
slopes that still fit, and for every boundary the residual between line and truth, one byte each. A cut is predicted from
its segment and put right by its residual, so it is exact.

Cuts and form come from the sha256 of "seed:id", so reruns agree and no row depends on another; the work is narrow. A null
text is empty; an empty text and one that holds a marker stay plain; a null id is hashed as the word null; repeated rows
give repeated samples; an input column named like an output is replaced; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from toolweave.llm.common import small_batches, table, utf8, without

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ERROR = 32  # a line may miss a boundary by so many bytes; residuals are single bytes, so 126 at most
BLOCK = 1 << 20  # bytes whose boundaries are held as numbers at once


def _starts(data: np.ndarray, before: int, unit: str) -> np.ndarray:
    """Where units start in a block of bytes; before: the byte before the block, -1 at the start of the text."""
    if unit == "codepoint":
        return np.flatnonzero((data & 0xC0) != 0x80)
    last = np.concatenate([np.array([before], np.int16), data[:-1].astype(np.int16)])
    if unit == "line":
        return np.flatnonzero((last == 10) | (last == -1))
    if unit != "word":
        raise ValueError(f"no such unit: {unit}")
    space = lambda x: (x == 32) | ((x >= 9) & (x <= 13))
    return np.flatnonzero((space(last) & ~space(data)) | (last == -1))


class RankIndex:
    """Offsets of the unit boundaries of one text by rank, from 0 to n (the end of the text)."""

    def __init__(self, data: bytes, unit: str = "codepoint", error: int = ERROR):
        if not 0 <= error <= 126:
            raise ValueError("the error must lie between 0 and 126 bytes")
        self.error = error
        self.first: list[int] = []  # first rank, offset there and slope of each segment
        self.base: list[int] = []
        self.slope: list[float] = []
        residuals = []
        whole, rank = np.frombuffer(data, np.uint8), 0
        for a in range(0, len(whole), BLOCK):
            offsets = a + _starts(whole[a : a + BLOCK], int(whole[a - 1]) if a else -1, unit)
            residuals.append(self._fit(offsets, rank))
            rank += len(offsets)
        residuals.append(self._fit(np.array([len(whole)]), rank))
        self.n = rank
        self.residuals = np.concatenate(residuals)

    def _fit(self, offsets: np.ndarray, rank: int) -> np.ndarray:
        """Add the segments of these boundaries, whose first has this rank; their residuals."""
        residuals, s = np.zeros(len(offsets), np.int8), 0
        while s < len(offsets):
            low, high, end, step = -np.inf, np.inf, s + 1, 4096
            while end < len(offsets):
                run = np.arange(end, min(end + step, len(offsets)))
                rise, far = (offsets[run] - offsets[s]).astype(np.float64), (run - s).astype(np.float64)
                lows = np.maximum(np.maximum.accumulate((rise - self.error) / far), low)
                highs = np.minimum(np.minimum.accumulate((rise + self.error) / far), high)
                bad = np.flatnonzero(lows > highs)
                fits = int(bad[0]) if len(bad) else len(run)
                if fits:
                    low, high, end = lows[fits - 1], highs[fits - 1], end + fits
                if fits < len(run):
                    break
                step *= 2
            slope = float((low + high) / 2) if end > s + 1 else 0.0
            self.first.append(rank + s)
            self.base.append(int(offsets[s]))
            self.slope.append(slope)
            lines = int(offsets[s]) + np.floor(slope * np.arange(end - s) + 0.5).astype(np.int64)
            residuals[s:end] = offsets[s:end] - lines
            s = end
        return residuals

    def predict(self, rank: int) -> int:
        k = bisect_right(self.first, rank) - 1
        return self.base[k] + int(np.floor(self.slope[k] * (rank - self.first[k]) + 0.5))

    def offset(self, rank: int) -> int:
        return self.predict(rank) + int(self.residuals[rank])


def draws(seed: int, key) -> list[int]:
    """Four 32-bit numbers that depend on seed and id alone."""
    digits = hashlib.sha256(f"{seed}:{'null' if key is None else key}".encode()).hexdigest()
    return [int(digits[a : a + 8], 16) for a in range(0, 32, 8)]


def sample(data: bytes, key, seed: int, plain_percent: int, spm_percent: int, unit: str, error: int):
    """(units, form, units of the prefix, units of the middle, output) of one text."""
    index = RankIndex(data, unit, error)
    h1, h2, h3, h4 = draws(seed, key)
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if not data or p in data or s in data or m in data or h3 % 100 >= 100 - plain_percent:
        return index.n, "plain", None, None, data
    first, second = sorted((h1 % (index.n + 1), h2 % (index.n + 1)))
    a, b = index.offset(first), index.offset(second)
    if h4 % 100 < spm_percent:
        return index.n, "spm", first, second - first, b"".join((s, data[b:], p, data[:a], m, data[a:b]))
    return index.n, "psm", first, second - first, b"".join((p, data[:a], s, data[b:], m, data[a:b]))


MADE = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_units", T.LongType()),
    T.StructField("middle_units", T.LongType()), T.StructField("output", T.StringType()),
])


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain_percent: int = 10,
                   spm_percent: int = 20, unit: str = "codepoint", error: int = ERROR) -> DataFrame:
    """docs with n (units of the text), form (plain, psm, spm), prefix_units, middle_units (null where plain) and output.

    plain_percent of the texts stay as they are, spm_percent of the others put the suffix first.
    """
    small_batches(docs.sparkSession)

    @F.arrow_udf(MADE)
    def make(key, text):
        import pyarrow as pa

        made = [sample(t or b"", k, seed, plain_percent, spm_percent, unit, error) for k, t in zip(key.to_pylist(), utf8(text))]
        columns = list(zip(*made)) if made else [()] * 5
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
        arrays[4] = arrays[4].cast(pa.string())
        return pa.StructArray.from_arrays(arrays, MADE.fieldNames())

    kept = without(docs, *MADE.fieldNames())
    return kept.withColumn("__m", make(docs[id_col].cast("long"), docs[text_col])).select(*[F.col(f"`{c}`") for c in kept.columns], "__m.*")


def restore(output: Column, form: Column) -> Column:
    """The text that an output of fill_in_middle was made of."""
    s, p, m = (F.locate(x, output) for x in (SUFFIX, PREFIX, MIDDLE))
    n = F.lit(len(PREFIX))
    between = lambda a, b: F.substr(output, a + n, b - a - n)
    middle = F.substr(output, m + n)
    head = n + F.lit(1)
    psm = F.concat(F.substr(output, head, s - head), middle, between(s, m))
    spm = F.concat(between(p, m), middle, F.substr(output, head, p - head))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


ORACLE_SQL = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
d AS (
  SELECT doc_id, text, length(text) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM t),
c AS (
  SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (
  SELECT doc_id, text, n, form, a, b, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
