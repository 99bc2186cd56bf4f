"""Benchmark decontamination by Wu-Manber search over words.

The patterns are the 13-word windows of the benchmark items (a shorter item is one window). Patterns of one length
share a search table. A table's shift map is keyed by blocks of two words: a block that occurs in no pattern lets the
search jump over eleven positions, a block at a pattern's end selects the bucket of patterns with that suffix, and
comparison of the words confirms an occurrence. The documents are read once, and nothing is shuffled.

The windows reach the executors as broadcasts of at most BLOCK_WINDOWS windows each, and a worker keeps the search table
of one block at a time. Of a larger benchmark the first block is searched where the rows lie; each further block is
searched by tasks of its own, which build its table once and keep only the texts that hold some of it. These findings
meet the rows by the text's digest.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from toolweave.llm.common import alnum_words, small_batches, table, utf8, without, written

WINDOW = 13
PER_MILLE_LIMIT = 50  # contaminated from 5 % of a document's words
BLOCK_WINDOWS = 1_000_000

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hits", T.ArrayType(T.IntegerType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)
OUTPUTS = ("n_words", "n_hit", "n_items", "items", "hit_words", "contaminated")


class WuManber:
    """Search table for patterns of one length, each a tuple of words."""

    def __init__(self, length: int, patterns: dict[tuple, tuple[str, ...]]):
        self.length, self.patterns = length, patterns
        self.block = min(2, length)
        self.jump = length - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = defaultdict(list)
        for pattern in patterns:
            for end in range(self.block, length + 1):
                key = self.key(pattern, end - 1)
                self.shift[key] = min(self.shift.get(key, self.jump), length - end)
            self.buckets[self.key(pattern, length - 1)].append(pattern)

    def key(self, words, at: int):
        return words[at] if self.block == 1 else (words[at - 1], words[at])

    def search(self, words: list[bytes]):
        """Yield (first word, pattern) of every occurrence."""
        at, total, length, jump = self.length - 1, len(words), self.length, self.jump
        shift, buckets, key = self.shift.get, self.buckets, self.key
        while at < total:
            block = key(words, at)
            step = shift(block, jump)
            if step:
                at += step
                continue
            first = at - length + 1
            here = tuple(words[first : at + 1])
            for pattern in buckets[block]:
                if pattern == here:
                    yield first, pattern
            at += 1


def tables_of(windows: list[tuple[str, str]]) -> list[WuManber]:
    """One table for each pattern length of (item, words joined by spaces)."""
    by_length: dict[int, dict[tuple, set]] = defaultdict(lambda: defaultdict(set))
    for item, window in windows:
        words = tuple(window.encode().split(b" "))
        by_length[len(words)][words].add(item)
    return [WuManber(n, {w: tuple(sorted(items)) for w, items in p.items()}) for n, p in sorted(by_length.items())]


_ready: dict[str, list[WuManber]] = {}


def _tables(name: str, block, built=None) -> list[WuManber]:
    if name not in _ready:
        if built is not None:
            built.add(1)
        _ready.clear()
        _ready[name] = tables_of(block.value)
    return _ready[name]


def windows_of(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct (item, window) rows, the window's words joined by spaces."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def cut(text):
        import pyarrow as pa

        out = []
        for data in utf8(text):
            words = alnum_words(data)
            width = min(window, len(words))
            out.append([b" ".join(words[i : i + width]).decode() for i in range(len(words) - width + 1)] if words else [])
        return pa.array(out, pa.list_(pa.string()))

    item = F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item")
    return items.select(item, F.explode(cut(F.col(text_col))).alias("window")).distinct()


def _blocks(windows: DataFrame, most: int):
    """Lists of windows of at most `most` each, by hash of the window, so that each block has whole windows."""
    total = windows.count()
    parts = max(1, -(-total // most))
    if parts > 1:
        windows = written(windows, "windows")  # cut once, read by each block
    while parts > 1:
        sizes = windows.groupBy(F.pmod(F.xxhash64("window"), F.lit(parts)).alias("p")).count()
        if sizes.agg(F.max("count")).first()[0] <= most:
            break
        parts *= 2
    for p in range(parts):
        rows = windows.where(F.pmod(F.xxhash64("window"), F.lit(parts)) == p).collect()
        if rows or p == 0:
            yield [(r["item"], r["window"]) for r in rows]


def _searcher(spark: SparkSession, windows: list[tuple[str, str]], built=None):
    """A column function text -> FOUND for one block of windows. built: an accumulator that counts tables made."""
    block, name = spark.sparkContext.broadcast(windows), uuid.uuid4().hex

    @F.arrow_udf(FOUND)
    def search(text):
        import pyarrow as pa

        counts, hits, names = [], [], []
        for data in utf8(text):
            words = alnum_words(data)
            covered, items = set(), set()
            for t in _tables(name, block, built):
                for first, pattern in t.search(words):
                    covered.update(range(first, first + t.length))
                    items.update(t.patterns[pattern])
            counts.append(len(words))
            hits.append(sorted(covered))
            names.append(sorted(items))
        return pa.StructArray.from_arrays(
            [pa.array(counts, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.string()))],
            ["n_words", "hits", "items"],
        )

    return search


def _further(texts: DataFrame, blocks, built) -> DataFrame | None:
    """(digest, more) for the texts that hold windows of these blocks: their hits and items, an entry a block."""
    parts = []
    for k, windows in enumerate(blocks):
        search = _searcher(texts.sparkSession, windows, built).asNondeterministic()  # a filter on it must not run it twice
        found = texts.select(F.sha2("text", 256).alias("__text"), search("text").alias("f")).where(F.size("f.items") > 0)
        parts.append(found.select("__text", F.lit(k).alias("block"), "f.hits", "f.items"))
    if not parts:
        return None
    each = written(reduce(DataFrame.unionAll, parts), "block_findings")
    once = each.groupBy("__text", "block").agg(F.first(F.struct("hits", "items")).alias("f"))  # copies of a text agree
    return once.groupBy("__text").agg(F.collect_list("f").alias("__more"))


def find(docs: DataFrame, items: DataFrame, text_col: str = "text", window: int = WINDOW,
         block_windows: int = BLOCK_WINDOWS, item_text: str = "text", item_id: str = "item_id", built=None) -> DataFrame:
    """docs with n_words, n_hit, n_items, items (sorted), hit_words (covered word positions, ascending) and contaminated.

    Null and empty texts have no words and are never contaminated. An item without words has no window. Rows are
    neither dropped nor merged; input columns named like an output are replaced. built: an accumulator that counts the
    search tables made.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = without(docs, *(n for n in OUTPUTS if n != text_col))
    kept = docs.columns
    blocks = _blocks(windows_of(items, item_id, item_text, window), block_windows)
    rows = docs.withColumn("__found", _searcher(spark, next(blocks), built)(F.col(text_col)))
    more = _further(docs.select(F.col(text_col).alias("text")).where("text IS NOT NULL"), blocks, built)
    if more is None:
        hits, names = F.col("__found.hits"), F.col("__found.items")
    else:
        rows = rows.withColumn("__digest", F.sha2(text_col, 256)).join(more, F.col("__digest") == more["__text"], "left")
        union = lambda part: F.sort_array(F.array_distinct(F.concat(
            F.col(f"__found.{part}"), F.coalesce(F.flatten(F.col(f"__more.{part}")), F.col(f"__found.{part}")))))
        hits, names = union("hits"), union("items")
    n_words = F.col("__found.n_words")
    n_hit = F.size(hits).cast("long")
    return rows.select(
        *[F.col(f"`{c}`") for c in kept],
        n_words.alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        names.alias("items"),
        hits.alias("hit_words"),
        ((n_hit > 0) & (n_hit * 1000 >= n_words * PER_MILLE_LIMIT)).alias("contaminated"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


ORACLE_SQL = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
item_windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS width,
         array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM item_words WHERE len(w) > 0)),
widths AS (SELECT DISTINCT width FROM item_windows),
doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
doc_windows AS (
  SELECT doc_id, width, i, array_to_string(w[i:i + width - 1], ' ') AS win
  FROM (SELECT doc_id, width, w, unnest(range(1, len(w) - width + 2)) AS i FROM doc_words, widths WHERE len(w) >= width)),
hits AS (
  SELECT d.doc_id, d.i, d.width, b.item_id FROM doc_windows d JOIN item_windows b ON d.win = b.win AND d.width = b.width),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + width)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(i.joined, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM doc_words d LEFT JOIN covered c USING (doc_id) LEFT JOIN items i USING (doc_id)
"""
