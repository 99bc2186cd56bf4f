"""Removal of word windows that a document with a smaller id holds too, by super-k-mer partitioning.

A window is 13 consecutive words. Its minimiser is the smallest hash among its 6-word pieces, so equal windows have
equal minimisers. Consecutive windows with one minimiser travel as one packed string (a super-k-mer) to the bucket of
that minimiser, where the windows are unpacked, sorted and compared exactly; hashes only choose the bucket.

A first exchange carries minimisers alone and finds those of two or more documents: only super-k-mers with one of
them are packed and sent. What is found, a bit for each super-k-mer of a document, goes back to the documents by broadcast up to BROADCAST_BYTES, else by a join
on the id; so do the spans in the end.

Skew. In the first exchange a minimiser that occurs twice in a batch is settled there and costs the batch one entry. Within one batch of rows equal super-k-mers are settled on the spot: all but the smallest id's windows are
removed there, and only that one travels, so a passage that a third of all documents share costs each batch one
string. A minimiser with many different super-k-mers in a batch (the edges of such a passage) is hot: its windows go
one by one to a second exchange by the window itself, and a notice tells the bucket to send what other batches hold of
that minimiser the same way. No task gathers all rows of a hot minimiser or window.

Repeated ids: rows count as different documents only by id, so rows of one id never remove each other's words.
A null id is compared with nothing and loses nothing.
"""

from __future__ import annotations

import zlib
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from toolweave.llm.common import BROADCAST_BYTES, fingerprint, small_batches, space_words, table, utf8, without, written

WINDOW = 13
PIECE = 6
BATCH_BYTES = 32 << 20  # text that one map step packs at once
BUCKET_BYTES = 16 << 20  # text behind the windows of one bucket, on average
PARTITION_BYTES = 64 << 20
HOT_STRINGS = 64  # different super-k-mers of one minimiser in a batch

SENT = T.StructType(
    [
        T.StructField("part", T.LongType()),  # what it is sent by
        T.StructField("bucket", T.LongType()),  # null for spans and single windows
        T.StructField("blob", T.BinaryType()),  # packed super-k-mers, or a window
        T.StructField("doc", T.LongType()),
        T.StructField("print", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("stop", T.LongType()),  # null for single windows
    ]
)
OUTPUTS = ("n_words", "n_removed", "kept_text")


def minimisers(words: list[bytes], window: int = WINDOW, piece: int = PIECE):
    """The minimiser of each window of a document of at least `window` words, as uint64."""
    import numpy as np
    import xxhash

    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - piece + 1
    mixed = np.zeros(n, np.uint64)
    for k in range(piece):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    width, span = 1, window - piece + 1
    low = mixed
    while width < span:  # minima over 1, 2, 4, ... pieces
        step = min(width, span - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    return low


def runs_of(words: list[bytes], window: int = WINDOW, piece: int = PIECE):
    """Runs of windows with one minimiser: arrays of their minimisers, first windows and ends."""
    import numpy as np

    low = minimisers(words, window, piece)
    first = np.r_[0, np.flatnonzero(low[1:] != low[:-1]) + 1]
    return low[first], first, np.r_[first[1:], len(low)]


def super_kmers(words: list[bytes], window: int = WINDOW, piece: int = PIECE, wanted=None):
    """Yield (minimiser, first window, packed string) for the runs, or for those that a boolean array selects."""
    low, first, end = runs_of(words, window, piece)
    if wanted is not None:
        low, first, end = low[wanted], first[wanted], end[wanted]
    for minimiser, a, b in zip(low.tolist(), first.tolist(), end.tolist()):
        yield minimiser, a, b" ".join(words[a : b + window - 1])


def pack(entries: list[tuple], hot: list[int]) -> bytes:
    """entries: sorted (minimiser, packed string, doc, print, first window)."""
    import numpy as np
    import zstandard

    numbers = np.array([(e[2], e[3], e[4]) for e in entries], np.int64).reshape(-1, 3).T
    head = np.array([len(entries), len(hot)], np.int64)
    keys = np.array([e[0] for e in entries], np.uint64)
    parts = [head.tobytes(), np.array(hot, np.uint64).tobytes(), keys.tobytes(), numbers.tobytes(), b"\n".join(e[1] for e in entries)]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def unpack(blob: bytes) -> tuple[list[tuple], list[int]]:
    import numpy as np
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(blob)
    n, h = np.frombuffer(data, np.int64, 2).tolist()
    at = 16
    hot = np.frombuffer(data, np.uint64, h, at).tolist()
    at += 8 * h
    keys = np.frombuffer(data, np.uint64, n, at).tolist()
    at += 8 * n
    docs, prints, starts = np.frombuffer(data, np.int64, 3 * n, at).reshape(3, n).tolist()
    strings = data[at + 24 * n :].split(b"\n") if n else []
    return list(zip(keys, strings, docs, prints, starts)), hot


def windows_of(packed: bytes, window: int):
    """The windows of a packed string, in order."""
    cuts = [-1]
    at = packed.find(b" ")
    while at >= 0:
        cuts.append(at)
        at = packed.find(b" ", at + 1)
    cuts.append(len(packed))
    return [packed[cuts[i] + 1 : cuts[i + window]] for i in range(len(cuts) - window)]


def settle(windows: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """windows: (window, doc, print, start). Returns those of each window's smallest doc, and (doc, print, start) of the rest."""
    windows.sort()
    first, rest = [], []
    for _, run in groupby(windows, key=lambda x: x[0]):
        run = list(run)
        for x in run:
            (first if x[1] == run[0][1] else rest).append(x)
    return first, [x[1:] for x in rest]


def ranges(starts: list[tuple], window: int) -> list[tuple]:
    """(doc, print, start) of removed windows as (doc, print, first word, end of words), neighbours united."""
    out: list[list] = []
    for doc, mark, start in sorted(starts):
        if out and out[-1][0] == doc and out[-1][1] == mark and start <= out[-1][3]:
            out[-1][3] = start + window
        else:
            out.append([doc, mark, start, start + window])
    return [tuple(x) for x in out]


class _Rows:
    """Output rows of one step, as Arrow batches of bounded size."""

    def __init__(self, schema, most: int = 8 << 20):
        self.schema, self.most, self.rows, self.size = schema, most, [], 0

    def add(self, *row) -> None:
        self.rows.append(row)
        self.size += 64 + len(row[2] or b"")

    def spans(self, found: list[tuple]) -> None:
        for doc, mark, start, stop in found:
            self.add(doc, None, None, doc, mark, start, stop)

    def windows(self, found: list[tuple]) -> None:
        for window, doc, mark, start in found:
            self.add(zlib.crc32(window), None, window, doc, mark, start, None)

    def take(self, all_rows: bool = False):
        import pyarrow as pa

        if self.rows and (all_rows or self.size >= self.most):
            columns = list(zip(*self.rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)
            self.rows, self.size = [], 0


def _arrow_schema():
    import pyarrow as pa

    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    return pa.schema([pa.field(f.name, k) for f, k in zip(SENT.fields, kinds)])


# kind 0: packed minimisers, documents, fingerprints and numbers within the document; kind 1: packed numbers of shared
# super-k-mers, documents and fingerprints, sent by document.
NUMBERS = T.StructType([T.StructField("part", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("blob", T.BinaryType())])
MARKED = T.StructType([T.StructField("doc", T.LongType()), T.StructField("print", T.LongType()), T.StructField("shared", T.BinaryType())])
SETTLED = -1  # print of an entry whose documents are marked already


def _texts(batches):
    """Batches of (doc, print, text) rows of about BATCH_BYTES of text, as lists."""
    texts, size = [], 0
    for batch in batches:
        for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), *(batch.column(i) for i in range(3, batch.num_columns))):
            texts.append(row)
            size += len(row[2])
            if size >= BATCH_BYTES:
                yield texts
                texts, size = [], 0
    if texts:
        yield texts


def _dealt(kind: int, part, columns: list):
    """Rows of NUMBERS: the columns (int64), packed by part."""
    import numpy as np
    import pyarrow as pa
    import zstandard

    order = np.argsort(part, kind="stable")
    groups = np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else []
    zip_ = zstandard.ZstdCompressor(level=1)
    blobs = [zip_.compress(np.concatenate([c[o] for c in columns]).tobytes()) for o in groups]
    return pa.RecordBatch.from_arrays(
        [pa.array([int(part[o[0]]) for o in groups], pa.int64()), pa.array([kind] * len(groups), pa.int32()), pa.array(blobs, pa.binary())], ["part", "kind", "blob"]
    )


def _gathered(batches, width: int, passed: int | None = None):
    """The columns packed in a partition's rows, side by side; rows of the kind `passed` are yielded first."""
    import numpy as np
    import pyarrow.compute as pc
    import zstandard

    held, unzip = [], zstandard.ZstdDecompressor()
    for batch in batches:
        if passed is not None:
            through = pc.equal(batch.column(1), passed)
            yield batch.filter(through)
            batch = batch.filter(pc.invert(through))
        held += [np.frombuffer(unzip.decompress(b), np.int64).reshape(width, -1) for b in batch.column(2).to_pylist()]
    yield np.concatenate(held, axis=1) if held else np.empty((width, 0), np.int64)


def _send_minimisers(parts: int, window: int, piece: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import zstandard

        zip_ = zstandard.ZstdCompressor(level=3)
        for texts in _texts(batches):
            found, docs, prints = [], [], []
            for doc, mark, data in texts:
                words = space_words(data)
                if len(words) >= window:
                    found.append(runs_of(words, window, piece)[0])
                    docs.append(doc)
                    prints.append(mark)
            if not found:
                continue
            lengths = [len(x) for x in found]
            low, docs, prints = np.concatenate(found), np.repeat(np.array(docs, np.int64), lengths), np.repeat(np.array(prints, np.int64), lengths)
            number = np.concatenate([np.arange(n, dtype=np.int64) for n in lengths])
            _, first, back, counts = np.unique(low, return_index=True, return_inverse=True, return_counts=True)
            here = counts[back] > 1
            yield _dealt(1, docs[here] % parts, [number[here], docs[here], prints[here]])
            prints = np.where(here, SETTLED, prints)
            sent = ~here
            sent[first] = True
            low = low[sent]
            yield _dealt(0, (low % np.uint64(parts)).astype(np.int64), [low.view(np.int64), docs[sent], prints[sent], number[sent]])

    return run


def _mark_shared(parts: int):
    """Of the minimisers of one partition, those of two entries or more, sent on by document."""

    def run(batches):
        import numpy as np

        for got in _gathered(batches, 4, passed=1):
            if not isinstance(got, np.ndarray):
                yield got
                continue
            low, docs, prints, number = got
            _, back, counts = np.unique(low, return_inverse=True, return_counts=True)
            shared = (counts[back] > 1) & (prints != SETTLED)
            yield _dealt(1, docs[shared] % parts, [number[shared], docs[shared], prints[shared]])

    return run


def _pack_bits():
    """A string of bits for each document: which of its super-k-mers are shared."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for number, docs, prints in _gathered(batches, 3):
            order = np.lexsort((prints, docs))
            number, docs, prints = number[order], docs[order], prints[order]
            cuts = np.flatnonzero((docs[1:] != docs[:-1]) | (prints[1:] != prints[:-1])) + 1
            first = np.r_[0, cuts].astype(np.int64) if len(docs) else np.empty(0, np.int64)
            bits = []
            for x in np.split(number, cuts) if len(docs) else []:
                on = np.zeros(int(x.max()) + 1, bool)
                on[x] = True
                bits.append(np.packbits(on).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(docs[first]), pa.array(prints[first]), pa.array(bits, pa.binary())], ["doc", "print", "shared"])

    return run


def _mapper(buckets: int, window: int, piece: int, hot_strings: int):
    """Packs and sends the super-k-mers with a shared minimiser."""
    import numpy as np

    def packed(texts: list[tuple], rows: _Rows) -> None:
        best: dict[tuple, list] = {}  # (minimiser, string) -> [doc, [(print, start)]]
        lost: list[tuple] = []

        def drop(string: bytes, doc: int, places: list) -> None:
            count = string.count(b" ") + 2 - window
            lost.extend((doc, mark, start + i) for mark, start in places for i in range(count))

        for doc, mark, data, shared in texts:
            bits = np.unpackbits(np.frombuffer(shared.as_py(), np.uint8))
            for minimiser, start, string in super_kmers(space_words(data), window, piece, np.flatnonzero(bits)):
                held = best.get((minimiser, string))
                if held is None:
                    best[minimiser, string] = [doc, [(mark, start)]]
                elif held[0] == doc:
                    held[1].append((mark, start))
                elif held[0] < doc:
                    drop(string, doc, [(mark, start)])
                else:
                    drop(string, *held)
                    best[minimiser, string] = [doc, [(mark, start)]]
        rows.spans(ranges(lost, window))
        by_bucket: dict[int, tuple[list, list]] = {}
        for minimiser, group in groupby(sorted(best), key=lambda x: x[0]):
            group = list(group)
            entries, hot = by_bucket.setdefault(minimiser % buckets, ([], []))
            found = [(minimiser, s, doc, mark, start) for _, s in group for doc, places in (best[minimiser, s],) for mark, start in places]
            if len(group) > hot_strings:
                hot.append(minimiser)
                first, rest = settle([(w, doc, mark, start + i) for _, s, doc, mark, start in found for i, w in enumerate(windows_of(s, window))])
                rows.spans(ranges(rest, window))
                rows.windows(first)
            else:
                entries.extend(found)
        for bucket, (entries, hot) in by_bucket.items():
            rows.add(bucket, bucket, pack(entries, hot), None, None, None, None)

    def run(batches):
        rows = _Rows(_arrow_schema())
        for texts in _texts(batches):
            packed(texts, rows)
            yield from rows.take()
        yield from rows.take(True)

    return run


def _bucket_reader(window: int):
    def unpacked(blobs: list[bytes], rows: _Rows) -> None:
        entries, hot = [], set()
        for blob in blobs:
            more, notices = unpack(blob)
            entries += more
            hot.update(notices)
        entries.sort()
        for minimiser, group in groupby(entries, key=lambda x: x[0]):
            group = list(group)
            if minimiser not in hot and all(x[2] == group[0][2] for x in group):
                continue  # in one document alone
            first, rest = settle([(w, doc, mark, start + i) for _, s, doc, mark, start in group for i, w in enumerate(windows_of(s, window))])
            rows.spans(ranges(rest, window))
            if minimiser in hot:
                rows.windows(first)

    def run(batches):
        rows, blobs, current = _Rows(_arrow_schema()), [], None
        for batch in batches:
            for i, bucket in enumerate(batch.column(1).to_pylist()):
                if bucket is None:  # spans and windows pass through
                    rows.add(*(c[i].as_py() for c in batch.columns))
                    continue
                if bucket != current:
                    unpacked(blobs, rows)
                    blobs, current = [], bucket
                blobs.append(batch.column(2)[i].as_py())
            yield from rows.take()
        unpacked(blobs, rows)
        yield from rows.take(True)

    return run


def _window_reader(window: int):
    """Rows come sorted by window and doc: all but the first doc's are removed."""

    def run(batches):
        rows, current, owner = _Rows(_arrow_schema()), None, None
        for batch in batches:
            for blob, doc, mark, start in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5))):
                if blob != current:
                    current, owner = blob, doc
                elif doc != owner:
                    rows.spans([(doc, mark, start, start + window)])
            yield from rows.take()
        yield from rows.take(True)

    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   piece: int = PIECE, hot_strings: int = HOT_STRINGS) -> DataFrame:
    """(doc, print, spans): word ranges [start, stop) to remove from the document of this id and text fingerprint."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), fingerprint(text_col).alias("print"), F.col(text_col).alias("text")).where(
        F.col("doc").isNotNull() & (F.length("text") >= 2 * window - 1)
    )
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES))
    sent = texts.mapInArrow(_send_minimisers(parts, window, piece), NUMBERS).repartition(parts, "part")
    sent = sent.mapInArrow(_mark_shared(parts), NUMBERS).repartition(parts, "part")
    marked = written(sent.mapInArrow(_pack_bits(), MARKED), "shared")
    texts = texts.join(_side(marked, 48 + F.length("shared")), ["doc", "print"])
    sent = texts.select("doc", "print", "text", "shared").mapInArrow(_mapper(max(parts, -(-size // BUCKET_BYTES)), window, piece, hot_strings), SENT)
    met = written(sent.repartition(parts, "part").sortWithinPartitions("bucket").mapInArrow(_bucket_reader(window), SENT), "repeats")
    single = met.where(F.col("blob").isNotNull()).repartition(parts, "blob").sortWithinPartitions("blob", "doc")
    spans = met.where(F.col("blob").isNull()).unionByName(single.mapInArrow(_window_reader(window), SENT))
    spans = spans.groupBy("doc", "print").agg(F.sort_array(F.collect_set(F.struct(F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop")))).alias("spans"))
    return spans.withColumn("spans", united("spans"))


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))


@F.arrow_udf(SPANS)
def united(spans):
    """Sorted word ranges, with those that touch or overlap made one."""
    import pyarrow as pa

    out = []
    for found in spans.to_pylist():
        merged: list[list[int]] = []
        for x in found:
            if merged and merged[-1][1] >= x["start"]:
                merged[-1][1] = max(merged[-1][1], x["stop"])
            else:
                merged.append([x["start"], x["stop"]])
        out.append([{"start": a, "stop": b} for a, b in merged])
    return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))


def _side(df: DataFrame, row_bytes: Column) -> DataFrame:
    """A written table, marked for broadcast if its size allows it."""
    return F.broadcast(df) if (df.agg(F.sum(row_bytes)).first()[0] or 0) <= BROADCAST_BYTES else df.hint("shuffle_merge")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   piece: int = PIECE, hot_strings: int = HOT_STRINGS, layout: bool = False) -> DataFrame:
    """docs with n_words, n_removed and kept_text.

    kept_text is the kept words joined by one space; with layout=True the white space after each kept word stays, and
    a text that loses nothing stays as it is. Null and empty texts have no words and an empty kept_text. No row goes.
    """
    docs = without(docs, *(n for n in OUTPUTS if n != text_col))
    spans = written(repeated_spans(docs, id_col, text_col, window, piece, hot_strings), "spans")
    spans = _side(spans, 48 + 16 * F.size("spans"))

    @F.arrow_udf(T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]))
    def cut(text, spans):
        import pyarrow as pa

        counts, removed, kept = [], [], []
        for data, found in zip(utf8(text), spans.to_pylist()):
            words = space_words(data)
            counts.append(len(words))
            gone: set[int] = set()
            for span in found or ():
                gone.update(range(span["start"], span["stop"]))
            removed.append(len(gone))
            if layout:
                kept.append(_cut_in_place(data, gone) if gone else data or b"")
            else:
                kept.append(b" ".join([w for i, w in enumerate(words) if i not in gone] if gone else words))
        return pa.StructArray.from_arrays(
            [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
            ["n_words", "n_removed", "kept"],
        )

    names = [c for c in docs.columns]
    left = docs.withColumns({"__doc": F.col(id_col).cast("long"), "__print": fingerprint(text_col)})
    joined = left.join(spans, (F.col("__doc") == F.col("doc")) & (F.col("__print") == F.col("print")), "left")
    made = joined.withColumn("__cut", cut(F.col(text_col), F.col("spans")))
    return made.select(
        *[left[f"`{c}`"] for c in names],
        F.col("__cut.n_words").alias("n_words"),
        F.col("__cut.n_removed").alias("n_removed"),
        F.col("__cut.kept").alias("kept_text"),
    )


def _cut_in_place(data: bytes, gone: set[int]) -> bytes:
    import re

    return b"".join(m[0] for i, m in enumerate(re.finditer(rb"[^ \t-\r]+[ \t-\r]*", data)) if i not in gone)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13)),
owners AS (SELECT win, min(doc_id) AS owner FROM windows GROUP BY win HAVING min(doc_id) < max(doc_id)),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM windows JOIN owners USING (win) WHERE doc_id > owner),
each_word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM words),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n
  FROM each_word e WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = e.doc_id AND g.p = e.p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(w.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM words w LEFT JOIN kept k USING (doc_id)
"""
