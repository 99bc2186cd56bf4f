"""Vector codes: each vector is cut into parts, each part named by the nearest entry of its position's codebook.

Components are whole numbers, floor(1024 * x), so that distances, means and ties are exact. Codebooks come from rounds of
assigning parts to entries and moving each entry to the floored mean of its parts (Lloyd). A round does only what can
change: every part keeps its entry and the exact distance to it. Where that entry stayed, the distance still holds and the
part beats every other entry that stayed, so it is compared with the moved ones alone; where it moved, all entries are
compared again. At equal distance the lower index wins, in both ways.

A round is one narrow pass over the vectors, written with their entries and distances for the next one; what is shuffled
are one sum a codebook entry and component and task. Entries (256 a part) are all that the driver holds.

Vectors that are null, empty, or hold null, NaN or infinite components are left out; so are those with a component beyond
2**17, whose error may not fit in 64 bits. Shorter vectors are filled up with zeros to the longest, and all to a multiple
of the parts. Ids may repeat (each row gets a code); among equal ids the smaller vector comes first, null ids last. With
fewer vectors than entries there are fewer entries; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from toolweave.llm.common import BROADCAST_BYTES, table, written

SCALE = 1024
LARGEST = float(2**17)
EXACT = 2**51  # sums of squares up to here are exact in doubles
SALTS = 64

STATE = [T.StructField("__v", T.BinaryType()), T.StructField("__code", T.BinaryType()), T.StructField("__dist", T.BinaryType()), T.StructField("__error", T.LongType())]


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) >= LARGEST))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x from the entries, exact."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * top * top * x.shape[1] < EXACT:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    out = np.empty((len(x), len(entries)), np.int64)
    for i, e in enumerate(entries):
        gap = x - e
        out[:, i] = (gap * gap).sum(1)
    return out


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row (the lower one in a tie) and the squared distance."""
    d = distances(x, entries)
    best = d.argmin(1)
    return best, d[np.arange(len(x)), best]


def reassign(x: np.ndarray, code: np.ndarray, dist: np.ndarray, entries: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """nearest() from the last code and its exact distance, where only moved entries changed; and how many were compared."""
    code, dist, active = code.copy(), dist.copy(), moved[code]
    compared = 0
    if active.any():
        code[active], dist[active] = nearest(x[active], entries)
        compared += int(active.sum()) * len(entries)
    still, who = np.flatnonzero(~active), np.flatnonzero(moved)
    if len(still) and len(who):
        best, d = nearest(x[still], entries[who])
        best = who[best]
        closer = (d < dist[still]) | ((d == dist[still]) & (best < code[still]))
        code[still[closer]], dist[still[closer]] = best[closer], d[closer]
        compared += len(still) * len(who)
    return code, dist, compared


def _unpacked(column, kind) -> np.ndarray:
    """A binary column of equally long values as a matrix."""
    import pyarrow as pa

    column = column.cast(pa.binary())
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return np.ascontiguousarray(flat).view(kind).reshape(len(column), -1)


def _packed(matrix: np.ndarray):
    import pyarrow as pa

    matrix = np.ascontiguousarray(matrix)
    at = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.itemsize * matrix.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(at), pa.py_buffer(matrix.tobytes())])


def whole_numbers(column, width: int) -> np.ndarray:
    """floor(1024 * x) of a list column without nulls, rows filled up with zeros to this width."""
    import pyarrow.compute as pc

    flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _state(batch, names, v, code, dist):
    """A batch of the kept columns with vectors, codes and distances beside them."""
    import pyarrow as pa

    small = v.astype(np.int16) if np.abs(v).max(initial=0) < 2**15 else v.astype(np.int32)
    made = [_packed(small), _packed(code.astype(np.uint8)), _packed(dist.astype(np.int64)), pa.array(dist.sum(1), pa.int64())]
    return pa.RecordBatch.from_arrays([batch.column(n) for n in names] + made, names=[*names, *[f.name for f in STATE]])


def _read_state(batch, width: int):
    """(rows, vectors, codes, distances) of a batch; twice where its rows hold two kinds of numbers."""
    import pyarrow.compute as pc

    sizes = pc.binary_length(batch.column("__v")).to_numpy(zero_copy_only=False)
    for kind in (np.int16, np.int32):
        rows = np.flatnonzero(sizes == width * np.dtype(kind).itemsize)
        if len(rows):
            part = batch if len(rows) == batch.num_rows else batch.take(rows)
            yield part, _unpacked(part.column("__v"), kind).astype(np.int64), _unpacked(part.column("__code"), np.uint8), _unpacked(part.column("__dist"), np.int64)


class Codebooks:
    """Entries by part, each a matrix of whole numbers, and which of them the last round moved."""

    def __init__(self, entries: list[np.ndarray], moved: list[np.ndarray] | None = None):
        self.entries = entries
        self.moved = moved or [np.ones(len(e), bool) for e in entries]
        self.width = sum(e.shape[1] for e in entries)

    def cut(self, v: np.ndarray) -> list[np.ndarray]:
        return np.split(v, len(self.entries), axis=1)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for e in self.entries for x in e.ravel().tolist()).encode()).hexdigest()

    def after(self, sums: dict[tuple[int, int], np.ndarray]) -> Codebooks:
        """Entries moved to the floored means: (part, entry) -> count, then the sum of each component."""
        made = []
        for p, e in enumerate(self.entries):
            e = e.copy()
            for k in range(len(e)):
                if (p, k) in sums:
                    e[k] = sums[p, k][1:] // sums[p, k][0]
            made.append(e)
        return Codebooks(made, [(a != b).any(1) for a, b in zip(made, self.entries)])


def _first_books(vectors: DataFrame, id_col: str, vector_col: str, parts: int, entries: int, width: int) -> Codebooks:
    import pyarrow as pa

    order = [F.col(id_col).asc_nulls_last(), F.col(vector_col)]
    rows = [r[0] for r in vectors.orderBy(*order).limit(entries).select(F.transform(vector_col, lambda x: x.cast("double"))).collect()]
    v = whole_numbers(pa.array(rows, pa.list_(pa.float64())), width)
    return Codebooks(np.split(v, parts, axis=1))


def _sums(state: DataFrame, books: Codebooks) -> dict[tuple[int, int], np.ndarray]:
    """Count and component sums of the parts of each entry: added up by task, then by Spark."""
    shapes, width = [e.shape for e in books.entries], books.width

    def add(batches):
        import pyarrow as pa

        held = [np.zeros((n, w + 1), np.int64) for n, w in shapes]
        for batch in batches:
            for _, v, code, _ in _read_state(batch, width):
                for p, x in enumerate(np.split(v, len(shapes), axis=1)):
                    order = np.argsort(code[:, p], kind="stable")
                    found, at = np.unique(code[order, p], return_index=True)
                    held[p][found, 1:] += np.add.reduceat(x[order], at, axis=0)
                    held[p][found, 0] += np.diff(np.append(at, len(order)))
        for p, h in enumerate(held):
            used = np.flatnonzero(h[:, 0])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(h[used].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "sums"])

    rows = state.select("__v", "__code", "__dist").mapInArrow(add, "part int, entry int, sums array<long>")
    total = rows.select("part", "entry", F.posexplode("sums")).groupBy("part", "entry", "pos").agg(F.sum("col").alias("total"))
    out: dict[tuple[int, int], np.ndarray] = {}
    for part, entry, at, value in total.collect():  # one row a component of an entry
        out.setdefault((part, entry), np.zeros(shapes[part][1] + 1, np.int64))[at] = value
    return out


def train(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", keep: tuple[str, ...] = (), parts: int = 4,
          entries: int = 256, rounds: int = 4) -> tuple[DataFrame, Codebooks | None]:
    """(rows, codebooks): the id and the kept columns of each usable vector, its code (one byte a part) and its error,
    the squared distances added up."""
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index is one byte")
    spark = vectors.sparkSession
    names = list(dict.fromkeys([id_col, *keep]))
    rows = vectors.where(usable(F.col(vector_col))).select(*names, F.col(vector_col).alias("__raw"))
    schema = T.StructType([rows.schema[n] for n in names] + STATE)
    longest = rows.agg(F.max(F.size("__raw"))).first()[0]
    if longest is None:
        return spark.createDataFrame([], T.StructType([rows.schema[n] for n in names])).select(*names, F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error")), None
    width = -(-longest // parts) * parts
    books = _first_books(rows, id_col, "__raw", parts, entries, width)

    def first(batches, held=spark.sparkContext.broadcast(books)):
        for batch in batches:
            v = whole_numbers(batch.column("__raw"), width)
            found = [nearest(x, e) for x, e in zip(held.value.cut(v), held.value.entries)]
            yield _state(batch, names, v, np.stack([c for c, _ in found], 1), np.stack([d for _, d in found], 1))

    state = written(rows.mapInArrow(first, schema), "codes")
    for _ in range(rounds):
        books = books.after(_sums(state, books))

        def again(batches, held=spark.sparkContext.broadcast(books)):
            now = held.value
            for batch in batches:
                for part, v, code, dist in _read_state(batch, width):
                    found = [reassign(x, code[:, p], dist[:, p], now.entries[p], now.moved[p])[:2] for p, x in enumerate(now.cut(v))]
                    yield _state(part, names, v, np.stack([c for c, _ in found], 1), np.stack([d for _, d in found], 1))

        state = written(state.mapInArrow(again, schema), "codes")
    return state.select(*names, F.col("__code").alias("code"), F.col("__error").alias("error")), books


def with_sum(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """rows with the sum of value over all rows of an equal key, nulls together. The sums are broadcast up to 32 MB; beyond
    that they are joined, with every key dealt out to 64 places, so that a frequent one isn't one task."""
    sums = written(rows.groupBy(F.col(key).alias("__k")).agg(F.sum(value).alias(name)), "sums")
    if sums.count() * 48 <= BROADCAST_BYTES:
        return rows.join(F.broadcast(sums), F.col(key).eqNullSafe(F.col("__k")), "left").drop("__k")
    dealt = rows.withColumn("__s", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    spread = sums.withColumn("__n", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(spread, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__s") == F.col("__n")), "left").drop("__k", "__s", "__n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = train(table(spark, sf_dir, "embeddings"), keep=("label",))
    made = with_sum(rows.select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error"), "label", "error", "label_error")
    return made.select("vec_id", "code", "error", "label_error", F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256"))


def _oracle(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """The rounds written out one by one, each assigning every part by a comparison with all entries."""
    steps = [f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id, embedding) AS r, len(embedding) // {parts} AS w,
    list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT r, p, w, v[p * w + 1 : (p + 1) * w] AS x FROM kept, range({parts}) t(p)),
c0 AS MATERIALIZED (SELECT p, r - 1 AS e, x FROM parts WHERE r <= {entries})"""]
    for k in range(rounds + 1):
        steps.append(f"""
a{k} AS MATERIALIZED (
  SELECT r, p, any_value(x) AS x, arg_min(e, d * {entries} + e) AS e, min(d) AS d FROM (
    SELECT q.r, q.p, q.x, c.e, list_sum(list_transform(range(1, q.w + 1), lambda i: (q.x[i] - c.x[i]) * (q.x[i] - c.x[i]))) AS d
    FROM parts q JOIN c{k} c ON q.p = c.p) GROUP BY r, p)""")
        if k < rounds:
            steps.append(f"""
m{k} AS MATERIALIZED (
  SELECT p, e, list(m ORDER BY i) AS x FROM (
    SELECT p, e, i, CAST(floor(CAST(sum(x[i]) AS DOUBLE) / count(*)) AS BIGINT) AS m
    FROM a{k}, (SELECT unnest(range(1, (SELECT max(w) FROM parts) + 1)) AS i) GROUP BY p, e, i) GROUP BY p, e),
c{k + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN m{k} m ON c.p = m.p AND c.e = m.e)""")
    steps.append(f"""
found AS (SELECT r, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r),
sums AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM kept JOIN found USING (r) GROUP BY label)
SELECT k.vec_id, f.code, f.error, s.label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM c{rounds}) AS codebooks_sha256
FROM kept k JOIN found f USING (r) JOIN sums s ON s.label IS NOT DISTINCT FROM k.label""")
    return ",".join(steps[:-1]) + "," + steps[-1]


ORACLE_SQL = _oracle()
