"""Vector codes against the plain rounds, and that a round compares no more than it must."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from toolweave.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int"


def _brute(rows, parts, entries, rounds):
    """Plain Python: codes, errors and entries."""
    kept = [(i, v) for i, v, _ in rows if v and all(x is not None and math.isfinite(x) and abs(x) < vc.LARGEST for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-max(len(v) for _, v in kept) // parts) * parts
    w = width // parts
    whole = [[math.floor(1024 * x) for x in v] + [0] * (width - len(v)) for _, v in kept]
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for v in whole]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [[min(range(len(books[p])), key=lambda e: (gap(v[p], books[p][e]), e)) for p in range(parts)] for v in cut]
    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [v[p] for v, c in zip(cut, codes) if c[p] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine)]
    codes = assign()
    return sorted((i if i is not None else -1, bytes(c), sum(gap(v[p], books[p][c[p]]) for p in range(parts))) for (i, _), v, c in zip(kept, cut, codes)), books


def _rows(n, dim, seed, grid=None):
    rng = random.Random(seed)
    value = lambda: rng.choice(grid) if grid else float(np.float32(rng.gauss(0, 0.2)))
    return [(i, [value() for _ in range(dim)], rng.choice([0, 1, None])) for i in range(n)]


@pytest.mark.parametrize("rows", [
    _rows(300, 8, 1),
    _rows(300, 8, 2, grid=[-0.001, 0.0, 0.001, 0.5]),  # ties everywhere
    _rows(20, 8, 3),  # fewer vectors than entries
    _rows(120, 8, 4, grid=[-100_000.0, 3.0, 100_000.0]),  # beyond what doubles hold exactly
], ids=["plain", "ties", "few", "large"])
def test_against_plain_rounds(spark, rows):
    made, books = vc.train(spark.createDataFrame(rows, SCHEMA).repartition(3), parts=4, entries=40, rounds=4)
    want, entries = _brute(rows, 4, 40, 4)
    assert sorted((r.vec_id, bytes(r.code), r.error) for r in made.collect()) == want
    assert [e.tolist() for e in books.entries] == entries


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None, 1), (2, [], 1), (3, [1.0, None, 0.0, 0.0], 1), (4, [nan, 0.0, 0.0, 0.0], 1), (5, [0.0, -inf, 0.0, 0.0], 1), (6, [1e30, 0.0, 0.0, 0.0], 1)]
    good = [(7, [0.5], 2), (7, [0.25, 0.5, 0.125, 0.0, -0.75], None), (7, [0.5], 2), (None, [0.1, 0.2, 0.3, 0.4], None), (8, [40.0, 0.0, 0.0, 0.0], 2)]
    df = spark.createDataFrame(odd + good, SCHEMA).withColumns({"code": F.lit("x"), "__x": F.lit(1)})
    made, books = vc.train(df, keep=("label",), entries=2, rounds=2)
    want, entries = _brute(odd + good, 4, 2, 2)
    assert sorted((r.vec_id if r.vec_id is not None else -1, bytes(r.code), r.error) for r in made.collect()) == want
    assert [e.tolist() for e in books.entries] == entries and books.width == 8
    none, nothing = vc.train(df.limit(0), keep=("label",))
    assert none.columns == ["vec_id", "label", "code", "error"] and none.count() == 0 and nothing is None


def test_active_entries_only():
    rng = np.random.default_rng(0)
    x, e = rng.integers(-50, 50, (500, 4)), rng.integers(-50, 50, (32, 4))
    code, dist = vc.nearest(x, e)
    moved = np.zeros(32, bool)
    moved[[3, 9]] = True
    e2 = e.copy()
    e2[moved] += 1
    new, d, compared = vc.reassign(x, code, dist, e2, moved)
    want, wd = vc.nearest(x, e2)
    assert (new == want).all() and (d == wd).all()
    active = int(moved[code].sum())
    assert compared == active * 32 + (500 - active) * 2
    assert vc.reassign(x, code, dist, e, np.zeros(32, bool))[2] == 0


def test_sums_of_labels(spark, monkeypatch):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else i % 3, i) for i in range(60)], "i long, label int, error long")
    want = sorted((r.i, r.s) for r in vc.with_sum(rows, "label", "error", "s").collect())
    assert dict(want)[0] == sum(range(0, 60, 3))
    monkeypatch.setattr(vc, "BROADCAST_BYTES", 0)
    assert sorted((r.i, r.s) for r in vc.with_sum(rows, "label", "error", "s").collect()) == want
