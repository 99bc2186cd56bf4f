"""Personal data: base spans against plain patterns, estimated reliabilities, planted spans, clean text."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from toolweave.llm import personal_data as pd

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _plain(text):
    """The base rules as they are written down."""
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            odd = [int(d) for d in digits[::-1]]
            luhn = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(odd)) % 10 == 0
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 12 <= len(digits) <= 19 and luhn or kind == "phone" and 9 <= len(digits) <= 15:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], list(PLAIN).index(s[0]), s[2]))


@pytest.mark.parametrize("alphabet", ["a@.-% b", "1.0 2", "0123456789 -", "+1 ().-9", "a1@.+- é😀٣", "@a.b"])
def test_base_spans_are_the_plain_matches(alphabet):
    rng = random.Random(alphabet)
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        assert pd.base_spans(text) == _plain(text), text


def test_long_texts_take_time_in_proportion():
    for piece in ("a", "1", "1.", "a.", "+1(", "a@a.", "1 ", "token=", "Mr. A", "DE12 ", "a@"):
        times = []
        for n in (20_000, 160_000):
            began = time.process_time()
            pd.all_spans(piece * (n // len(piece)))
            times.append(time.process_time() - began)
        assert times[1] < 40 * max(times[0], 0.005), piece


def test_reliabilities_are_recovered():
    rng = np.random.default_rng(1)
    true = rng.random(40_000) < 0.3
    right = np.array([0.95, 0.9, 0.8, 0.75, 0.7, 0.6])
    says = np.where(rng.random((40_000, 6)) < right, true[:, None], ~true[:, None])
    votes = np.where(rng.random((40_000, 6)) < 0.2, 0, np.where(says, pd.YES, pd.NO))
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    p, share, table = pd.reliabilities(patterns, n)
    assert abs(share - 0.3) < 0.02
    for j, r in enumerate(right):
        assert abs(table[1, j, pd.YES] / (table[1, j, 1:].sum()) - r) < 0.03
    at = {tuple(v): x for v, x in zip(patterns, p)}
    odds = np.log(0.3 / 0.7) + (np.where(votes == pd.YES, 1, np.where(votes == pd.NO, -1, 0)) * np.log(right / (1 - right))).sum(1)
    best = np.mean((odds > 0) == true)  # with the true rates, which nobody tells
    assert np.mean([(at[tuple(v)] > 0.5) == t for v, t in zip(votes, true)]) > best - 0.003


def _corpus():
    """(text, added spans that must be found, text of which none may be)"""
    rng = random.Random(9)
    words = "the of lation entre sur haben über más ciones and".split()
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, planted = [], {}
    for i in range(400):
        text, want = prose(30), set()
        if i % 4 == 0:
            key = "".join(rng.choice("0123456789abcdef") for _ in range(40))
            text += f' token = "{key}" ' + prose(5)
            want.add(("secret", key))
        if i % 4 == 1:
            text += " password: changeme, version 1.2.3, order 555-12-000 " + prose(4)
        if i % 8 == 2:
            text += f" mail {rng.choice(words[:2])}{i}@mail.example.com or call (743) 555-{rng.randint(1000, 9999)} "
            want.add(("local_phone", text[text.index("(743)") :].strip()))
        if i % 8 == 6:
            text += f" SSN 2{i % 90 + 10}-45-678{i % 10} "
            want.add(("national_id", f"2{i % 90 + 10}-45-678{i % 10}"))
        rows.append((i, text))
        planted[i] = want
    return rows, planted


def test_planted_spans_are_added_and_clean_text_is_left(spark):
    rows, planted = _corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    text = dict(rows)
    got = {r.doc_id: r for r in pd.find(docs).collect()}
    base = {i: {tuple(s)[:3] for s in r.base_spans} for i, r in got.items()}
    for i, r in got.items():
        assert base[i] == set(_plain(text[i])) and base[i] <= {tuple(s)[:3] for s in r.all_spans}
    added = {i: {(s.kind, text[i][s.start : s.stop]) for s in r.all_spans if tuple(s)[:3] not in base[i]} for i, r in got.items()}
    found = sum(len(added[i] & planted[i]) for i in planted)
    assert found >= 0.95 * sum(map(len, planted.values()))
    assert sum(len(added[i] - planted[i]) for i in planted) <= 0.02 * len(rows)
    assert not any(v for i in planted if i % 4 == 3 for v in added[i])


def test_the_same_score_on_both_sides(spark):
    rows, _ = _corpus()
    found = pd.candidates(spark.createDataFrame(rows, "doc_id long, text string"))
    model = pd.train(found)
    got = found.select(F.explode("__spans.number").alias("x")).distinct().withColumn("s", model.score(F.col("x"))).collect()
    assert np.allclose(1 / (1 + np.exp(-np.array([r.s for r in got]))), model.probability(np.array([r.x for r in got])))


ODD = [(0, None), (1, ""), (2, " \n"), (3, "x@y.zz " * 3000), (3, "x@y.zz " * 3000), (None, "😀 a@b.cc +1 (743) 555-3824"), (4, "1" * 50_000)]


def test_odd_rows(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"N_EMAIL": F.lit("x"), "all_spans": F.lit("x"), "kind": F.lit("x")})
    made = pd.find(docs)
    assert [c.lower() for c in made.columns] == ["doc_id", "kind", *pd.OUT]
    rows = made.collect()
    assert sorted(r.n_email for r in rows) == [0, 0, 0, 0, 1, 3000, 3000]
    last = next(r for r in rows if r.doc_id is None)
    assert [(s.kind, s.start, s.stop) for s in last.base_spans] == [("email", 2, 8), ("phone", 9, 26)]
    assert pd.find(docs.limit(0)).count() == 0


def test_redacted_text(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("all_spans", F.lit(1))
    model = pd.train(pd.candidates(docs))
    made = pd.redact(docs, model)
    assert made.columns == docs.columns
    got = {r.doc_id: r.text for r in made.collect()}
    assert got[None] == "😀 [EMAIL] [PHONE]" and got[0] is None and got[1] == "" and got[3] == "[EMAIL] " * 3000
