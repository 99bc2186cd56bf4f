"""Fill-in-the-middle: the rank index against the true boundaries, outputs against a plain cut, and the way back."""

import random

import pytest
from pyspark.sql import functions as F

from toolweave.llm import fill_middle as fm

CHARS = ["a", " ", "\n", "é", "ß", "語", "😀", "́"]


def _text(rng, n):
    return "".join(rng.choice(CHARS[: rng.choice((1, 3, 8))]) for _ in range(n))


def _cuts(text, unit):
    if unit == "codepoint":
        return list(range(len(text) + 1))
    at = [0] if text else []
    for i in range(1, len(text)):
        here, last = text[i], text[i - 1]
        if last == "\n" if unit == "line" else last in " \n" and here not in " \n":
            at.append(i)
    return [*at, len(text)]


@pytest.mark.parametrize("unit", ["codepoint", "word", "line"])
@pytest.mark.parametrize("error", [0, 2, 32])
def test_every_boundary_is_exact(unit, error):
    rng = random.Random(5)
    for n in (0, 1, 2, 50, 5000):
        text = "".join(_text(rng, 1 + n // 5) for _ in range(5))[:n]
        index = fm.RankIndex(text.encode(), unit, error)
        want = [len(text[:i].encode()) for i in _cuts(text, unit)]
        assert [index.offset(r) for r in range(index.n + 1)] == want
        assert all(abs(index.predict(r) - want[r]) <= error + 1 for r in range(index.n + 1))


def test_one_segment_where_characters_have_one_width():
    assert len(fm.RankIndex(b"x" * 100_000).first) == 2  # and the end of the text
    assert len(fm.RankIndex(("é" * 100_000).encode()).first) == 2


def test_blocks_of_a_long_text(monkeypatch):
    monkeypatch.setattr(fm, "BLOCK", 64)
    text = _text(random.Random(1), 3000)
    for unit in ("codepoint", "word", "line"):
        index = fm.RankIndex(text.encode(), unit)
        assert [index.offset(r) for r in range(index.n + 1)] == [len(text[:i].encode()) for i in _cuts(text, unit)]


ROWS = [
    (0, None), (1, ""), (2, " \n"), (3, "a <P> b"), (4, "a<S"), (5, "><M"), (6, "x" * 300_000), (6, "x" * 300_000),
    (None, "no id"), *[(i, _text(random.Random(i), i)) for i in range(7, 207)],
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string")


def test_against_a_plain_cut(docs):
    made = fm.fill_in_middle(docs).withColumn("back", fm.restore(F.col("output"), F.col("form"))).collect()
    assert len(made) == len(ROWS)
    forms = set()
    for r in made:
        text = r.text or ""
        forms.add(r.form)
        assert r.n == len(text) and r.back == text
        h1, h2, h3, h4 = fm.draws(1, r.doc_id)
        if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
            assert (r.form, r.output, r.prefix_units, r.middle_units) == ("plain", text, None, None)
            continue
        a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
        assert (r.prefix_units, r.middle_units) == (a, b - a)
        spm = f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
        assert r.output == (spm if h4 % 100 < 20 else f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}")
    assert forms == {"plain", "psm", "spm"}


def test_clashing_columns_units_and_empty_table(docs):
    odd = docs.withColumns({"N": F.lit("x"), "output": F.lit("x"), "Form": F.lit("x")})
    made = fm.fill_in_middle(odd, unit="word", plain_percent=0, spm_percent=100)
    assert [c.lower() for c in made.columns] == ["doc_id", "text", "n", "form", "prefix_units", "middle_units", "output"]
    rows = made.withColumn("back", fm.restore(F.col("output"), F.col("form"))).collect()
    assert all(r.back == (r.text or "") for r in rows) and {r.form for r in rows} == {"plain", "spm"}
    assert fm.fill_in_middle(docs.limit(0)).count() == 0
