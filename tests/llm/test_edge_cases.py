"""Nulls, empty and long texts, ties and repeated rows, empty tables and clashing columns, operator by operator."""

import random
from pyspark.sql import functions as F

import pytest

from toolweave.llm import decontaminate, html_text, language, licenses, mixing, ngram_join, quality, substring_dedup, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i}" for i in range(30_000))
ROWS = [
    (0, None, None, None, None),
    (1, "", "en", "", 0),
    (2, " \n\t ", "en", "a.com", 4),
    (3, LONG, "en", "a.com", len(LONG)),
    (3, LONG, "en", "a.com", len(LONG)),
    (4, "one two three", "en", "b.org", 13),
    (5, "one two three", "fr", "b.org", 13),
    (None, "one two three", None, None, 13),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def clashing(odd):
    names = ("N_WORDS", "kept_text", "kept", "labels", "size", "component_id", "host", "contaminated")
    return odd.withColumns({n: F.lit("x") for n in names})


def test_quality(odd, clashing):
    rows = quality.judge(odd).collect()
    assert len(rows) == len(ROWS)
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert (by[0].n_words, by[0].kept, by[0].kept_text) == (0, False, "")
    assert (by[3].n_words, by[3].n_repeat_words) == (30_000, 0)
    made = quality.judge(clashing)
    assert [c.lower() for c in made.columns].count("n_words") == 1 and made.count() == len(ROWS)
    assert quality.judge(odd.limit(0)).count() == 0


def test_quality_windows(spark):
    text = "a b c d e f a b c d e g " * 1 + "h i j k l m n o p q"
    row = quality.judge(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.n_repeat_words == 10


def test_decontaminate(spark, odd, clashing):
    bench = spark.createDataFrame([(1, "One two three"), (2, None), (3, ""), (None, "w5 w6"), (1, "one two three")], "item_id long, text string")
    by = {(r.doc_id, r.n_hit, tuple(r["items"]), r.contaminated) for r in decontaminate.find(odd, bench).collect()}
    assert (4, 3, ("1",), True) in by and (3, 2, ("null",), False) in by and (0, 0, (), False) in by
    assert decontaminate.find(clashing, bench).count() == len(ROWS)
    assert decontaminate.find(odd, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.find(odd.limit(0), bench).count() == 0


def test_decontaminate_in_blocks(spark):
    rng = random.Random(3)
    words = [f"v{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice((2, 3, 13, 15))))) for i in range(30)]
    docs = [(i, " ".join([rng.choice(words) for _ in range(40)] + (items[i % 30][1].split() if i % 3 else []) + ["z"])) for i in range(60)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")

    def brute(text):
        w, hit, found = text.split(), set(), set()
        for k, item in items:
            v = item.split()
            n = min(13, len(v))
            for a in range(len(v) - n + 1):
                for at in range(len(w) - n + 1):
                    if w[at : at + n] == v[a : a + n]:
                        hit.update(range(at, at + n))
                        found.add(str(k))
        return len(hit), sorted(found)

    want = {i: brute(t) for i, t in docs}
    for most in (10_000, 50):
        assert {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.find(d, b, block_windows=most).collect()} == want


def test_tables_of_several_blocks_are_built_once_a_task(spark, odd, clashing):
    b = spark.createDataFrame([(k, " ".join(f"b{k}x{i}" for i in range(60))) for k in range(8)], "item_id long, text string")
    d = spark.range(0, 6000, 1, 2).select(F.col("id").alias("doc_id"), F.concat(F.lit("q "), F.when(F.col("id") % 3 == 0, " ".join(f"b1x{i}" for i in range(20))).otherwise("r")).alias("text"))
    built = spark.sparkContext.accumulator(0)
    found = decontaminate.find(d, b, block_windows=120, built=built)
    before = built.value
    rows = found.collect()
    blocks = -(-8 * 48 // 120)
    assert 0 < built.value and before <= 2 * 4 * blocks and built.value - before <= 2  # two tasks a block, three batches a task
    assert {r.n_hit for r in rows if r.doc_id % 3 == 0} == {20} and {r.n_hit for r in rows if r.doc_id % 3} == {0} and len(rows) == 6000
    few = decontaminate.find(clashing, b, block_windows=50)
    assert few.count() == odd.count() and not any(r.contaminated for r in few.collect())


def _words(rng, n, kinds):
    return [f"{rng.choice('abcdefgh')}{rng.randrange(kinds)}" for _ in range(n)]


def test_substrings_against_brute_force(spark):
    rng = random.Random(5)
    passage, other = _words(rng, 40, 50), _words(rng, 20, 50)
    docs = []
    for i in range(60):
        w = _words(rng, rng.randrange(5, 60), 40)
        if i % 2:
            w = w + passage[rng.randrange(10) : rng.randrange(25, 40)] + _words(rng, 5, 40)
        if i % 5 == 0:
            w = other + w + other
        docs.append((i, " ".join(w)))
    docs += [(61, "x " * 50), (62, "x " * 60), (7, docs[7][1]), (None, docs[3][1]), (63, None)]
    owners = {}
    for i, t in docs:
        w = (t or "").split()
        for a in range(len(w) - 12):
            if i is not None:
                owners[tuple(w[a : a + 13])] = min(i, owners.get(tuple(w[a : a + 13]), i))
    want = []
    for i, t in docs:
        w = (t or "").split()
        gone = {p for a in range(len(w) - 12) if i is not None and owners[tuple(w[a : a + 13])] < i for p in range(a, a + 13)}
        want.append((i, len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for hot in (1, 64):
        got = [(r.doc_id, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(df, hot_strings=hot).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_substrings_odd(odd, clashing):
    assert substring_dedup.remove_repeats(odd).agg(F.sum("n_removed")).first()[0] == 0  # equal ids don't remove each other
    assert substring_dedup.remove_repeats(clashing).count() == len(ROWS)
    assert substring_dedup.remove_repeats(odd.limit(0)).count() == 0


def test_layout_stays(spark):
    words = [f"q{i}" for i in range(20)]
    docs = [(1, "\n".join(words)), (2, "head\n" + "\n".join(words) + "\ntail  end\n")]
    got = {r.doc_id: r.kept_text for r in substring_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), layout=True).collect()}
    assert got == {1: docs[0][1], 2: "head\ntail  end\n"}


def _brute_components(docs, words, percent):
    sets = {}
    for i, t in docs:
        w = (t or "").lower().split()
        n = min(words, len(w))
        sets[i] = {tuple(w[a : a + n]) for a in range(len(w) - n + 1)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("hot", [2, 6, 48])
def test_join_against_brute_force(spark, monkeypatch, hot):
    rng = random.Random(hot)
    base = [_words(rng, rng.randrange(8, 60), 30) for _ in range(6)]
    passage = _words(rng, 12, 30)
    docs = []
    for i in range(120):
        w = list(base[i % 6])
        for _ in range(rng.choice((0, 0, 1, 1, 2, 3))):
            w[rng.randrange(len(w))] = f"e{rng.randrange(1000)}"
        if i % 4 == 0:
            w = w + passage
        docs.append((i, " ".join(w)))
    docs += [(200, None), (201, ""), (202, "A b"), (203, "a B"), (204, " ")]
    monkeypatch.setattr(ngram_join, "HOT_COUNT", hot)
    monkeypatch.setattr(ngram_join.hot_tokens, "__defaults__", (hot, ngram_join.HOT_TOKENS))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc: (r.n_shingles, r.component_id) for r in ngram_join.linked(df).collect()}
    assert got == _brute_components(docs, 4, 85)


def test_join_odd(odd, clashing):
    by = {r.doc_id: r.component_id for r in ngram_join.join(odd).collect()}
    assert by == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 4, None: 4}
    assert ngram_join.join(clashing).count() == len(ROWS)
    kept = ngram_join.keep_one(odd)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 4] and kept.columns == odd.columns
    assert ngram_join.join(odd.limit(0)).count() == 0


def test_mixing(spark, odd):
    rows = mixing.schedule(odd).collect()
    assert len(rows) == len(ROWS) and all(r.taken <= 2 * r.size for r in rows)
    assert mixing.mixed(odd.limit(0)).count() == 0
    rng = random.Random(1)
    docs = [(i, " ".join("x" * rng.randrange(1, 40)), f"s{i % 7 if i % 3 else 0}") for i in range(3000)]
    docs = [(i, t, s if i % 50 else None) for i, t, s in docs]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = mixing.schedule(df, bucket_bits=3)
    sums = {r.source: r for r in got.groupBy("source").agg(F.sum("size").alias("size"), F.first("source_size").alias("s"), F.first("target").alias("t"), F.sum("taken").alias("taken")).collect()}
    names = sorted(x for x in sums if x is not None) + [None]
    weights = {n: (3, 1, 2)[k % 3] for k, n in enumerate(names)}
    left, caps, want, open_ = 1.5 * sum(r["size"] for r in sums.values()), {n: 2 * sums[n]["size"] for n in names}, {}, set(names)
    while open_:
        share = {n: left * weights[n] / sum(weights[m] for m in open_) for n in open_}
        full = {n for n in open_ if share[n] > caps[n]}
        if not full:
            want |= share
            break
        for n in full:
            want[n] = caps[n]
            left -= caps[n]
        open_ -= full
    for n in names:
        assert sums[n].s == sums[n]["size"] and abs(sums[n].t - want[n]) < 1e-6 * want[n] and abs(sums[n].taken - want[n]) <= 1
    times = [r.first_at for r in got.collect() if r.first_at is not None]
    assert all(0 <= t <= 1 for t in times)
    again = {(r.doc_id, r.taken, r.first_at) for r in mixing.schedule(df.repartition(7), bucket_bits=3).collect()}
    assert again == {(r.doc_id, r.taken, r.first_at) for r in got.collect()}


def test_licenses(odd, clashing):
    assert licenses.scan(clashing).count() == len(ROWS) and licenses.scan(odd.limit(0)).count() == 0
    n, base, first, last, base_labels, labels, score, expressions, permissive = licenses.scan_text(
        b"Released under the MIT License. Under the MIT license, CC-BY-NC 4.0\n// SPDX-License-Identifier: (GPL-2.0-only OR Apache-2.0) AND MIT WITH some-exception\n")
    assert (base, first, last, base_labels, labels) == (3, 1, 9, "cc-by-nc,mit", "apache-2,cc-by-nc,gpl,mit")
    assert permissive is False and 0 < score <= 1 and len(expressions) == 1
    assert licenses.scan_text(None)[:7] == (0, 0, None, None, "", "", 0.0)
    assert licenses.evaluate(licenses.postfix("MIT OR GPL-3.0+")) == (True, {"mit", "gpl"})
    assert licenses.evaluate(licenses.postfix("MIT OR GPL-3.0 AND GPL-2.0"))[0] is True  # and binds closer
    assert all(licenses.postfix(x) is None for x in ("", "MIT OR", "(MIT", "MIT)", "MIT MIT", "AND MIT", "MIT ! GPL"))
    phrase = licenses.scan_text(b"apache license version 2 0 cc by nc under the mit license")
    assert (phrase[1], phrase[2], phrase[3]) == (3, 0, 8)


def test_language(spark, odd, clashing):
    rows = {r.doc: r for r in language.identify(odd).collect()}
    assert len(rows) == 7 and not rows[0].kept and not rows[1].kept and rows[0].language == "und"
    assert language.identify(clashing).count() == len(ROWS) and language.identify(odd.limit(0)).count() == 0
    assert language.identify(odd.withColumn("lang", F.lit(None).cast("string"))).where("kept").count() == 5


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(4)) == 0
    blind = docs.withColumn("truth", F.when(held, F.col("lang"))).withColumn("lang", F.when(~held, F.col("lang")))
    got = language.identify(blind).join(blind.where("truth is not null").select(F.col("doc_id").alias("doc"), "truth"), "doc")
    right, kept, n = got.agg(F.avg((F.col("language") == F.col("truth")).cast("int")), F.avg(F.col("kept").cast("int")), F.count("*")).first()
    assert n > 150 and right > 0.97 and kept > 0.97


def test_urls(spark):
    pages = spark.createDataFrame([(1, "http://A.example.com/en/x?q#f"), (2, "https://www.example.com/en/"), (3, "nothing"), (4, None), (5, "x://h.net/fr/"),
                                   (6, "http://example.com?x"), (7, "http://bad.org/1"), (8, "http://bad.org/2"), (9, "http://good.org/"), (7, "http://bad.org/1")], "page_id long, url string")
    bad = spark.createDataFrame([(7, True), (8, True), (9, False), (None, True), (99, True)] + [(7, True)] * 20 + [(9, False)] * 20, "id long, bad boolean")
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages.withColumn("HOST", F.lit(1)), bad).collect()}
    assert by[1] == ("a.example.com", "/en/x", "example.com/en/", "block") and by[2] == ("www.example.com", "/en/", "www.example.com/en/", "allow")
    assert by[3] == ("", "", None, "allow") and by[4] == ("", "", None, "allow") and by[5][2:] == ("net/fr/", "block") and by[6] == ("example.com", "", None, "allow")
    assert by[7][3] == "block" and by[9][3] == "allow"
    assert url_filter.judge(pages.limit(0), bad).count() == 0 and url_filter.judge(pages, bad.limit(0)).count() == 10


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="page-with-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div><article class="post"><h1>A &amp; B</h1><p>One <b>two<br>three</b>&nbsp; four<p>five <a href=x>six</a> seven</p>
<div class="ad-slot"><p>Buy</p></div><script>var t="</p>";</script><!-- no --><ul><li>i<li>ii</ul><aside>side</aside><section id="comments"><p>Nice post</p></section></article>
<form>Mail <input> <button>Go</button></form><footer>&copy; me"""


def test_html(spark):
    assert html_text.main_text(PAGE) == "A & B\n\nOne two three four\n\nfive six seven\n\ni\n\nii"
    assert html_text.main_text(None) == "" == html_text.main_text("") == html_text.main_text("<nav>x</nav>")
    assert html_text.main_text("<div><p>plain page text here</p><div class=sidebar>no</div></div>") == "plain page text here"
    assert html_text.main_text('<article><p>a <span class="ad">Buy</span> b<article class="comment">c</article></article><p>d') == "a b"
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None)], "page_id long, url string, html string").withColumn("TEXT", F.lit(1))
    assert [r.n_chars for r in html_text.extract(df).orderBy("page_id").collect()] == [48, 0]
    for has in (0, 1):
        for inside in (0, 1):
            assert not html_text.decide(html_text.TREE, (50, 0.0, 30, 0.0, 30, 0.0, inside, 1, has))
    assert all(html_text.decide(html_text.TREE, (w, 0.0, b, l, 9, 0.0, 1, 0, 1)) for w in (1, 5, 500) for b in (0, 3, 80) for l in (0.0, 1.0))


def test_unrelated_documents_of_one_id_stay(spark):
    """Null ids, and one id of two texts: only what is linked is one group."""
    rows = [(None, "alpha beta gamma delta epsilon zeta"), (None, "one two three four five six seven"), (7, "red green blue cyan pink grey"), (7, "north south east west up down"), (8, "red green blue cyan pink grey"), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r.doc_id or 0, r.text) for r in ngram_join.keep_one(docs).collect())
    assert kept == sorted((i or 0, t) for i, t in rows if i != 8)
