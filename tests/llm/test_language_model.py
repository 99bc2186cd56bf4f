"""The language model: rejection and labels do not depend on how much text a label has."""

import random

from pyspark.sql import functions as F

from toolweave.llm import language

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _docs(spark, rows):
    return spark.createDataFrame([(k, t, lang, "a.com", len(t)) for k, (t, lang) in enumerate(rows)], SCHEMA)


def _junk(rng, n=400):
    return "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(n))


def test_one_row_label_does_not_take_junk(spark):
    rng = random.Random(3)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    letters = "abcdefghijklmnopqrstuvwxyz"
    junk = [_junk(rng) for _ in range(10)] + ["".join(rng.choice(letters) for _ in range(600)) for _ in range(10)]
    rare = "kaksi vanhaa taloa seisoi meren rannalla ja tuuli puhalsi kovaa koko pitkän yön"
    made = docs.unionByName(spark.createDataFrame([(-1, rare, "fi", "z.fi", len(rare))] + [(-2 - k, t, None, None, len(t)) for k, t in enumerate(junk)], SCHEMA))
    got = {r.doc: r for r in language.identify(made).where("doc < 0").collect()}
    assert got[-1].language == "fi" and not any(got[-2 - k].kept for k in range(len(junk)))
    small = docs.limit(20).unionByName(made.where("doc_id < 0"))
    assert not any(r.kept for r in language.identify(small).where("doc < -1").collect())


def test_variants_are_one_language(spark):
    texts = {"en": "the old house stood by the sea and the wind blew hard", "de": "das alte haus stand am meer und der wind wehte stark"}
    variants = [("en", v) for v in ("en", "EN", "en-US", "en_us", " en_US.UTF-8 ")] + [("de", v) for v in ("de", "de-AT", "DE")] + [("en", "")]
    got = {r.doc: (r.language, r.declared) for r in language.identify(_docs(spark, [(texts[t], v) for t, v in variants])).collect()}
    assert got == dict(enumerate(variants))
    assert language.languages_of(_docs(spark, [("x", "i-klingon"), ("x", "I-Klingon"), ("x", None), ("x", " ")]), "lang") == [("i-klingon", 2)]


def test_more_languages_than_are_held_at_once(spark):
    rng = random.Random(5)
    rows = []
    for n in range(language.AT_ONCE + 5):
        letters = [chr(0x4E00 + 60 * n + k) for k in range(20)]
        rows += [(" ".join("".join(rng.choice(letters) for _ in range(4)) for _ in range(30)), f"{chr(97 + n // 26)}{chr(97 + n % 26)}") for _ in range(2 if n < language.AT_ONCE else 1)]
    got = language.identify(_docs(spark, rows)).collect()
    assert len(got) == len(rows) and all(r.language == r.declared for r in got)


def test_fused_posterior_by_hand(spark):
    """Text, declared value, host and suffix put together in plain Python, from the same text model."""
    import math
    import random

    rng = random.Random(6)
    words = {"en": "the and of this that with have".split(), "fr": "les des une dans pour avec sont".split(), "de": "der die und nicht ein auch sich".split()}
    rows = []
    for i in range(90):
        real = rng.choice(list(words))
        declared = rng.choice([real, real, real.upper() + "-XX", None, rng.choice(list(words))])
        host = rng.choice(["a.de", "b.de", "c.fr", "plain", None])
        rows.append((i, " ".join(rng.choice(words[real] + words["en"][:1]) for _ in range(rng.randint(0, 9))), declared, host))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc: r for r in language.identify(docs).collect()}

    names = [n for n, _ in language.languages_of(docs, "lang")]
    model = language.train(docs, language.languages_of(docs, "lang"), "doc_id", "text", "lang")
    lls = {i: [float(m[language.pieces(t.encode())].astype(float).sum()) for m in model] if t else [0.0] * len(names) for i, t, _, _ in rows}
    size = {i: len(language.pieces(t.encode())) if t else 0 for i, t, _, _ in rows}
    guess = {i: max(range(len(names)), key=lambda k: (lls[i][k], -k)) for i, n in size.items() if n}
    tag = {i: d and d.lower().split("-")[0] for i, _, d, _ in rows}
    host = {i: (h or "").lower() for i, _, _, h in rows}
    suffix = {i: h.rpartition(".")[2] if "." in h else "" for i, h in host.items()}
    count = lambda of: [float(sum(1 for i in guess if of(i) and guess[i] == k)) for k in range(len(names))]
    total = count(lambda i: True)
    shrink = lambda c, above: [(x + language.PRIOR_ROWS * p) / (sum(c) + language.PRIOR_ROWS) for x, p in zip(c, above)]
    overall = [(c + 1) / (sum(total) + len(names)) for c in total]
    for i, n in size.items():
        r = got[i]
        if not n:
            assert (r.language, r.kept) == ("und", False)
            continue
        prior = shrink(count(lambda j: host[j] == host[i]), shrink(count(lambda j: suffix[j] == suffix[i]), overall))
        given = [1.0] * len(names)
        if tag[i]:
            c = count(lambda j: tag[j] == tag[i])
            given = [(x + language.PRIOR_ROWS * sum(c) / max(1.0, sum(total))) / (t + language.PRIOR_ROWS) for x, t in zip(c, total)]
        logs = [language.TEMPER * l + math.log(p) + math.log(g) for l, p, g in zip(lls[i], prior, given)]
        confidence = 1 / sum(math.exp(x - max(logs)) for x in logs)
        assert abs(r.confidence - confidence) < 1e-4, (i, r, confidence)
        kept = max(lls[i]) / n >= language.FLOOR and confidence >= language.LEAST
        assert r.kept == kept and r.language == (names[logs.index(max(logs))] if kept else "und")
