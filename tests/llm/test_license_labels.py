"""Labels of the licence scan against a plain search, and expressions against the trees they were written from."""

import random

from pyspark.sql import functions as F

from toolweave.llm import licenses

IDS = ["MIT", "GPL-3.0-only", "Apache-2.0", "CC0-1.0", "ISC", "LGPL-2.1-or-later"]
NAMES = {"MIT": "mit", "GPL-3.0-only": "gpl", "Apache-2.0": "apache-2", "CC0-1.0": "cc0", "ISC": "isc", "LGPL-2.1-or-later": "lgpl"}


def _tree(rng, depth):
    """(text, binding strength, allowed, labels) of a random expression."""
    if depth == 0 or rng.random() < 0.3:
        name = rng.choice(IDS)
        return name, 4, NAMES[name] in licenses.PERMISSIVE, {NAMES[name]}
    kind = rng.choice(["or", "and", "AND", "with"])
    if kind == "with":
        name = rng.choice(IDS)
        return f"{name} WITH Classpath-exception-2.0", 3, NAMES[name] in licenses.PERMISSIVE, {NAMES[name]}
    strength = licenses.BINDS[kind.lower()]
    a, b = _tree(rng, depth - 1), _tree(rng, depth - 1)
    put = lambda t: f"({t[0]})" if t[1] < strength or rng.random() < 0.2 else t[0]
    met = a[2] or b[2] if kind == "or" else a[2] and b[2]
    return f"{put(a)} {kind} {put(b)}", strength, met, a[3] | b[3]


def test_expressions_mean_what_their_tree_says():
    rng = random.Random(3)
    for _ in range(2000):
        text, _, met, labels = _tree(rng, 4)
        assert licenses.evaluate(licenses.postfix(text)) == (met, labels), text
    for bad in ("", "MIT or", "(MIT", "MIT)", "MIT Apache-2.0", "and MIT", "MIT or (and)", "()"):
        assert licenses.postfix(bad) is None, bad


def test_labels_against_a_plain_search(spark):
    rng = random.Random(5)
    phrases = {**licenses.NOTICES, **licenses.BASE}
    parts = sorted({w for p in phrases for w in p.split()}) + ["é", "x9"]

    def text():
        out = []
        for _ in range(rng.randrange(0, 60)):
            out.append(rng.choice(list(phrases)) if rng.random() < 0.2 else rng.choice(parts))
        words = " ".join(out).split(" ") if out else []
        return "".join((w.upper() if rng.random() < 0.3 else w) + rng.choice([" ", "  ", "\n", ", ", "-"]) for w in words)

    def brute(t):
        words, word = [], ""
        for ch in t + " ":
            ch = ch.lower() if "A" <= ch <= "Z" else ch
            if ch.isascii() and not ch.isalnum():
                words, word = words + [word] * bool(word), ""
            else:
                word += ch
        places, base, every = [], set(), set()
        for phrase, label in phrases.items():
            p = phrase.split()
            at = [i for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
            if at:
                every.add(label)
            if at and phrase in licenses.BASE:
                base.add(label)
                places += at
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(every))

    texts = [text() for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    joined = lambda c: F.array_join(c, ",") if dict(found.dtypes)[c].startswith("array") else F.col(c)
    found = licenses.scan(rows)
    got = found.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined("base_labels"), joined("labels")).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == {i: brute(t) for i, t in enumerate(texts)}
