"""The pipeline, stage by stage, against brute force over each stage's own input."""

import re

from pyspark.sql import functions as F

import corpus_pipeline as cp
from toolweave.llm import language
from toolweave.llm.common import table, written

SF = "/root/testdata/sf0.001"


def _components(docs, words, percent):
    sets, root = {}, {}
    for i, t in docs.items():
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split()
        n = min(words, len(w))
        sets[i] = {tuple(w[a : a + n]) for a in range(len(w) - n + 1)} if w else set()
        root[i] = i

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j]) if i < j else 0
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def test_stages(spark):
    docs = table(spark, SF, "documents")
    assert [n for n, _ in cp.STAGES] == ["language_id", "ngram_jaccard", "substring_dedup", "decontamination", "mixing"]

    told = written(cp.language_id(spark, docs, SF), "t1")
    verdicts = {r.doc: r.kept for r in language.identify(docs).collect()}
    assert {r.doc_id for r in told.collect()} == {i for i, k in verdicts.items() if k}
    assert told.columns == docs.columns

    before = {r.doc_id: r.text for r in told.collect()}
    one = written(cp.ngram_jaccard(spark, told, SF), "t2")
    assert {r.doc_id for r in one.collect()} == {i for i, c in _components(before, 5, 80).items() if i == c}
    assert one.columns == docs.columns

    before = {r.doc_id: (r.text or "").split() for r in one.collect()}
    owners = {}
    for i in sorted(before):
        for a in range(len(before[i]) - 12):
            owners.setdefault(tuple(before[i][a : a + 13]), i)
    cut = written(cp.substring(spark, one, SF), "t3")
    for r in cut.collect():
        w = before[r.doc_id]
        gone = {p for a in range(len(w) - 12) if owners[tuple(w[a : a + 13])] < r.doc_id for p in range(a, a + 13)}
        assert r.text.split() == [x for p, x in enumerate(w) if p not in gone] and r.n_chars == len(r.text)
    assert cut.count() == one.count() and cut.columns == docs.columns

    cutter = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: cutter.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for r in table(spark, SF, "benchmark").collect():
        w = words(r.text)
        n = min(13, len(w))
        for a in range(len(w) - n + 1) if w else ():
            windows[tuple(w[a : a + n])] = n
    clean = written(cp.benchmark_decontamination(spark, cut, SF), "t4")
    want = set()
    for r in cut.collect():
        w = words(r.text)
        hit = {p for n in set(windows.values()) for a in range(len(w) - n + 1) if tuple(w[a : a + n]) in windows for p in range(a, a + n)}
        if not hit or 20 * len(hit) < len(w):
            want.add(r.doc_id)
    assert {r.doc_id for r in clean.collect()} == want and clean.columns == docs.columns

    mix = cp.source_mix(spark, clean, SF).collect()
    texts, taken = {r.doc_id: r.text for r in clean.collect()}, {}
    for r in mix:
        w = texts[r.doc_id].split()
        assert r["pass"] in (1, 2) and 0 < r.taken <= r.size == len(w)
        assert r.text == (texts[r.doc_id] if r.taken == r.size else " ".join(w[: r.taken]))
        taken[r.doc_id, r["pass"]] = taken.get((r.doc_id, r["pass"]), 0) + 1
    assert set(taken.values()) == {1}
    assert [r.position for r in mix] == sorted(r.position for r in mix)
    for source in {r.source for r in mix}:
        mine = [r for r in mix if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 1 and mine[0].target <= 2 * mine[0].source_size + 1e-6


ODD = [(None, None, None, None, None), (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, "one two three four five six", "en", "a", 27), (3, "one two three four five six", "en", "a", 27),
       (4, "other words of its own here now", "en", None, 31), (None, "text without an id", "fr", "b", 18), (None, "another text without an id", "fr", "b", 26)]


def test_odd_documents(spark, tmp_path):
    import shutil

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for k, rows in enumerate(([], ODD)):
        folder = tmp_path / f"t{k}"
        folder.mkdir()
        shutil.copy(f"{SF}/benchmark.parquet", folder)
        docs = spark.createDataFrame(rows, schema).withColumns({"N_WORDS": F.lit("x"), "component_id": F.lit("y"), "position": F.lit("z"), "taken": F.lit("t")})
        docs.write.parquet(str(folder / "documents.parquet"))
        made = cp.run(spark, str(folder)).collect()
        kept = sorted([(3, ODD[3][1]), (4, ODD[5][1]), (0, ODD[6][1]), (0, ODD[7][1])]) if rows else []
        got = sorted((r.doc_id or 0, r.text, r.taken == r.size) for r in made if r["pass"] == 1)
        assert len(got) == len(kept) and all(i == j and (t == u if whole else u.startswith(t)) for (i, t, whole), (j, u) in zip(got, kept))
