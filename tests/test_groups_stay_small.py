"""No aggregate or window holds all values of a path or all blocks of a file."""

from toolweave.operators import lines as ln
from toolweave.operators import profile as p


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_samples_are_rows(spark):
    docs = spark.createDataFrame([(k % 2, f'{{"id": {k % 30}, "t": "{"x" * 90}{k}"}}') for k in range(100)], "family long, text string")
    rows = p.leaf_rows(docs)
    made = p.path_profile(rows, "family")
    assert "WindowGroupLimit" in _plan(made) and "collect_set(sample" not in _plan(made)
    assert {(r.family, r.path): (r.type, r.n, tuple(r.samples)) for r in made.collect()} == {
        (f, x): (t, 50, tuple(sorted(str(k) for k in range(f, 30, 2))[:5]) if x == "id" else ("x" * 77 + "...",)) for f in (0, 1) for x, t in (("id", "int"), ("t", "str"))}
    got = p.path_samples(rows, "family").groupBy("family", "path").count().collect()
    assert {(r.family, r.path): r["count"] for r in got} == {(f, x): n for f in (0, 1) for x, n in (("id", 15), ("t", 1))}


def test_blocks_are_numbered_by_stretch(spark):
    texts = ["", "a", "b", "", "", "", "c", "", "d", "e", "f", "g", "h", "", "i", "", ""]
    df = spark.createDataFrame([(f, k, t) for f in (1, 2) for k, t in enumerate(texts, 1)], "file_id long, line_no long, text string")
    made = ln.segment_records(df, "blank", stretch=3)
    got = [(r.number, r.first_line, r.text) for r in made.where("file_id = 2").orderBy("number").collect()]
    assert got == [(1, 2, "a\nb"), (2, 7, "c"), (3, 9, "d\ne\nf\ng\nh"), (4, 15, "i")]
    windows = [x for x in _plan(made).splitlines() if "row_number" in x]
    assert windows and all("__k" in x for x in windows)
