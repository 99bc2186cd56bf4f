"""A walk is one chain of compiled generators over documents that are made and parsed once, whatever is asked of its rows."""

from pyspark.sql import functions as F

from toolweave.operators import markup as mk
from toolweave.operators import nested as ns
from toolweave.operators import profile as p

TEXTS = [(1, '{"a":[{"x":1,"y":[{"z":2.5}]},{"y":[{"w":null},{}]}],"b":[],"c":{},"d":[1,{"e":[{"f":true}]}],"g":[null,{"h":"1"}]}'), (2, '[[{"k":"1"}],[]]'), (None, '{"a":[{"x":"2"}]}'), (None, '{"a":[{"n":[{"x":1}]}]}')]


def _rows(spark):
    return p.leaf_rows(spark.createDataFrame(TEXTS, "id long, text string"))


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_levels_are_generators_without_lambdas(spark):
    rows = _rows(spark)
    plan = _plan(rows.select("id", "path", "kind"))
    assert "variant_explode" in plan and "lambda" not in plan and "parse_json" not in plan.lower() and "parseJson" not in plan
    got = [(r.path, r.kind, r.value, r.n, tuple(r["keys"]) if r["keys"] is not None else None) for r in rows.where("id = 1").collect()]
    leaf = lambda path, kind, value=None: (path, kind, value, None, None)
    group = lambda path, n, *keys: (path, "objects", None, n, keys)
    assert sorted(map(str, got)) == sorted(map(str, [
        group("a[]", 2, "x", "y"), leaf("a[].x", "int", "1"), group("a[].y[]", 1, "z"), leaf("a[].y[].z", "float", "2.5"), group("a[].y[]", 2, "w"), leaf("a[].y[].w", "null"),
        leaf("d[]", "int", "1"), group("d[].e[]", 1, "f"), leaf("d[].e[].f", "bool", "true"), leaf("g[]", "null"), leaf("g[].h", "str", "1")]))


def test_the_rows_are_made_once(spark):
    rows = _rows(spark)
    made = p.record_boundaries(rows, "id")
    assert _plan(made).count("Relation") == 1
    assert {(r.id, r.path): (r.n, tuple(r["keys"])) for r in made.collect()} == {(1, "a[]"): (2, ("x", "y")), (1, "a[].y[]"): (3, ("w", "z")), (1, "d[].e[]"): (1, ("f",)), (2, "[][]"): (1, ("k",))}
    open_ = p.uncovered_paths(rows, spark.createDataFrame([(1, "d[].e[]")], "id long, path string"), "id")
    assert _plan(open_).count("variant_explode") == _plan(rows).count("variant_explode")
    assert sorted(map(str, open_.collect())) == sorted(["Row(id=1, path='a[].y[]')", "Row(id=2, path='[][]')", "Row(id=None, path='a[]')", "Row(id=None, path='a[].n[]')"])
    made = p.path_profile(rows, "id")
    made.collect()
    assert "ReusedExchange" in made._jdf.queryExecution().executedPlan().toString()
    assert {r.path: (r.type, r.n, tuple(r.samples)) for r in made.where("id is null").collect()} == {"a[].x": ("str", 1, ("2",)), "a[].n[].x": ("int", 1, ("1",))}


def test_no_item_of_a_list(spark):
    docs = ns.read_json_docs(spark.createDataFrame(TEXTS, "id long, text string"))
    for items, want in ((0, {"a[]"}), (1, {"a[]", "a[].x", "a[].y[]", "a[].y[].z", "d[]", "g[]"})):
        assert {r.path for r in ns.leaf_rows(docs.where("id = 1"), items=items).collect()} == want


def test_names_in_quotes_leave_the_schema_readable(spark):
    rows = spark.createDataFrame([('{"@a<":{"`x>`":[{"b c":1}]}}',)], "t string").select(F.parse_json("t").alias("v"))
    marks = rows.select(ns._brackets(F.col("v"), F.schema_of_variant("v")).alias("b"), ns.levels_of(F.col("v")).alias("n")).first()
    assert tuple(marks) == ("<<<<>>>>", 4)


def test_singletons_group_only_what_may_be_one(spark):
    """Of a document's objects those within lists that are no items: one here, however many items there are."""
    lines = "".join(f'<line n="{k}"><part>{k}</part><check><qty>1</qty><flag>A</flag></check><w><x><y>1</y><z>2</z></x></w></line>' for k in range(20))
    docs = mk.xml_list_unify(mk.read_xml_docs(spark.createDataFrame([(1, f"<o><s>1</s><t>2</t>{lines}</o>"), (None, f"<o>{lines}</o>"), (3, "<o><a><b>1</b><c>2</c></a></o>")], "id long, text string")), "id")
    assert {(r.id, tuple(r.lists)) for r in docs.collect()} == {(1, ("o.line",)), (None, ("o.line",)), (3, ())}
    found = mk.singleton_paths(docs, "id")
    assert r"\[\d+\]\z" in _plan(found)  # items are left out before the grouping
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(i, x) for i in (1, None) for x in ("o.line.check", "o.line.w.x")], key=str)
