"""The landing catalog and the store of adapter specs."""

import hashlib

from pyspark.sql import functions as F

from toolweave.operators import adapters as ad
from toolweave.operators import ingest as ig


def test_catalog(spark, tmp_path):
    files = {"a.LOG": b"x\n", "b.tar.gz": b"\x00\xff", ".hid": b"1", "no end": b"e", "é %41.csv": b"k", "dir/c.json": b"{}", "dot.": b"d"}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.filename: r for r in ig.ingest_files(spark, str(tmp_path)).collect()}
    assert {n.split("/")[-1] for n in files} - {".hid"} <= set(got)
    for name, data in files.items():
        if not name.startswith("."):
            r = got[name.split("/")[-1]]
            assert (r.size_bytes, r.sha256) == (len(data), hashlib.sha256(data).hexdigest())
    assert {n: r.extension for n, r in got.items()} == {"a.LOG": ".log", "b.tar.gz": ".gz", "no end": "", "é %41.csv": ".csv", "c.json": ".json", "dot.": ""}
    again = {r.filename: r.file_id for r in ig.ingest_files(spark, str(tmp_path)).collect()}
    assert again == {n: r.file_id for n, r in got.items()} and len(set(again.values())) == len(again)
    large = {r.filename: (r.sha256, r.size_bytes) for r in ig.ingest_files(spark, str(tmp_path), largest=1).collect()}
    assert large["a.LOG"] == (None, 2) and large["dot."][0] is not None


def _specs(spark, *rows):
    return spark.createDataFrame([(f, "alias", 0, None, None, k, t) for f, k, t in rows], "fingerprint string, kind string, n int, source string, field string, key string, target string")


def test_store(spark, tmp_path):
    path = str(tmp_path / "specs")
    ad.save_specs(_specs(spark, ("a", "x", "lot"), ("a", "y", "tool"), ("b", "x", "lot"), ("", "x", "lot"), (None, "x", "lot"), ("b", "x", "lot")), path)
    ad.save_specs(_specs(spark, ("a", "z", "wafer"), ("c", "x", "lot")), path)
    ad.save_specs(_specs(spark, ("a", "z", "step")), path)
    ad.save_specs(_specs(spark), path)
    got = sorted((r.fingerprint, r.key, r.target, r.version) for r in ad.read_specs(spark, path).collect())
    assert got == [("a", "z", "step", 3), ("b", "x", "lot", 1), ("c", "x", "lot", 1)]
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "none"), (4, None)], "id long, fingerprint string").withColumn("RULES", F.lit("x"))
    rows = {r.id: (r.version, [x.target for x in r.rules] if r.rules else None) for r in ad.adapter_specs_scan(docs, ad.read_specs(spark, path)).collect()}
    assert rows == {1: (3, ["step"]), 2: (3, ["step"]), 3: (None, None), 4: (None, None)}


def test_samples_of_few_keys(spark):
    rows = spark.createDataFrame([(i, "t", {str(k): "v" for k in range(60)}) for i in range(5)], "i long, source_record_type string, m map<string,string>")
    assert [(r.i, len(r.m)) for r in ad.sample_by_type(rows, "i", bag="m", most_keys=40).collect()] == [(0, 40), (1, 40), (2, 40)]
