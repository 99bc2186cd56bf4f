"""Delimited files against the standard reader, tagged records, bags of repeated keys, labelled lines, line votes."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from toolweave.functions.maps import first_of, last_of
from toolweave.operators import lines as ln
from toolweave.operators import tables_in as ti


def _plain(text):
    """Rows of cells by the standard reader, blank ones left out."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    return [[c.strip() for c in r] for r in csv.reader(io.StringIO(text), delimiter=",") if any(c.strip() for c in r)]


def _cells(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", F.regexp_replace("text", "\r\n?", "\n").alias("t"))
    made = rows.select("id", F.transform(ti.csv_records(F.col("t"), F.lit(",")), lambda r: ti._csv_cells(r, F.lit(","))).alias("c"))
    return {r.id: [c for c in r.c if any(c)] for r in made.collect()}


def test_quoted_cells(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(['"', '""', ",", "\n", "a", " b", "\r\n", "x", "é"]) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    texts += ['a,b\n"x,y",2', 'a,b\n"x\ny",2\n', '"a"" b",c', 'a,5" pipe', '"' * 20_001, '"a"b,c', '"open, to the end\nhere', "," * 5000, "\n" * 5000, '"q",' * 20_000]
    got = _cells(spark, texts)
    for i, t in enumerate(texts):
        assert got[i] == _plain(t), t[:200]


FILES = [
    (1, 'a,b\n"x,y",2\n\n , \n3,"line\nbreak"\n4,5,6\n'), (2, "a,a,b\n1,2,3"), (3, None), (4, ""), (5, "only"), (6, "﻿a;b\r\n1;TRUE\r\n"), (7, "a,b\n,\n"),
]


def test_files(spark):
    df = spark.createDataFrame(FILES, "id long, text string").withColumns({"FIELDS": F.lit("x"), "row_no": F.lit("y")})
    got = {(r.id, r.row_no): (r.fields, r.n_cells, r.expected, r.malformed) for r in ti.read_csv_diag(df).collect()}
    assert got == {
        (1, 2): ({"a": "x,y", "b": "2"}, 2, 2, False), (1, 3): ({"a": "3", "b": "line\nbreak"}, 2, 2, False), (1, 4): (None, 3, 2, True),
        (2, 2): ({"a": "2", "b": "3"}, 3, 3, False), (6, 2): ({"a": "1", "b": "true"}, 2, 2, False)}
    assert ti.read_csv_diag(df.limit(0)).count() == 0


def test_tagged_records_of_repeated_keys(spark):
    def container(*payloads):
        body = b"".join(b"\x03" + len(p).to_bytes(2, "little") + p for p in payloads)
        return b"SLOG\x01\x00" + len(payloads).to_bytes(2, "little") + body

    rows = [(1, container(b"k=1;k=2;a=x=y;;flag")), (2, container(b"")), (3, None), (4, b"nothing"), (5, container(b"a=1", b"b=2")[:-1])]
    got = {r.id: [x.fields for x in r.r] if r.r is not None else None for r in spark.createDataFrame(rows, "id long, c binary").select("id", ti.tlv_records(F.col("c")).alias("r")).collect()}
    assert got == {1: [{"k": "2", "a": "x=y", "flag": None}], 2: [{}], 3: None, 4: None, 5: [{"a": "1"}]}


@pytest.mark.parametrize("last", [False, True])
def test_one_of_each_key(spark, last):
    rng = random.Random(1)
    rows = [(i, [(rng.choice(["a", "b", "c", None]), str(rng.random())) for _ in range(rng.randint(0, 9))]) for i in range(200)] + [(200, None)]
    df = spark.createDataFrame(rows, "i long, e array<struct<key:string,value:string>>")
    got = {r.i: r.m for r in df.select("i", (last_of if last else first_of)(F.col("e")).alias("m")).collect()}
    for i, e in rows:
        want = None if e is None else dict([x for x in (e if last else reversed(e)) if x[0] is not None])
        assert got[i] == want


def test_labelled_lines(spark):
    text = "Lot: L1\nnote without\nTemp : 7.50 \nLot: L2\nin {a=1, b=2} c=3 c=4\n: nothing\nurl:"
    row = spark.createDataFrame([(text,)], "t string").select(ln.extract_kv(F.col("t")).alias("f"), ln.message_of(F.col("t")).alias("m")).first()
    assert row.f == {"Lot": "L2", "Temp": "7.5", "c": "3", "b": "2", "a": "1"} and row.m == "note without in : nothing url"


def test_votes(spark):
    files = {1: ["a=1 b=2"] * 3, 2: ["x: y"] * 3, 3: ["word"], 4: ["2024-01-01T00:00:00 T1 WARN GO now", "[EVT] x"], 5: [" ", ""]}
    rows = [(f, i, t) for f, texts in files.items() for i, t in enumerate(texts, 1)]
    got = {r.file_id: r for r in ln.file_votes(spark.createDataFrame(rows, "file_id long, line_no long, text string")).collect()}
    assert {k: r.family for k, r in got.items()} == {1: "kv_line_log", 2: "labeled_text_block", 3: "unknown_text", 4: "syslog_like_log"}
    assert got[1].layouts == ["none"] and got[2].layouts == ["tool_token_message"] and got[3].layouts == ["none"]
    assert got[4].event_styles == ["leading_bracket_token", "leading_upper_token"] and got[3].event_styles == ["none"] and got[3].timestamp_styles == ["none"]
