"""The delimiter score over all bodies: none, ties and several delimiters."""

from toolweave.operators import detect as dt
from toolweave.queries import QUERIES, detection

SF = "/root/testdata/sf0.001"


def test_every_body_is_scored(spark):
    assert QUERIES["delimiter_score"](spark, SF).where("family = 'body'").count() == detection.bodies(spark, SF).count()


def test_scores(spark):
    texts = {"none at all\nhere": (-1, -1, ","), "a;b,c\n1;2,3": (1, 2, ","), "a;b;c,d\n1;2;3,4": (1, 3, ";"), "one\na;b": (0, 1, ";"), "a;b": (-1, -1, ",")}
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", dt.delimiter_score(dt.non_blank_lines(dt.F.col("text"))).alias("b"))
    assert {r.text: tuple(r.b) for r in df.collect()} == texts
