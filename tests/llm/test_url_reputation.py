"""Levels and bounds of the host reputations."""

import numpy as np
from pyspark.sql import functions as F

from toolweave.llm import url_filter


def test_levels_of_hosts(spark):
    hosts = {
        "a.b.example.com": ("a.b.example.com", "example.com", "com"), "example.com": ("example.com", "example.com", "com"),
        "u:p@www.shop.co.uk:8080": ("www.shop.co.uk", "shop.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk", "co.uk"),
        "10.0.0.1:80": ("10.0.0.1", "10.0.0.1", "#"), "[::1]:80": ("[::1]", "[::1]", "#"), "localhost": ("localhost", "localhost", "localhost"),
        "": ("", "", ""), "x.org.": ("x.org", "x.org", "org"),
    }
    df = spark.createDataFrame([(h,) for h in hosts], "host string").withColumn("name", url_filter.name_of(F.col("host")))
    got = df.select("host", "name", url_filter.domain_of(F.col("name")), url_filter.suffix_of(F.col("name"))).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == hosts
    one = df.where("host like '%uk:8080'").select(url_filter.domain_of(F.col("name"), ()), url_filter.suffix_of(F.col("name"), ())).first()
    assert tuple(one) == ("co.uk", "uk")


def test_bound_is_the_beta_quantile():
    rng = np.random.default_rng(7)
    for a, b in [(1, 1), (0.2, 0.9), (0.05, 3), (2.5, 0.4), (9, 30), (400, 1200), (90_000, 10_000)]:
        drawn = np.quantile(rng.beta(a, b, 2_000_000), 0.05)
        got = url_filter.beta_lower([a], [b])[0]
        assert abs(got - drawn) < 0.01 * max(0.05, drawn), (a, b, got, drawn)
    assert abs(url_filter.beta_lower([1], [1])[0] - 0.05) < 1e-4
    assert abs(url_filter.beta_lower([1], [4])[0] - (1 - 0.95 ** 0.25)) < 1e-4 and abs(url_filter.beta_lower([3], [1])[0] - 0.05 ** (1 / 3)) < 1e-4


def test_outcomes_under_a_shared_suffix_stay_apart(spark):
    pages = spark.createDataFrame([(1, "http://bad.co.uk/"), (2, "http://good.co.uk/"), (3, "http://new.bad.co.uk:81/"), (4, None)], "page_id long, url string")
    seen = spark.createDataFrame([(1, True)] * 40 + [(2, False)] * 40, "id long, bad boolean")
    by = {r.page_id: r.verdict for r in url_filter.judge(pages, seen).collect()}
    assert by == {1: "block", 2: "allow", 3: "block", 4: "allow"}
