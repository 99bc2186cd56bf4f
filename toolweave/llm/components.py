"""Connected components of a graph of links, by alternating large-star and small-star steps on DataFrames.

Every step is a grouped minimum (pre-aggregated before its shuffle) and a join with it, so a node with very many
links is never gathered in one task. Each round is written to the shared folder, which keeps the plan short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toolweave.llm.common import written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    links = _both_ways(edges)
    if not large:
        links = links.where("v < u")
    low = links.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("w"), F.least("u", "low").alias("low"))
    met = links.join(low, links.u == low.w)
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        return out.where("u <> v")  # the small star that follows drops what is repeated
    else:
        out = met.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(low.select(F.col("w").alias("u"), F.col("low").alias("v")))
    return out.where("u <> v").distinct()


def _mark(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of links (u, v: long): root is the smallest node that it reaches."""
    edges = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    before = _mark(edges)
    for _ in range(most_rounds):
        if not before[0]:
            break
        edges = written(_star(_star(edges, True), False), "links")
        now = _mark(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
