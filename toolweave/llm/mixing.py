"""Mixing sources to target weights over time, with DataFrame operations only.

Each source's weight follows a straight line over training time, w (1 + r (2t - 1)); its integral is the source's
demand in words up to t. Documents of a source stand in a hashed order; the words before a document, divided by the
source's target, are a demand that is inverted to the time t at which the document is due. Documents are then sorted
by ranges of t, so that neighbouring ones train together.

A source may hold any share of the rows: its order is cut into buckets by hash. Buckets are summed first, sums are
accumulated over the buckets of a source (at most BUCKETS rows), and only within a bucket are rows sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from toolweave.llm.common import table, without

WEIGHTS = (3.0, 1.0, 2.0)  # by source in code point order, null last, repeating
RAMPS = (0.5, 0.0, -0.5)  # how weights change over time, repeating; between -1 and 1
SHARE = 1.5  # words that the mix takes, of all words there are
MOST_PASSES = 2
BUCKET_BITS = 12
OUTPUTS = ("size", "source_size", "target", "taken", "first_words", "ramp", "offset", "first_at", "second_at")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, ramps=RAMPS, share: float = SHARE, most: int = MOST_PASSES) -> DataFrame:
    """sizes: a row (source, source_size) for each source. Adds rank, weight, ramp and target.

    The level that fills the targets is found in closed form: by rising ratio of cap to weight, the sources before the
    first that stays under its cap are full, and the rest share what is left by weight.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    cycle = lambda values: F.get(F.array(*[F.lit(float(v)) for v in values]), ((F.col("rank") - 1) % len(values)).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(by_name)).withColumns({"weight": cycle(weights), "ramp": cycle(ramps)})
    ranked = ranked.withColumns({"cap": (most * F.col("source_size")).cast("double"), "ratio": most * F.col("source_size") / F.col("weight")})
    everything = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", "rank")
    total = share * F.sum("source_size").over(everything)
    full = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    levels = ranked.withColumn("level", (total - full) / rest)
    level = F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(everything)
    filled = levels.withColumn("water", level)
    target = F.when(F.col("water").isNull() | (F.col("ratio") <= F.col("water")), F.col("cap")).otherwise(F.col("water") * F.col("weight"))
    return filled.withColumn("target", target).select("source", "source_size", "rank", "weight", "ramp", "target")


def due(demand: Column, ramp: Column) -> Column:
    """The time t in [0, 1] at which t + ramp (t^2 - t) reaches demand."""
    slope = 1 - ramp
    return F.least(F.lit(1.0), 2 * demand / (slope + F.sqrt(slope * slope + 4 * ramp * demand)))


def schedule(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights=WEIGHTS,
             ramps=RAMPS, share: float = SHARE, bucket_bits: int = BUCKET_BITS, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each document: its id, source, size, source_size, target, taken, first_words, first_at and second_at.

    taken counts the words of both passes; the last document of a source that is needed gives its first words only.
    first_at and second_at are the times of the passes, null where the document is not needed. A null text has no
    words and is never taken; a null source is a source of its own, after all others; repeated rows are taken one by
    one. Other columns are left out but for those of keep, which travel along.
    """
    more = [F.col(f"`{c}`") for c in keep]
    rows = docs.select(F.col(id_col).alias(id_col), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), *more)
    rows = rows.withColumns({"__key": F.coalesce(F.concat(F.lit("="), "source"), F.lit("")), "__hash": F.xxhash64(id_col)})
    rows = rows.withColumn("__bucket", F.shiftrightunsigned("__hash", 64 - bucket_bits))
    sums = rows.groupBy("__key", "__bucket").agg(F.sum("size").alias("__sum"), F.first("source").alias("source"))
    sizes = sums.groupBy("__key").agg(F.sum("__sum").alias("source_size"), F.first("source").alias("source"))
    wanted = targets(sizes.select("source", "source_size"), weights, ramps, share).select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("__key"), "source_size", "ramp", "target"
    )
    earlier = Window.partitionBy("__key").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("__key", "__bucket", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__start")).join(wanted, "__key")
    within = Window.partitionBy("__key", "__bucket").orderBy("__hash", id_col, "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("__end", F.sum("size").over(within)).join(starts, ["__key", "__bucket"])
    offset = F.col("__start") + F.col("__end") - F.col("size")
    wanted_words = F.round("target").cast("long")
    part = lambda passed: F.greatest(F.lit(0).cast("long"), F.least("size", wanted_words - offset - passed))
    first, second = part(F.lit(0)), part(F.col("source_size"))
    at = lambda words, passed: F.when(words > 0, due((offset + passed + words / 2) / wanted_words, F.col("ramp")))
    return placed.select(
        F.col(id_col), "source", "size", "source_size", "target", (first + second).alias("taken"), first.alias("first_words"),
        at(first, F.lit(0)).alias("first_at"), at(second, F.col("source_size")).alias("second_at"), *more,
    )


def in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The corpus in training order: a row (id, source, pass, position, taken, size, source_size, target, text) for each
    time a document is taken, sorted by ranges of position, its time in [0, 1].

    The text is whole, or its first `taken` words where the last document of a source is taken in part. Documents that are
    not needed have no row; repeated rows are documents of their own.
    """
    plan = schedule(docs, id_col, text_col=text_col, keep=(text_col,), **options)
    turn = lambda n, words, at: F.struct(F.lit(n).alias("pass"), at.alias("position"), words.alias("taken"))
    turns = F.array(turn(1, F.col("first_words"), F.col("first_at")), turn(2, F.col("taken") - F.col("first_words"), F.col("second_at")))
    each = plan.select(F.col(id_col), "source", "size", "source_size", "target", F.col(f"`{text_col}`").alias("__text"), F.inline(F.filter(turns, lambda x: x["taken"] > 0)))
    some = F.array_join(F.slice(F.regexp_extract_all("__text", F.lit(r"[^ \t-\r]+"), F.lit(0)), F.lit(1), F.col("taken").cast("int")), " ")
    rows = each.select(F.col(id_col), "source", "pass", "position", "taken", "size", "source_size", "target", F.when(F.col("taken") < F.col("size"), some).otherwise(F.col("__text")).alias(text_col))
    return rows.repartitionByRange("position", F.xxhash64(id_col)).sortWithinPartitions("position", F.xxhash64(id_col))


def mixed(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """schedule() sorted by ranges of the first time; documents that are not needed come last, in many ranges too."""
    first = F.col("first_at").asc_nulls_last()
    return schedule(docs, id_col, **options).repartitionByRange(first, F.xxhash64(id_col)).sortWithinPartitions(first, F.xxhash64(id_col))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixed(docs).select("doc_id", "size", "source_size", "target", "taken", "first_at", "second_at")
