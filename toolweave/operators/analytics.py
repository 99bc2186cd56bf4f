"""Aggregates over the domain tables.

Every aggregate reads its whole table. A row limit exists only where it is the operator (the newest, the most frequent)
and is a parameter; ties are broken by key, so that reruns agree. Counts and means are combined map-side before their
shuffle, top lists use Spark's bounded per-task heaps, and only the dominant value of a column is ever joined back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.text import to_finite

EMPTY_NAME, EMPTY_STATE = "Unknown", "N/A"


def _named(field: str, empty: str = EMPTY_NAME) -> Column:
    """The field's text, or the stand-in for null and empty text."""
    text = F.col(field).cast("string")
    return F.when(text.isNull() | (text == ""), empty).otherwise(text)


def _top(counted: DataFrame, n: int | None, order) -> DataFrame:
    ordered = counted.orderBy(*order)
    return ordered if n is None else ordered.limit(n)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n) for each table."""
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def recent_files(files: DataFrame, n: int = vocab.DASHBOARD_RECENT_FILES) -> DataFrame:
    """The n newest files; the larger id wins a tie."""
    return _top(files, n, (F.col("ingestion_time").desc_nulls_last(), F.desc("file_id")))


def latest_rows(rows: DataFrame, key: str, numeric: tuple[str, ...] = (), n: int | None = None) -> DataFrame:
    """Rows from the newest key down, numeric columns as doubles or null."""
    typed = rows.withColumns({c: to_finite(F.col(c)) for c in numeric})
    return _top(typed, n, (F.desc(key),))


def facet_values(rows: DataFrame, fields=tuple(vocab.FACET_FIELDS)) -> DataFrame:
    """Distinct non-empty (field, value) pairs of the filter fields that the table has."""
    have = [c for c in fields if c in rows.columns]
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in have])
    return rows.select(F.inline(pairs)).where("value is not null and value <> ''").distinct()


def facet_filter(rows: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Rows whose fields equal all wanted values; an empty wanted value takes all."""
    conditions = [F.col(k).cast("string") == v for k, v in wanted.items() if v]
    return rows.where(reduce(lambda a, b: a & b, conditions)) if conditions else rows


def sort_numeric_then_text(rows: DataFrame, field: str, key: str, descending: bool = False, n: int | None = None) -> DataFrame:
    """Rows in the order of a field: numbers by value, then other texts, then nulls; ties by key."""
    number = to_finite(F.col(field))
    placed = rows.withColumn("sort_number", number)
    way = (lambda c: c.desc_nulls_last()) if descending else (lambda c: c.asc_nulls_last())
    return _top(placed, n, (way(F.col("sort_number")), way(F.col(field).cast("string")), F.asc(key)))


def numbered(ordered: DataFrame, path: str) -> DataFrame:
    """An ordered result with each row's position, from 1.

    The result is written to path once, so that the sort isn't repeated with other bounds; positions follow from the
    counts of its partitions, of which there are as many as sort tasks. No task sees more than its own rows.
    """
    ordered.withColumn("__at", F.monotonically_increasing_id()).write.parquet(path)
    rows = ordered.sparkSession.read.parquet(path)
    part, within = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = rows.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__start"))
    placed = rows.withColumn("__part", part).join(F.broadcast(starts), "__part")  # a row for each sort task
    return placed.withColumn("position", F.col("__start") + within + 1).drop("__part", "__at", "__start")


def top_counts(rows: DataFrame, field: str, n: int | None = 10) -> DataFrame:
    """(name, n): the most frequent values of a field."""
    counted = rows.groupBy(_named(field).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return _top(counted, n, (F.desc("n"), F.asc("name")))


def avg_by(rows: DataFrame, field: str, value: str, n: int | None = 10) -> DataFrame:
    """(name, n, mean): mean of the finite values by field, largest means first."""
    number = to_finite(F.col(value))
    means = rows.select(_named(field).alias("name"), number.alias("x")).where("x is not null").groupBy("name").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean")
    )
    return _top(means, n, (F.desc("mean"), F.asc("name")))


def sum_by(rows: DataFrame, field: str, value: str) -> DataFrame:
    """(name, total): sum of the finite values by field."""
    sums = rows.select(_named(field).alias("name"), to_finite(F.col(value)).alias("x"))
    return sums.groupBy("name").agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("total"))


def dominant(rows: DataFrame, field: str) -> DataFrame:
    """One row (dominant): the most frequent non-empty value of a field."""
    counted = rows.where((F.col(field) != "") & F.col(field).isNotNull()).groupBy(F.col(field).alias("dominant")).count()
    return counted.orderBy(F.desc("count"), F.asc("dominant")).limit(1).select("dominant")


def _of_dominant(rows: DataFrame, field: str) -> DataFrame:
    return rows.join(F.broadcast(dominant(rows, field)), F.col(field) == F.col("dominant")).drop("dominant")  # one row


def param_trend(readings: DataFrame, key: str, n: int = 20) -> DataFrame:
    """The last n readings of the dominant parameter, oldest first."""
    last = _of_dominant(readings, "parameter").orderBy(F.desc("event_ts"), F.desc(key)).limit(n)
    return last.select("parameter", "event_ts", key, to_finite(F.col("value")).alias("value")).orderBy("event_ts", key)


def avg_param_by_step(readings: DataFrame, n: int | None = 10) -> DataFrame:
    return avg_by(_of_dominant(readings, "parameter"), "step", "value", n)


def fault_timeline(faults: DataFrame, n: int | None = None) -> DataFrame:
    """(minute, n): faults by minute, the last n minutes or all, oldest first."""
    counted = faults.where("event_ts is not null and event_ts <> ''").groupBy(F.substring("event_ts", 1, 16).alias("minute")).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy("minute") if n is None else counted.orderBy(F.desc("minute")).limit(n).orderBy("minute")


def state_transitions(states: DataFrame, n: int | None = 10) -> DataFrame:
    """(transition, n): how often one state follows another."""
    return _top(states.groupBy(_transition().alias("transition")).agg(F.count(F.lit(1)).alias("n")), n, (F.desc("n"), F.asc("transition")))


def severity_count(rows: DataFrame) -> DataFrame:
    """One row (n): rows of a severe level."""
    return rows.agg(F.count_if(F.upper("severity").isin(*vocab.DASHBOARD_SEVERE)).alias("n"))


def _transition() -> Column:
    return F.concat(_named("prev_state", EMPTY_STATE), F.lit(" → "), _named("curr_state", EMPTY_STATE))


def _measure(kind: str, column: str, digits: int) -> tuple[Column, Column]:
    """Text and count of a card that isn't a most frequent value."""
    if kind == "avg":
        mean = F.avg(to_finite(F.col(column)))
        return F.when(mean.isNotNull(), F.format_string(f"%.{digits}f", mean)), F.count(to_finite(F.col(column)))
    if kind == "severe":
        return F.count_if(F.upper(column).isin(*vocab.DASHBOARD_SEVERE)).cast("string"), F.count(F.lit(1))
    return F.count_distinct(F.when(F.col(column).cast("string") != "", F.col(column))).cast("string"), F.count(F.lit(1))


def insight_cards(cards: dict[str, tuple[DataFrame, dict[str, tuple]]]) -> DataFrame:
    """(table_name, card, text, n) for tables and their cards name -> (kind, column[, digits]).

    Kinds: top, the most frequent value and how often it occurs (of equals the smallest); transition, the same for pairs of
    states; avg, the mean of the finite values and their number; distinct and severe, how many different or severe values
    there are and the number of rows. A card without values says N/A. A table is read twice whatever its number of cards:
    once for all its values' counts, once for the other cards.
    """
    out = []
    for name, (rows, wanted) in cards.items():
        kinds = {card: (spec[0], spec[1], spec[2] if len(spec) > 2 else 2) for card, spec in wanted.items()}
        tops = {card: _transition() if kind == "transition" else _named(column) for card, (kind, column, _) in kinds.items() if kind in ("top", "transition")}
        rest = {card: _measure(*spec) for card, spec in kinds.items() if card not in tops}
        pieces = []
        if tops:
            each = rows.select(F.inline(F.array(*[F.struct(F.lit(card).alias("card"), value.alias("name")) for card, value in tops.items()])))
            counted = each.groupBy("card", "name").agg(F.count(F.lit(1)).alias("n"))
            of = lambda card, c: F.when(F.col("card") == card, c)
            best = [F.min_by(of(card, F.struct("name", "n")), of(card, F.struct((-F.col("n")).alias("less"), F.col("name")))).alias(f"top{i}") for i, card in enumerate(tops)]
            pieces.append((counted.agg(*best), [(card, F.col(f"top{i}.name"), F.col(f"top{i}.n")) for i, card in enumerate(tops)]))
        if rest:
            made = [c.alias(f"{part}{i}") for i, pair in enumerate(rest.values()) for part, c in zip(("text", "n"), pair)]
            pieces.append((rows.agg(*made), [(card, F.col(f"text{i}"), F.col(f"n{i}")) for i, card in enumerate(rest)]))
        for one, shown in pieces:
            out.append(one.select(F.inline(F.array(*[F.struct(
                F.lit(name).alias("table_name"), F.lit(card).alias("card"), F.coalesce(text, F.lit(EMPTY_STATE)).alias("text"), F.coalesce(n, F.lit(0)).cast("long").alias("n"))
                for card, text, n in shown]))))
    return reduce(DataFrame.unionByName, out)


def row_sample(rows: DataFrame, key: str, n: int = vocab.DASHBOARD_SAMPLE_ROWS) -> DataFrame:
    """The n rows of the smallest keys."""
    return rows.orderBy(key).limit(n)
