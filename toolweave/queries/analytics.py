"""Queries of the dashboard aggregates, with SQL written from the typed source columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.frames import new_path
from ..operators import analytics as a
from .tables import READINGS_SQL, files, readings, states, table

R = f"WITH r AS ({READINGS_SQL})"
NAMED = lambda c, empty="Unknown": f"CASE WHEN {c} IS NULL OR {c} = '' THEN '{empty}' ELSE {c} END"
CARDS = {
    "equipment_states": {"top_tool": ("top", "tool_id"), "top_transition": ("transition", None), "top_state": ("top", "curr_state"), "severe_rows": ("severe", "severity")},
    "process_parameters_recipes": {"top_recipe": ("top", "recipe"), "top_parameter": ("top", "parameter"), "avg_value": ("avg", "value"), "steps": ("distinct", "step")},
    "sensor_readings": {"top_parameter": ("top", "parameter"), "top_step": ("top", "step"), "avg_value": ("avg", "value"), "top_tool": ("top", "tool_id")},
    "fault_events": {"top_code": ("top", "fault_code"), "top_severity": ("top", "severity"), "top_step": ("top", "step"), "top_tool": ("top", "tool_id")},
    "wafer_processing_sequences": {"top_step": ("top", "step"), "top_status": ("top", "status"), "avg_duration": ("avg", "duration_s", 1), "wafers": ("distinct", "wafer")},
}


def _card_rows(spark, d):
    """Each card table's rows: all events as readings and as process rows, errors as faults, purchases as wafer steps, orders as states."""
    r, k = readings(spark, d), F.col("event_id")
    numbered = lambda letter, n: F.concat(F.lit(letter), (k % n).cast("string"))
    order = F.col("o_orderkey")
    return {
        "equipment_states": states(spark, d).withColumns({
            "tool_id": F.concat(F.lit("T"), (order % 17).cast("string")),
            "severity": F.when(order % 3 == 0, "Warn").when(order % 3 == 1, "INFO")}),
        "process_parameters_recipes": r.withColumn("recipe", F.when(k % 6 == 0, "").otherwise(numbered("R", 6))),
        "sensor_readings": r,
        "fault_events": r.where("parameter = 'error'").withColumn("fault_code", numbered("A", 9)),
        "wafer_processing_sequences": r.where("parameter = 'purchase'").withColumns({"wafer": F.when(k % 5 != 0, numbered("W", 25)), "duration_s": F.col("value")}),
    }


def _cards(spark, d):
    rows = _card_rows(spark, d)
    return a.insight_cards({name: (rows[name], wanted) for name, wanted in CARDS.items()})


def _faults(spark, d):
    return readings(spark, d).where("parameter = 'error'")


def _mean(df):
    return df.withColumn("mean", F.round("mean", 6))


QUERIES = {
    "table_counts": lambda s, d: a.table_counts({"events": table(s, d, "events"), "faults": _faults(s, d), "orders": table(s, d, "orders")}),
    "recent_files": lambda s, d: a.recent_files(files(s, d)).select("file_id", "filename"),
    "latest_rows": lambda s, d: a.numbered(a.latest_rows(readings(s, d), "event_id", ("value",)).select("event_id", "event_ts", "tool_id", "value"), new_path(s, "latest")),
    "facet_values": lambda s, d: a.facet_values(readings(s, d)),
    "facet_filter": lambda s, d: a.facet_filter(readings(s, d), {"tool_id": "T3", "severity": "WARN", "step": ""}).select("event_id", "tool_id", "severity"),
    "sort_numeric_then_text": lambda s, d: a.numbered(a.sort_numeric_then_text(readings(s, d), "value", "event_id", descending=True).select("event_id", "sort_number"), new_path(s, "sorted")),
    "top_counts": lambda s, d: a.top_counts(readings(s, d), "step"),
    "avg_by": lambda s, d: _mean(a.avg_by(readings(s, d), "tool_id", "value")),
    "sum_by": lambda s, d: a.sum_by(readings(s, d), "step", "value").withColumn("total", F.round("total", 2)),
    "param_trend": lambda s, d: a.param_trend(readings(s, d), "event_id"),
    "avg_param_by_step": lambda s, d: _mean(a.avg_param_by_step(readings(s, d))),
    "fault_timeline": lambda s, d: a.fault_timeline(_faults(s, d)),
    "state_transitions": lambda s, d: a.state_transitions(states(s, d)),
    "severity_count": lambda s, d: a.severity_count(readings(s, d)),
    "insight_cards": _cards,
    "row_sample": lambda s, d: a.row_sample(readings(s, d), "event_id").select("event_id", "tool_id", "parameter"),
}

ORACLES = {
    "table_counts": "SELECT 'events' AS table_name, count(*) AS n FROM events UNION ALL SELECT 'faults', count(*) FROM events WHERE event_type = 'error' UNION ALL SELECT 'orders', count(*) FROM orders",
    "recent_files": "SELECT o_orderkey AS file_id, 'order_' || CAST(o_orderkey AS VARCHAR) || '.log' AS filename FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC LIMIT 20",
    "latest_rows": f"{R} SELECT event_id, event_ts, tool_id, x AS value, row_number() OVER (ORDER BY event_id DESC) AS position FROM r",
    "facet_values": f"{R} SELECT DISTINCT field, value FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS field, {c} AS value FROM r" for c in ("tool_id", "step", "severity", "status", "parameter")
    ) + ") WHERE value IS NOT NULL AND value <> ''",
    "facet_filter": f"{R} SELECT event_id, tool_id, severity FROM r WHERE tool_id = 'T3' AND severity = 'WARN'",
    "sort_numeric_then_text": f"{R} SELECT event_id, x AS sort_number, row_number() OVER (ORDER BY x DESC NULLS LAST, value_text DESC NULLS LAST, event_id) AS position FROM r",
    "top_counts": f"{R} SELECT {NAMED('step')} AS name, count(*) AS n FROM r GROUP BY 1 ORDER BY n DESC, name LIMIT 10",
    "avg_by": f"{R} SELECT tool_id AS name, count(x) AS n, round(avg(x), 6) AS mean FROM r WHERE x IS NOT NULL GROUP BY 1 ORDER BY avg(x) DESC, name LIMIT 10",
    "sum_by": f"{R} SELECT {NAMED('step')} AS name, round(coalesce(sum(x), 0), 2) AS total FROM r GROUP BY 1",
    "param_trend": f"""{R}, top AS (SELECT parameter FROM r GROUP BY 1 ORDER BY count(*) DESC, parameter LIMIT 1)
        SELECT parameter, event_ts, event_id, x AS value FROM r JOIN top USING (parameter) ORDER BY event_ts DESC, event_id DESC LIMIT 20""",
    "avg_param_by_step": f"""{R}, top AS (SELECT parameter FROM r GROUP BY 1 ORDER BY count(*) DESC, parameter LIMIT 1)
        SELECT {NAMED('step')} AS name, count(x) AS n, round(avg(x), 6) AS mean FROM r JOIN top USING (parameter) WHERE x IS NOT NULL GROUP BY 1 ORDER BY avg(x) DESC, name LIMIT 10""",
    "fault_timeline": "SELECT strftime(ts, '%Y-%m-%d %H:%M') AS minute, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1",
    "state_transitions": """SELECT coalesce(p, 'N/A') || ' → ' || c AS transition, count(*) AS n FROM (
        SELECT o_orderstatus AS c, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders) GROUP BY 1 ORDER BY n DESC, transition LIMIT 10""",
    "severity_count": f"{R} SELECT count(*) FILTER (WHERE upper(severity) IN ('WARN', 'ERROR', 'CRITICAL', 'ALARM')) AS n FROM r",
    "insight_cards": f"""{R},
        e AS (SELECT *, 'T' || CAST(k % 17 AS VARCHAR) AS tool_id, CASE k % 3 WHEN 0 THEN 'Warn' WHEN 1 THEN 'INFO' END AS severity,
          coalesce(p, 'N/A') || ' → ' || c AS pair FROM (SELECT o_orderkey AS k, o_orderstatus AS c, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders)),
        p AS (SELECT *, CASE WHEN event_id % 6 = 0 THEN '' ELSE 'R' || CAST(event_id % 6 AS VARCHAR) END AS recipe FROM r),
        f AS (SELECT *, 'A' || CAST(event_id % 9 AS VARCHAR) AS fault_code FROM r WHERE parameter = 'error'),
        w AS (SELECT *, CASE WHEN event_id % 5 <> 0 THEN 'W' || CAST(event_id % 25 AS VARCHAR) END AS wafer FROM r WHERE parameter = 'purchase'),
        tops AS ({" UNION ALL ".join(
            f"SELECT '{t}' AS table_name, '{card}' AS card, {NAMED(column)} AS text, count(*) AS n FROM {rows} GROUP BY 3"
            for t, rows, cards in (("equipment_states", "e", (("top_tool", "tool_id"), ("top_transition", "pair"), ("top_state", "c"))),
                                   ("process_parameters_recipes", "p", (("top_recipe", "recipe"), ("top_parameter", "parameter"))),
                                   ("sensor_readings", "r", (("top_parameter", "parameter"), ("top_step", "step"), ("top_tool", "tool_id"))),
                                   ("fault_events", "f", (("top_code", "fault_code"), ("top_severity", "severity"), ("top_step", "step"), ("top_tool", "tool_id"))),
                                   ("wafer_processing_sequences", "w", (("top_step", "step"), ("top_status", "status"))))
            for card, column in cards)})
        SELECT * FROM tops QUALIFY row_number() OVER (PARTITION BY table_name, card ORDER BY n DESC, text) = 1
        UNION ALL SELECT 'equipment_states', 'severe_rows', CAST(count(*) FILTER (WHERE severity = 'Warn') AS VARCHAR), count(*) FROM e
        UNION ALL SELECT 'process_parameters_recipes', 'avg_value', printf('%.2f', avg(x)), count(x) FROM p
        UNION ALL SELECT 'process_parameters_recipes', 'steps', CAST(count(DISTINCT nullif(step, '')) AS VARCHAR), count(*) FROM p
        UNION ALL SELECT 'sensor_readings', 'avg_value', printf('%.2f', avg(x)), count(x) FROM r
        UNION ALL SELECT 'wafer_processing_sequences', 'avg_duration', printf('%.1f', avg(x)), count(x) FROM w
        UNION ALL SELECT 'wafer_processing_sequences', 'wafers', CAST(count(DISTINCT wafer) AS VARCHAR), count(*) FROM w""",
    "row_sample": f"{R} SELECT event_id, tool_id, parameter FROM r ORDER BY event_id LIMIT 50",
}
