"""Queries of line parsing: every event is printed as a log line in one of four layouts and parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lines as ln
from .tables import dealt, table

def log_lines(spark, d):
    """file_id, line_no, text: a file a user, its events in time order; the layout goes by the event."""
    k = F.col("event_id")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    kind, tool, value = F.upper("event_type"), F.concat(F.lit("T"), F.col("user_id").cast("string")), F.round("value", 2).cast("string")
    text = (
        F.when(k % 4 == 0, F.concat(stamp, F.lit(" "), tool, F.lit(" WARN too hot temp_C="), value, F.lit(" zone=3 temp_C=0")))
        .when(k % 4 == 1, F.concat(F.lit("Jan  1 00:00:"), F.lpad((k % 60).cast("string"), 2, "0"), F.lit(" "), tool, F.lit(" etch.info: ["), kind, F.lit("] {from=IDLE, to=RUN, v="), value, F.lit("}")))
        .when(k % 4 == 2, F.concat(stamp, F.lit(" ["), tool, F.lit("] ERROR: ALARM > code=A7 reason=\"high temp\" value="), value))
        .otherwise(F.concat(F.lit("tool_id="), tool, F.lit(" event="), kind, F.lit(" value="), value, F.lit(" ok=TRUE")))
    )
    return table(spark, d, "events").select("event_id", (F.col("user_id") % 40).alias("file_id"), F.col("event_id").alias("line_no"), text.alias("text"))


def parsed(s, d):
    return ln.parse_records(log_lines(s, d))


def kinds(s, d):
    p = parsed(s, d)
    return p.select("event_id", ln.classify_record(F.col("event_code"), F.col("event_type"), F.col("severity"), F.lit(None).cast("string"), F.col("fields")).alias("record_type"))


def segments(s, d):
    """Blocks of lines: a line of every fifth event starts one."""
    k = F.col("event_id")
    rows = dealt(s, d, "events").select((F.col("user_id") % 40).alias("file_id"), k.alias("line_no"),
                                        F.when(k % 5 == 0, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(" start"))).otherwise(F.concat(F.lit("  more "), k.cast("string"))).alias("text"))
    return ln.segment_records(rows, "timestamp", stretch=700)


def layouts(s, d):
    """Lines of files in three layouts by the user: timed blocks, blank-separated blocks, plain lines."""
    kind = (F.col("user_id") % 30) % 3
    timed = F.array(F.concat(F.date_format("ts", "yyyy/MM/dd HH:mm:ss"), F.lit(" start")), F.lit(" more"), F.lit(""))
    parts = F.when(kind == 1, timed).when(kind == 2, F.array(F.lit("a"), F.lit("b"), F.lit(" "))).otherwise(F.array(F.lit("a")))
    rows = dealt(s, d, "events").select((F.col("user_id") % 30).alias("file_id"), "event_id", F.posexplode(parts).alias("i", "text"))
    return rows.select("file_id", (F.col("event_id") * 3 + F.col("i")).alias("line_no"), "text")


def blocks(s, d):
    k = F.col("event_id").cast("string")
    text = F.concat(F.lit("2024-01-01T00:00:01 Machine:M"), k, F.lit(" (LOT a)\nSYSTEM WARNING: ER-"), k, F.lit(" HOT_PLATE\n>> temp=5 reason=x\n>> code="), k, F.lit("\nfree text"))
    b = ln.context_block(F.when(F.col("event_id") % 3 == 0, "no header").otherwise(text))
    return dealt(s, d, "events").select("event_id", b["tool_id"].alias("tool_id"), b["event_prefix"].alias("event_prefix"), b["event_code"].alias("event_code"), b["payload"]["code"].alias("code"))


def kinds_of_files(s, d):
    """Lines of files of one kind each: pairs, labels, plain words."""
    kind = F.col("user_id") % 3
    text = F.when(kind == 0, F.concat(F.lit("a=1 b="), F.col("event_id").cast("string"))).when(kind == 1, F.concat(F.lit("label: "), F.col("event_type"))).otherwise("nothing to see")
    return dealt(s, d, "events").select(F.col("user_id").alias("file_id"), F.col("event_id").alias("line_no"), text.alias("text"))


def labelled(s, d):
    """A record of labelled lines with a pair and a word between; a label that comes twice counts last."""
    text = F.concat(F.lit("tool: T"), F.col("user_id").cast("string"), F.lit("\nstatus : "), F.col("event_type"), F.lit("\nfree words k=7\nvalue: 1\nvalue: \""), F.round("value", 2).cast("string"), F.lit("\""))
    return dealt(s, d, "events").select("event_id", ln.extract_kv(text).alias("f"), ln.message_of(text).alias("message"))


def coverage(s, d):
    rows = log_lines(s, d).withColumn("text", F.when((F.col("file_id") % 2 == 0) & (F.col("event_id") % 3 > 0), F.lit("; comment")).otherwise(F.col("text")))
    return ln.spec_coverage(ln.parse_records(rows), rows.groupBy("file_id").agg(F.count(F.lit(1)).alias("n")))


VALUE = "CAST(round(value, 2) AS VARCHAR)"
TOOL = "'T' || CAST(user_id AS VARCHAR)"
STAMP = "strftime(ts, '%Y-%m-%dT%H:%M:%S')"
CASE4 = lambda a, b, c, e: f"CASE event_id % 4 WHEN 0 THEN {a} WHEN 1 THEN {b} WHEN 2 THEN {c} ELSE {e} END"
COVERED = """SELECT user_id % 40 AS file_id, count(*) AS n, count(*) FILTER (WHERE NOT hidden) AS hits, count(*) FILTER (WHERE NOT hidden AND event_id % 4 <> 3) AS times
    FROM (SELECT *, (user_id % 40) % 2 = 0 AND event_id % 3 > 0 AS hidden FROM events) GROUP BY 1"""

QUERIES = {
    "extract_timestamp": lambda s, d: log_lines(s, d).select("event_id", ln.extract_timestamp(F.col("text"))["ts"].alias("ts")),
    "extract_header": lambda s, d: parsed(s, d).select("event_id", "tool_id", "channel", "severity"),
    "extract_event": lambda s, d: parsed(s, d).select("event_id", "event_code"),
    "extract_kv": lambda s, d: parsed(s, d).select("event_id", *[F.col("fields")[c].alias(f"f_{c}") for c in ("temp_C", "to", "reason", "value", "ok", "v")]),
    "promote_fields": lambda s, d: parsed(s, d).select("event_id", "severity", "message"),
    "classify_record": kinds,
    "segment_records": lambda s, d: segments(s, d).select("file_id", "number", "first_line", "text", "source_reference"),
    "context_block": blocks,
    "infer_boundary": lambda s, d: ln.infer_boundary(layouts(s, d)),
    "infer_event_payload_styles": lambda s, d: ln.file_votes(log_lines(s, d)).select("file_id", F.array_join("payload_styles", ",").alias("payload_styles"), F.array_join("event_styles", ",").alias("event_styles")),
    "file_votes": lambda s, d: ln.file_votes(log_lines(s, d)).select("file_id", "n", "syslog_hits", "kv_hits"),
    "infer_timestamp_styles": lambda s, d: ln.file_votes(log_lines(s, d)).select("file_id", F.array_join("timestamp_styles", ",").alias("styles")),
    "rank_header_layouts": lambda s, d: ln.file_votes(log_lines(s, d)).select("file_id", F.array_join("layouts", ",").alias("layouts")),
    "line_family": lambda s, d: ln.file_votes(log_lines(s, d)).select("file_id", "kv_score", "syslog_score", "label_score", "family"),
    "line_family_kinds": lambda s, d: ln.file_votes(kinds_of_files(s, d)).select("file_id", "label_score", "family", F.array_join("layouts", ",").alias("layouts")),
    "extract_labels": lambda s, d: labelled(s, d).select("event_id", *[F.col("f")[c].alias(c) for c in ("tool", "status", "value", "k")], "message"),
    "spec_coverage": coverage,
    "free_form_fallback": lambda s, d: ln.free_form_fallback(log_lines(s, d).select("file_id").distinct(), coverage(s, d)),
}

SHARE = "SELECT user_id % 40 AS file_id, count(*) AS n, count(*) FILTER (WHERE event_id % 4 = 0) AS a, count(*) FILTER (WHERE event_id % 4 = 1) AS b, count(*) FILTER (WHERE event_id % 4 = 2) AS c FROM events GROUP BY 1"

ORACLES = {
    "extract_timestamp": f"SELECT event_id, {CASE4(STAMP, repr('Jan  1 00:00:') + ' || lpad(CAST(event_id % 60 AS VARCHAR), 2, ' + repr('0') + ')', STAMP, 'NULL')} AS ts FROM events",
    "extract_header": f"SELECT event_id, {CASE4(TOOL, TOOL, TOOL, 'NULL')} AS tool_id, CASE WHEN event_id % 4 = 1 THEN 'etch' END AS channel, {CASE4(repr('WARN'), repr('INFO'), repr('ERROR'), 'NULL')} AS severity FROM events",
    "extract_event": f"SELECT event_id, {CASE4('NULL', 'upper(event_type)', repr('ALARM'), 'upper(event_type)')} AS event_code FROM events",
    "extract_kv": f"""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN {VALUE} END AS "f_temp_C", CASE WHEN event_id % 4 = 1 THEN 'RUN' END AS f_to,
        CASE WHEN event_id % 4 = 2 THEN 'high temp' END AS f_reason, CASE WHEN event_id % 4 >= 2 THEN {VALUE} END AS f_value, CASE WHEN event_id % 4 = 3 THEN 'true' END AS f_ok,
        CASE WHEN event_id % 4 = 1 THEN {VALUE} END AS f_v FROM events""",
    "promote_fields": f"SELECT event_id, {CASE4(repr('WARN'), repr('INFO'), repr('ERROR'), 'NULL')} AS severity, CASE WHEN event_id % 4 = 0 THEN 'too hot' END AS message FROM events",
    "classify_record": f"""SELECT event_id, CASE WHEN event_id % 4 IN (1, 3) AND event_type = 'error' THEN 'fault_event' ELSE
        {CASE4(repr('sensor_reading'), repr('equipment_state'), repr('fault_event'), repr('sensor_reading'))} END AS record_type FROM events""",
    "segment_records": """WITH l AS (SELECT user_id % 40 AS file_id, event_id AS line_no, event_id % 5 = 0 AS s,
          CASE WHEN event_id % 5 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || ' start' ELSE '  more ' || CAST(event_id AS VARCHAR) END AS text FROM events),
        n AS (SELECT *, count(*) FILTER (WHERE s) OVER (PARTITION BY file_id ORDER BY line_no) AS number FROM l)
        SELECT file_id, number, min(line_no) AS first_line, string_agg(text, chr(10) ORDER BY line_no) AS text, 'block:' || CAST(number AS VARCHAR) AS source_reference FROM n WHERE number > 0 GROUP BY file_id, number""",
    "context_block": "SELECT event_id, CASE WHEN event_id % 3 > 0 THEN 'M' || CAST(event_id AS VARCHAR) END AS tool_id, CASE WHEN event_id % 3 > 0 THEN 'SYSTEM WARNING' END AS event_prefix, CASE WHEN event_id % 3 > 0 THEN 'HOT_PLATE' END AS event_code, CASE WHEN event_id % 3 > 0 THEN CAST(event_id AS VARCHAR) END AS code FROM events",
    "infer_boundary": "SELECT user_id % 30 AS file_id, CASE (user_id % 30) % 3 WHEN 1 THEN 'timestamp' WHEN 2 THEN 'blank' ELSE 'line' END AS boundary FROM events GROUP BY 1, 2",
    "infer_event_payload_styles": f"""SELECT file_id, concat_ws(',', CASE WHEN b > 0 THEN 'brace_kv' END, 'space_kv', CASE WHEN a + c > 0 THEN 'label_value_lines' END) AS payload_styles,
        coalesce(nullif(concat_ws(',', CASE WHEN c > 0 THEN 'header_event_field' END, CASE WHEN b > 0 THEN 'leading_bracket_token' END), ''), 'none') AS event_styles FROM ({SHARE})""",
    "file_votes": f"SELECT file_id, n, a + b + c AS syslog_hits, n AS kv_hits FROM ({SHARE})",
    "infer_timestamp_styles": f"SELECT file_id, coalesce(nullif(concat_ws(',', CASE WHEN b > 0 THEN 'syslog_mmm_dd_hh_mm_ss' END, CASE WHEN a + c > 0 THEN 'iso8601' END), ''), 'none') AS styles FROM ({SHARE})",
    "rank_header_layouts": f"""SELECT file_id, string_agg(layout, ',' ORDER BY votes DESC, k) AS layouts FROM (SELECT file_id, unnest([
          {{'k': 0, 'layout': 'syslog_host_facility_level', 'votes': 3 * b}}, {{'k': 1, 'layout': 'bracket_tool_severity_event', 'votes': 4 * c}}, {{'k': 2, 'layout': 'tool_severity_message', 'votes': 2 * a}},
          {{'k': 3, 'layout': 'tool_token_message', 'votes': a + b + c}}, {{'k': 4, 'layout': 'none', 'votes': 4 * (n - a - b - c)}}], recursive := true) FROM ({SHARE})) WHERE votes > 0 GROUP BY 1""",
    "line_family": f"""SELECT file_id, 1.0::DOUBLE AS kv_score, round((a + b + c + e) / n, 6) AS syslog_score, round((a + b + c) / n, 6) AS label_score, CASE WHEN round((a + b + c + e) / n, 9) >= 1 THEN 'syslog_like_log' ELSE 'kv_line_log' END AS family
        FROM ({SHARE}) JOIN (SELECT user_id % 40 AS file_id, count(*) FILTER (WHERE event_id % 4 = 3 AND event_type = 'error') AS e FROM events GROUP BY 1) USING (file_id)""",
    "line_family_kinds": """SELECT DISTINCT user_id AS file_id, CASE user_id % 3 WHEN 1 THEN 1 ELSE 0 END::DOUBLE AS label_score, CASE user_id % 3 WHEN 0 THEN 'kv_line_log' WHEN 1 THEN 'labeled_text_block' ELSE 'unknown_text' END AS family,
        CASE user_id % 3 WHEN 0 THEN 'none' ELSE 'tool_token_message' END AS layouts FROM events""",
    "extract_labels": f"SELECT event_id, 'T' || CAST(user_id AS VARCHAR) AS tool, event_type AS status, {VALUE} AS value, '7' AS k, 'free words' AS message FROM events",
    "spec_coverage": f"""SELECT file_id, round(hits / n, 6) AS coverage, round(times / n, 6) AS timestamp_ratio, round(hits / n, 6) AS structure_ratio,
        round(hits / n, 6) >= 0.6 AND (round(times / n, 6) >= 0.3 OR round(hits / n, 6) >= 0.4) AS accepted FROM ({COVERED})""",
    "free_form_fallback": f"SELECT file_id FROM ({COVERED}) WHERE NOT (round(hits / n, 6) >= 0.6 AND (round(times / n, 6) >= 0.3 OR round(hits / n, 6) >= 0.4))",
}
