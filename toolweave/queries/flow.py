"""Queries of the joined flow: every event is a file of one of five kinds, from its text to validated records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import flow
from .tables import dealt

KINDS = 5


def event_files(s, d):
    """A JSON list, a delimited table, markup, state lines or prose, told by the id; no extension gives the kind away."""
    k, tool = F.col("event_id"), F.concat(F.lit("T"), (F.col("user_id") % 17).cast("string"))
    v = F.round("value", 2).cast("string")
    item = lambda step: F.concat(F.lit('{"tool_id":"'), tool, F.lit('","parameter":"overlap","value":'), v, F.lit(f',"step":"{step}"}}'))
    node = lambda step: F.concat(F.lit("<r><tool_id>"), tool, F.lit("</tool_id><parameter>overlap</parameter><value>"), v, F.lit(f"</value><step>{step}</step></r>"))
    row = lambda step: F.concat(tool, F.lit(",overlap,"), v, F.lit(f",{step}\n"))
    line = F.concat(F.lit("tool_id="), tool, F.lit(" new_state=RUN from_state=IDLE\n"))
    texts = [
        F.concat(F.lit("["), item("S1"), F.lit(","), item("S2"), F.lit("]")),
        F.concat(F.lit("tool_id,parameter,value,step\n"), row("S1"), F.lit("\n"), row("S2")),
        F.concat(F.lit("<log>"), node("S1"), node("S2"), F.lit("</log>")),
        F.concat(line, line, F.lit("\n"), line),
        F.concat(F.lit("pump number "), k.cast("string"), F.lit(" was serviced")),
    ]
    return dealt(s, d, "events").select(k.alias("file_id"), F.concat(F.lit("f"), k.cast("string"), F.lit(".dat")).alias("filename"), F.lit(".dat").alias("extension"), F.get(F.array(*texts), (k % KINDS).cast("int")).alias("text"))


def _records(s, d):
    f = F.col("normalized_fields")
    done = flow.validated_records(flow.routed_files(event_files(s, d)))
    return done.select("file_id", "source_reference", "record_type", "validation_reason", f["tool_id"].alias("tool_id"), F.round(f["value"].cast("double"), 2).alias("value"), f["step"].alias("step"), f["curr_state"].alias("curr_state"))


def _report(s, d):
    routed = flow.routed_files(event_files(s, d))
    return flow.file_report(routed, flow.validated_records(routed))


QUERIES = {"file_flow": _records, "file_report": _report}

ORACLES = {
    "file_flow": """SELECT event_id AS file_id, CASE event_id % 5 WHEN 0 THEN 'item:' || n WHEN 1 THEN 'row:' || (n + 1) WHEN 2 THEN 'record:' || n ELSE 'line:' || (CASE n WHEN 3 THEN 4 ELSE n END) END AS source_reference,
        CASE event_id % 5 WHEN 3 THEN 'equipment_state' ELSE 'sensor_reading' END AS record_type, 'ok' AS validation_reason, 'T' || CAST(user_id % 17 AS VARCHAR) AS tool_id,
        CASE WHEN event_id % 5 <> 3 THEN round(value, 2) END AS value, CASE WHEN event_id % 5 <> 3 THEN 'S' || n END AS step, CASE WHEN event_id % 5 = 3 THEN 'RUN' END AS curr_state
        FROM events, (VALUES (1), (2), (3)) AS v(n) WHERE event_id % 5 < 3 AND n < 3 OR event_id % 5 = 3""",
    "file_report": """SELECT event_id AS file_id, CASE event_id % 5 WHEN 0 THEN 'json' WHEN 1 THEN 'csv' WHEN 2 THEN 'xml' WHEN 3 THEN 'key_value_text' ELSE 'free_text_log' END AS source_format,
        CASE event_id % 5 WHEN 3 THEN 'semi_structured_parser' WHEN 4 THEN 'unstructured_parser' ELSE 'structured_parser' END AS parser_route,
        CASE event_id % 5 WHEN 0 THEN 'json' WHEN 1 THEN 'csv' WHEN 2 THEN 'xml' WHEN 3 THEN 'lines' ELSE 'none' END AS lane,
        CASE event_id % 5 WHEN 3 THEN 3 WHEN 4 THEN 0 ELSE 2 END AS accepted_count, 0 AS rejected_count FROM events""",
}
