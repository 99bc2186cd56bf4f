"""Queries of format detection, over documents, pages, conversations and event properties as they are, and over events written
as file bodies of eight formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import WHITESPACE
from ..operators import detect as dt
from .nested import conversations
from .tables import dealt, table

KINDS = 8


def bodies(s, d):
    k = F.col("event_id")
    v = F.round("value", 2).cast("string")
    ks = k.cast("string")
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    texts = [
        F.col("props"),
        F.concat(F.lit("<e id=\"1\"><v>"), v, F.lit("</v></e>")),
        F.concat(F.lit("a;b;c\n1;"), v, F.lit(";2\n\n3;4;"), ks),
        F.concat(*[F.concat(stamp, F.lit(" up\n")) for _ in range(3)]),
        F.concat(*[F.concat(F.lit("x="), v, F.lit(" y="), ks, F.lit("\n")) for _ in range(4)]),
        F.concat(F.lit("00ff 12:ab "), F.repeat(F.lit("cafe "), 20)),
        F.concat(F.lit("pump number "), ks, F.lit(" was serviced")),
        F.concat(F.lit("\x00\x01\x02\x80\x81"), ks),
    ]
    text = F.get(F.array(*texts), (k % KINDS).cast("int"))
    ext = F.get(F.array(*[F.lit(x) for x in (".json", ".dat", ".log")]), (k % 3).cast("int"))
    return dealt(s, d, "events").select("event_id", ext.alias("extension"), text.alias("text"))


def texts(s, d):
    """The given texts as files, with the extensions they may have."""
    one = lambda family, rows, ext: rows.select(F.lit(family).alias("family"), F.col(rows.columns[0]).cast("long").alias("id"), F.lit(ext).alias("extension"), F.col(rows.columns[1]).alias("text"))
    return one("document", table(s, d, "documents").select("doc_id", "text"), ".csv").unionByName(one("page", table(s, d, "pages").select("page_id", "html"), ".xml")).unionByName(
        one("conversation", conversations(s, d), ".json")).unionByName(one("props", dealt(s, d, "events").select("event_id", "props"), ".log"))


def plain_texts(s, d):
    return texts(s, d).where("family in ('document', 'page')")


def scored(s, d):
    """The best delimiter of every text and of every written body."""
    both = plain_texts(s, d).select("family", "id", "text").unionByName(bodies(s, d).select(F.lit("body").alias("family"), F.col("event_id").alias("id"), "text"))
    return both.select("family", "id", dt.delimiter_score(dt.non_blank_lines(F.col("text"))).alias("b")).select("family", "id", "b.*")


def routed(s, d):
    return dt.route_file(dt.support_lookup(dt.detect_format(bodies(s, d))))


QUERIES = {
    "printable_ratio": lambda s, d: bodies(s, d).select("event_id", F.round(dt.printable_ratio(F.col("text")), 6).alias("ratio")),
    "is_json_is_xml": lambda s, d: bodies(s, d).select("event_id", dt.is_json(F.col("text")).alias("json"), dt.is_xml(F.col("text")).alias("xml")),
    "is_delimited": lambda s, d: bodies(s, d).select("event_id", dt.is_delimited(F.col("text")).alias("delimited")),
    "delimiter_score": scored,
    "detect_texts": lambda s, d: dt.detect_format(texts(s, d)).select("family", "id", "format_guess", "confidence"),
    "sniff_texts": lambda s, d: texts(s, d).select("family", "id", dt.sniff_unknown(F.col("text")).alias("format_guess")),
    "text_ratios": lambda s, d: plain_texts(s, d).select("family", "id", F.round(dt.printable_ratio(F.col("text")), 6).alias("printable"), F.round(dt.hex_dump_ratio(F.col("text")), 6).alias("hex"), dt.is_delimited(F.col("text")).alias("delimited")),
    "syslog_kv_hits": lambda s, d: bodies(s, d).select("event_id", dt.line_hits(F.col("text"), dt.vocab.SYSLOG_LINE).alias("syslog"), dt.line_hits(F.col("text"), dt.vocab.KV_LINE).alias("kv")),
    "hex_dump_ratio": lambda s, d: bodies(s, d).select("event_id", (dt.hex_dump_ratio(F.col("text")) > 0.95).alias("hex")),
    "detect_format": lambda s, d: dt.detect_format(bodies(s, d)).select("event_id", "format_guess", "content_class", "confidence"),
    "support_lookup": lambda s, d: dt.support_lookup(dt.detect_format(bodies(s, d))).groupBy("format_guess", "parser_family", "support_status").agg(F.count(F.lit(1)).alias("n")),
    "route_file": lambda s, d: routed(s, d).select("event_id", "next_route", "processing_mode", "should_attempt_parse"),
    "sniff_unknown": lambda s, d: bodies(s, d).select("event_id", dt.sniff_unknown(F.col("text")).alias("format_guess")),
}


def case(*values):
    return "CASE event_id % 8 " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def q(*values):
    return [f"'{v}'" for v in values]


FORMATS = case(*q("json", "xml", "csv", "syslog_like_text", "key_value_text", "hex_dump_text", "free_text_log", "opaque_binary"))
DETECTED = f"SELECT event_id, {FORMATS} AS format_guess FROM events"
# Lines, delimiter scores and ratios of the documents' and pages' texts.
SPACE = " || ".join(f"chr({ord(c)})" for c in WHITESPACE)
JUDGED = rf"""
t AS (SELECT 'document' AS family, doc_id AS id, text FROM documents UNION ALL SELECT 'page', page_id, html FROM pages),
l AS (SELECT *, list_filter(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: trim(x, {SPACE}) <> '') AS lines FROM t),
w AS (SELECT l.*, k, d, list_transform(lines, lambda x: len(string_split(x, d))) AS c FROM l, (VALUES (0, ','), (1, ';'), (2, chr(9)), (3, '|')) AS v(k, d)),
s AS (SELECT *, len(c) >= 2 AND list_max(c) > 1 AS fits FROM w),
best AS (
  SELECT family, id, text, lines, d, c, CASE WHEN fits THEN CASE WHEN c[1] > 1 THEN len(list_filter(c, lambda x: x = c[1])) - 1 ELSE 0 END ELSE -1 END AS score, CASE WHEN fits THEN c[1] ELSE -1 END AS width
  FROM s QUALIFY row_number() OVER (PARTITION BY family, id ORDER BY 7 DESC, 8 DESC, k) = 1),
judged AS (
  SELECT *, CASE WHEN length(text) > 0 THEN 1 - length(regexp_replace(text, '[\x20-\x7E\t\n\r]+', '', 'g')) / length(text) ELSE 1 END AS printable,
    CASE WHEN trim(text, {SPACE}) <> '' THEN 1 - length(regexp_replace(text, '[0-9a-fA-F \n\r\t:]+', '', 'g')) / length(text) ELSE 0 END AS hex,
    len(lines) >= 2 AND coalesce(c[1] >= 3 AND list_min(c) = c[1] AND list_max(c) = c[1], false) AS delimited FROM best)"""
JUDGED = JUDGED.replace("ORDER BY 7 DESC, 8 DESC", "ORDER BY score DESC, width DESC")

ORACLES = {
    "printable_ratio": f"SELECT event_id, round({case('1', '1', '1', '1', '1', '1', '1', '1 - 5.0 / (5 + length(CAST(event_id AS VARCHAR)))')}, 6)::DOUBLE AS ratio FROM events",
    "is_json_is_xml": "SELECT event_id, event_id % 8 = 0 AS json, event_id % 8 = 1 AS xml FROM events",
    "is_delimited": "SELECT event_id, event_id % 8 = 2 AS delimited FROM events",
    "delimiter_score": f"""WITH {JUDGED} SELECT family, id, CAST(score AS INTEGER) AS score, CAST(width AS INTEGER) AS width, d AS delimiter FROM best
        UNION ALL SELECT 'body', event_id, {case(-1, -1, 2, -1, -1, -1, -1, -1)}, {case(-1, -1, 3, -1, -1, -1, -1, -1)}, {case(*q(',', ',', ';', ',', ',', ',', ',', ','))} FROM events""",
    # No document is JSON or markup, and no page is well-formed markup.
    "detect_texts": rf"""WITH {JUDGED}, v AS (
          SELECT *, trim(text, {SPACE}) AS body, list_transform(lines, lambda x: trim(x, {SPACE})) AS b FROM judged),
        n AS (SELECT *, greatest(3, len(b) // 3) AS enough, len(list_filter(b, lambda x: regexp_matches(x, '{dt.vocab.SYSLOG_LINE}'))) AS syslog, len(list_filter(b, lambda x: regexp_matches(x, '{dt.vocab.KV_LINE}'))) AS kv,
          CASE WHEN body <> '' THEN 1 - length(regexp_replace(body, '[0-9a-fA-F 

	:]+', '', 'g')) / length(body) ELSE 0 END AS dump FROM v),
        f AS (SELECT family, id, CASE WHEN delimited AND family = 'document' THEN 'csv' WHEN printable < 0.9 THEN 'opaque_binary' WHEN delimited THEN 'csv' WHEN body = '' THEN 'empty_text' WHEN syslog >= enough THEN 'syslog_like_text'
          WHEN kv >= enough THEN 'key_value_text' WHEN dump > 0.95 THEN 'hex_dump_text' ELSE 'free_text_log' END AS format_guess FROM n)
        SELECT family, id, format_guess, CASE format_guess WHEN 'csv' THEN 0.95 WHEN 'opaque_binary' THEN 0.9 WHEN 'empty_text' THEN 0.6 WHEN 'syslog_like_text' THEN 0.88 WHEN 'key_value_text' THEN 0.86 WHEN 'hex_dump_text' THEN 0.78 ELSE 0.7 END::DOUBLE AS confidence FROM f
        UNION ALL SELECT DISTINCT 'conversation', conv_id, 'json', 0.99::DOUBLE FROM conversations UNION ALL SELECT 'props', event_id, 'json', 0.98::DOUBLE FROM events""",
    "text_ratios": f"WITH {JUDGED} SELECT family, id, round(printable, 6) AS printable, round(hex, 6) AS hex, delimited FROM judged",
    "syslog_kv_hits": f"SELECT event_id, {case(0, 0, 0, 3, 0, 0, 0, 0)} AS syslog, {case(0, 1, 0, 0, 4, 0, 0, 0)} AS kv FROM events",
    "hex_dump_ratio": "SELECT event_id, event_id % 8 = 5 AS hex FROM events",
    "detect_format": f"""SELECT event_id, {FORMATS} AS format_guess, {case(*q('structured_text', 'structured_text', 'structured_text', 'semi_structured_text', 'semi_structured_text', 'unstructured_text', 'unstructured_text', 'binary'))} AS content_class,
        CASE event_id % 8 WHEN 0 THEN CASE WHEN event_id % 3 = 0 THEN 0.99 ELSE 0.98 END WHEN 1 THEN 0.98 WHEN 2 THEN 0.95 WHEN 3 THEN 0.88 WHEN 4 THEN 0.86 WHEN 5 THEN 0.78 WHEN 6 THEN 0.7 ELSE 0.9 END::DOUBLE AS confidence FROM events""",
    "support_lookup": f"""SELECT format_guess, CASE WHEN format_guess IN ('json', 'csv', 'xml') THEN 'structured_parser' WHEN format_guess IN ('syslog_like_text', 'key_value_text') THEN 'semi_structured_parser'
        WHEN format_guess = 'opaque_binary' THEN 'binary_parser' ELSE 'unstructured_parser' END AS parser_family, CASE WHEN format_guess = 'opaque_binary' THEN 'partially_supported' ELSE 'supported' END AS support_status, count(*) AS n FROM ({DETECTED}) GROUP BY 1""",
    "route_file": f"""SELECT event_id, CASE WHEN format_guess IN ('json', 'csv', 'xml') THEN 'structured_parser' WHEN format_guess IN ('syslog_like_text', 'key_value_text') THEN 'semi_structured_parser'
        WHEN format_guess = 'opaque_binary' THEN 'binary_parser' ELSE 'unstructured_parser' END AS next_route, CASE WHEN format_guess IN ('json', 'csv', 'xml') THEN 'direct_parse' WHEN format_guess IN ('syslog_like_text', 'key_value_text') THEN 'regex_or_rule_parse'
        WHEN format_guess = 'opaque_binary' THEN 'partial_decode_or_synthetic_decoder' ELSE 'llm_or_extraction_fallback' END AS processing_mode, true AS should_attempt_parse FROM ({DETECTED})""",
    "sniff_unknown": f"SELECT event_id, {case(*q('json', 'xml', 'csv', 'free_form_text', 'key_value_text', 'free_form_text', 'free_form_text', 'opaque_binary'))} AS format_guess FROM events",
}
