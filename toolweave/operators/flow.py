"""From a table of files to validated records: detection, routing, a lane for each format, then the record chain.

Files are routed once and written by lane, so each lane reads its own files alone. A lane is a narrow plan (a file's text is
one value, its records are rows), and what comes out of the lanes is one table of parsed records. Files of no lane (free
text, hex dumps, binaries) give no record here; the report names them with their route.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import staged
from ..functions.maps import bag_of_present, last_of
from . import detect, lines, markup, tables_in
from .canonical import canonicalize
from .normalize import normalize
from .standardize import standardize
from .validate import accept_reject_counts, validate

LANE_OF_FORMAT = {"json": "json", "csv": "csv", "xml": "xml", "syslog_like_text": "lines", "key_value_text": "lines"}
NO_LANE = "none"
FILE = ("file_id", "filename", "source_format", "parser_route")


def routed_files(files: DataFrame) -> DataFrame:
    """files (file_id, filename, extension, text) with source_format, parser_route, processing_mode and lane, written once.

    A null text is an empty file, a null extension none; both have no lane. Columns named like an output are replaced.
    """
    plain = files.select("file_id", "filename", "extension", F.coalesce("text", F.lit("")).alias("text"))
    routed = detect.route_file(detect.support_lookup(detect.detect_format(plain)))
    lane = F.coalesce(*[F.when((F.col("format_guess") == k) & F.col("should_attempt_parse"), v) for k, v in LANE_OF_FORMAT.items()], F.lit(NO_LANE))
    return staged(routed.select("file_id", "filename", "text", F.col("format_guess").alias("source_format"), F.col("next_route").alias("parser_route"), "processing_mode", lane.alias("lane")), "routed")


def _typed(rows: DataFrame, data: Column, reference: Column, event: dict[str, Column] | None = None) -> DataFrame:
    """Parsed records of a lane: the type a record names, else a reading if it has a parameter and its value and is no line
    with an event of its own, else the type its event and fields speak for."""
    made = rows.select(*FILE, data.alias("data"), reference.alias("source_reference"), *[c.alias(n) for n, c in (event or {}).items()])
    none = F.lit(None).cast("string")
    code, kind, severity = (F.col(c) if event else none for c in ("event_code", "event_type", "severity"))
    fields = F.coalesce("data", F.create_map().cast("map<string,string>"))
    judged = lines.classify_record(code, kind, severity, none, fields)
    own = F.nullif(fields["record_type"], F.lit(""))
    if event is None:
        reading = F.map_contains_key(fields, F.lit("parameter")) & F.map_contains_key(fields, F.lit("value"))
        own = F.coalesce(own, F.when(reading, "sensor_reading"))
    return made.select(*FILE, "source_reference", fields.alias("data"), F.coalesce(own, F.when(judged == "generic_text_record", "generic_operational_observation").otherwise(judged)).alias("record_type"))


def parsed_records(routed: DataFrame) -> DataFrame:
    """(file_id, filename, source_format, parser_route, source_reference, data, record_type) of all lanes' files.

    JSON: items of the list; XML: record nodes; CSV: rows as wide as the header; lines: each line that isn't blank. Lists and
    objects within a record are kept as JSON text.
    """
    lane = lambda name: routed.where(F.col("lane") == name).select(*FILE, "text")
    flat = lambda item: last_of(F.map_entries(F.from_json(item, "map<string,string>")))
    place = lambda word, c: F.concat(F.lit(f"{word}:"), F.col(c).cast("string"))
    line = tables_in.read_lines(lane("lines")).where(F.trim("line") != "")
    told = lines.parse_records(line.select(*FILE, "line_no", F.col("line").alias("text")))
    head = bag_of_present({"timestamp": F.col("ts"), "tool_id": F.col("tool_id"), "severity": F.col("severity"), "event_name": F.col("event_type"), "message": F.col("message")})
    both = last_of(F.concat(F.map_entries(head), F.map_entries("fields")))
    parts = [
        _typed(tables_in.generic_json_rows(lane("json")), flat(F.col("item")), place("item", "item_no")),
        _typed(markup.xml_record_nodes(lane("xml")), flat(F.col("record")), place("record", "record_no")),
        _typed(tables_in.read_csv_diag(lane("csv")).where(~F.col("malformed")), F.col("fields"), place("row", "row_no")),
        _typed(told, both, place("line", "line_no"), {"event_code": F.col("event_code"), "event_type": F.col("event_type"), "severity": F.col("severity")}),
    ]
    return reduce(DataFrame.unionByName, parts)


def validated_records(routed: DataFrame) -> DataFrame:
    """The lanes' records through the record chain."""
    return validate(normalize(standardize(canonicalize(parsed_records(routed)))))


def file_report(routed: DataFrame, validated: DataFrame) -> DataFrame:
    """One row a file: source_format, parser_route, lane, accepted_count and rejected_count (0 without a record)."""
    counts = accept_reject_counts(validated)
    return routed.select("file_id", "source_format", "parser_route", "lane").join(counts, "file_id", "left").fillna(0, ["accepted_count", "rejected_count"])
