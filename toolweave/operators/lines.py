"""Line and block logs: segmentation, votes on a file's layout, and the fields of one record.

Fields come from narrow column expressions. Votes are grouped means over all lines of a file. Segmentation numbers
blocks by running counts; a file's lines are counted in stretches of STRETCH lines first, so that a file of any length
spreads over tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.maps import first_of, has_any
from ..functions.text import LINE_BREAK, coerce_text, strip

STRETCH = 10_000
STARTS_BLOCK = r"^(\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2})[T\s]\d{2}:\d{2}:\d{2}"  # one pattern for inference and segmentation
BRACE = r"(?s)\{(.*)\}"
LAYOUTS = ("syslog_host_facility_level", "bracket_tool_severity_event", "tool_severity_message", "tool_token_message")
ENTRIES = "array<struct<key:string,value:string>>"


def _group(text: Column, pattern: str, k: int) -> Column:
    """A group of the first match, or null where nothing matches."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, k))


def extract_timestamp(raw: Column) -> Column:
    """struct(ts, rest): a leading syslog or ISO time and what follows; ts is null and rest the whole text without one."""
    ts = F.coalesce(_group(raw, vocab.SYSLOG_TS, 1), _group(raw, vocab.ISO_TS, 1))
    rest = F.coalesce(_group(raw, vocab.SYSLOG_TS, 2), _group(raw, vocab.ISO_TS, 2), raw)
    return F.struct(ts.alias("ts"), rest.alias("rest"))


def _header(**parts: Column) -> Column:
    names = ("tool_id", "channel", "severity", "event_code", "event_type", "header_token", "body")
    return F.struct(*[parts.get(n, F.lit(None).cast("string")).alias(n) for n in names])


def extract_header(text: Column, layouts=LAYOUTS) -> Column:
    """struct(tool_id, channel, severity, event_code, event_type, header_token, body) by the first layout that fits."""
    g = lambda p, k: F.regexp_extract(text, p, k)
    parts = F.split(strip(text), r"\s+", 3)
    first, second = F.get(parts, 0), F.get(parts, 1)
    upper = (F.upper(second) == second) & (F.lower(second) != second)
    made = {
        "syslog_host_facility_level": (text.rlike(vocab.HOST_FACILITY), _header(
            tool_id=g(vocab.HOST_FACILITY, 1), channel=g(vocab.HOST_FACILITY, 2), severity=g(vocab.HOST_FACILITY, 3), body=g(vocab.HOST_FACILITY, 4))),
        "bracket_tool_severity_event": (text.rlike(vocab.BRACKET_TOOL), _header(
            tool_id=g(vocab.BRACKET_TOOL, 1), severity=g(vocab.BRACKET_TOOL, 2), event_code=g(vocab.BRACKET_TOOL, 3), event_type=g(vocab.BRACKET_TOOL, 3), body=g(vocab.BRACKET_TOOL, 4))),
        "tool_severity_message": (text.rlike(vocab.TOOL_SEVERITY), _header(
            tool_id=g(vocab.TOOL_SEVERITY, 1), severity=g(vocab.TOOL_SEVERITY, 2), body=g(vocab.TOOL_SEVERITY, 3))),
        "tool_token_message": (second.isNotNull() & ~F.contains(first, F.lit("=")) & ~F.contains(second, F.lit("=")), _header(
            tool_id=first, event_type=F.when(upper, second), header_token=F.when(~upper, second), body=F.coalesce(F.get(parts, 2), F.lit("")))),
    }
    chosen = [F.when(*made[name]) for name in layouts]
    return F.coalesce(*chosen, _header(body=text))


def extract_event(body: Column, known: Column) -> Column:
    """struct(event_code, body): the leading event token, unless a code is known already."""
    text = strip(body)
    patterns = (vocab.BRACKET_EVENT, vocab.GT_EVENT, vocab.UPPER_EVENT)
    none = F.struct(F.lit(None).cast("string").alias("event_code"), text.alias("body"))
    found = [
        F.when(text.rlike(p), F.struct(strip(F.regexp_extract(text, p, 1)).alias("event_code"), strip(F.regexp_extract(text, p, 2)).alias("body"))) for p in patterns
    ]
    return F.when(known.isNotNull() & (known != ""), F.struct(known.alias("event_code"), body.alias("body"))).otherwise(F.coalesce(*found, none))


def _value(v: Column) -> Column:
    """A value's scalar text: commas and closing braces at its edges and enclosing quotes dropped, empty is null."""
    bare = strip(F.btrim(strip(v), F.lit(",}")))
    quoted = bare.startswith('"') & bare.endswith('"') & (F.length(bare) >= 2)
    inner = F.when(quoted, F.substr(bare, F.lit(2), F.length(bare) - 2)).otherwise(bare)
    return F.when(inner != "", coerce_text(inner))


def _labelled(rest: Column) -> Column:
    """Entries of the lines `label: value` of what pairs leave of a text."""
    lines = F.filter(F.split(rest, LINE_BREAK), lambda x: x.rlike(vocab.LABEL_VALUE))
    return F.transform(lines, lambda x: F.struct(F.regexp_extract(x, vocab.LABEL_VALUE, 1).alias("key"), _value(F.regexp_extract(x, vocab.LABEL_VALUE, 2)).alias("value")))


def extract_kv(text: Column) -> Column:
    """Fields of `{a=b, c=d}`, of `a=b c="d e"` and of lines `label: value` as an ordered bag. A label counts over a pair
    outside braces, and that over one inside; of repeated ones the last label, the first pair, the last one in braces."""
    inner = F.regexp_extract(text, BRACE, 1)
    outside = F.when(text.rlike(BRACE), F.regexp_replace(text, BRACE, "  ")).otherwise(text)
    braced = F.filter(
        F.transform(F.split(inner, ","), lambda x: F.struct(strip(F.regexp_extract(x, r"(?s)^([^=]*)=", 1)).alias("key"), _value(F.regexp_extract(x, r"(?s)^[^=]*=(.*)$", 1)).alias("value"))),
        lambda e: e["key"] != "",
    )
    keys, values = F.regexp_extract_all(outside, F.lit(vocab.KV_PAIR), F.lit(1)), F.regexp_extract_all(outside, F.lit(vocab.KV_PAIR), F.lit(2))
    spaced = F.zip_with(keys, values, lambda k, v: F.struct(k.alias("key"), _value(v).alias("value")))
    labels = F.when(text.contains(":"), _labelled(F.regexp_replace(outside, vocab.KV_PAIR, " "))).otherwise(F.slice(spaced, 1, 0))
    return first_of(F.concat(F.reverse(labels), spaced, F.reverse(braced)))


def message_of(text: Column) -> Column:
    """What is left of a text without its pairs and labelled lines, in one line."""
    rest = F.regexp_replace(F.regexp_replace(text, BRACE, "  "), vocab.KV_PAIR, " ")
    rest = F.when(rest.contains(":"), F.array_join(F.filter(F.split(rest, LINE_BREAK), lambda x: ~x.rlike(vocab.LABEL_VALUE)), "\n")).otherwise(rest)
    return F.btrim(F.regexp_replace(rest, r"\s+", " "), F.lit(" -:;"))


def context_block(raw: Column) -> Column:
    """struct(ts, tool_id, context, event_prefix, event_ref, event_code, payload) of a block that starts with a context
    header, else null."""
    lines = F.filter(F.transform(F.split(raw, r"\r?\n"), strip), lambda x: x != "")
    first, second = F.get(lines, 0), F.get(lines, 1)
    more = F.filter(F.slice(lines, F.lit(3), F.greatest(F.size(lines) - 2, F.lit(0))), lambda x: x.startswith(">>"))
    payload = extract_kv(F.array_join(F.transform(more, lambda x: strip(F.substr(x, F.lit(3)))), " "))
    made = F.struct(
        *[F.regexp_extract(first, vocab.CONTEXT_HEADER, k).alias(n) for k, n in enumerate(("ts", "tool_id", "context"), 1)],
        *[_group(second, vocab.CONTEXT_EVENT, k).alias(n) for k, n in enumerate(("event_prefix", "event_ref", "event_code"), 1)],
        payload.alias("payload"),
    )
    return F.when(F.coalesce(first.rlike(vocab.CONTEXT_HEADER), F.lit(False)), made)


def parse_records(records: DataFrame, text_col: str = "text") -> DataFrame:
    """records with ts, tool_id, channel, severity (upper case), event_code, event_type, message and fields.

    A field named event gives the event code where the line has none, a field named datetime its time. Records that
    are comments alone (every line starts with ;) go.
    """
    raw = strip(F.col(text_col))
    comment = F.forall(F.filter(F.transform(F.split(raw, r"\r?\n"), strip), lambda x: x != ""), lambda x: x.startswith(";"))
    made = records.where((raw != "") & ~comment).withColumn("__t", extract_timestamp(raw))
    made = made.withColumn("__h", extract_header(F.col("__t.rest")))
    made = made.withColumn("__e", extract_event(F.col("__h.body"), F.col("__h.event_code")))
    made = made.withColumn("fields", extract_kv(F.col("__e.body")))
    event = F.coalesce("__e.event_code", F.col("fields")["event"])
    names = [c for c in records.columns if c != text_col]
    return made.select(
        *names, F.coalesce("__t.ts", F.col("fields")["datetime"]).alias("ts"), F.col("__h.tool_id").alias("tool_id"), F.col("__h.channel").alias("channel"),
        F.upper("__h.severity").alias("severity"), event.alias("event_code"), F.coalesce("__h.event_type", event).alias("event_type"),
        F.nullif(message_of(F.col("__e.body")), F.lit("")).alias("message"), "fields",
    )


def classify_record(event_code: Column, event_type: Column, severity: Column, event_prefix: Column, fields: Column) -> Column:
    """Record type by event code, prefix, explicit codes, fields and severity, in that order."""
    code, kind, prefix = (F.upper(F.coalesce(c, F.lit(""))) for c in (event_code, event_type, event_prefix))
    hints = vocab.CLASSIFICATION_HINTS
    by_code = lambda t: (code != "") & code.isin(*hints[t][0]) | (kind != "") & kind.isin(*hints[t][0])
    has = lambda keys: has_any(fields, keys)
    system = prefix.startswith("SYSTEM WARNING") | prefix.startswith("SYSTEM ERROR")
    state = F.when(has(["fault"]), "fault_event").otherwise("equipment_state")
    steps = [(by_code(t), F.lit(t)) for t in vocab.CLASSIFICATION_PRIORITY if hints[t][0]]
    steps += [
        (prefix.startswith("SENSOR"), F.lit("sensor_reading")),
        (system & (has(vocab.FAULT_FIELDS) | code.isin(*vocab.PREFIX_FAULT_CODES)), F.lit("fault_event")),
        (code.isin(*vocab.STATE_CODES), state),
        (code.isin(*vocab.RECIPE_CODES), F.lit("process_parameter_recipe")),
        (code.isin(*vocab.SENSOR_CODES), F.lit("sensor_reading")),
        (code.isin(*vocab.FAULT_CODES) | system | code.isin(*vocab.LATE_FAULT_CODES), F.lit("fault_event")),
        (code.isin(*vocab.SEQUENCE_CODES), F.lit("wafer_processing_sequence")),
    ]
    steps += [(has(hints[t][1]), F.lit(t)) for t in vocab.CLASSIFICATION_PRIORITY if hints[t][1]]
    steps += [
        (F.upper(F.coalesce(severity, F.lit(""))).isin(*vocab.SEVERE_LEVELS) & has(vocab.FAULT_FIELDS), F.lit("fault_event")),
        (has(vocab.STATE_FIELDS), state),
        (has(vocab.RECIPE_FIELDS), F.lit("process_parameter_recipe")),
        (has(vocab.SENSOR_FIELDS), F.lit("sensor_reading")),
        (has(vocab.SEQUENCE_FIELDS), F.lit("wafer_processing_sequence")),
    ]
    return F.coalesce(*[F.when(c, t) for c, t in steps], F.lit("generic_text_record"))


def segment_records(lines: DataFrame, boundary: str = "line", file_col: str = "file_id", stretch: int = STRETCH) -> DataFrame:
    """lines (file, line_no, text) to records (file, number, first_line, text, source_reference).

    boundary: line (a record each non-blank line), blank (blocks between blank lines) or timestamp (blocks that start
    with an ISO time; lines before the first and comments go).
    """
    rows = lines.select(file_col, "line_no", F.col("text"))
    blank = strip(F.col("text")) == ""
    if boundary == "line":
        return rows.where(~blank).select(file_col, F.col("line_no").alias("number"), F.col("line_no").alias("first_line"), "text",
                                         F.concat(F.lit("line:"), F.col("line_no").cast("string")).alias("source_reference"))
    if boundary == "timestamp":
        rows = rows.where(~blank & ~strip(F.col("text")).startswith(";"))
        start = strip(F.col("text")).rlike(STARTS_BLOCK)
    else:
        start = blank
    rows = rows.withColumns({"__s": start.cast("int"), "__k": F.floor(F.col("line_no") / stretch)})
    sums = rows.groupBy(file_col, "__k").agg(F.sum("__s").alias("n"))
    before = Window.partitionBy(file_col).orderBy("__k").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(file_col, "__k", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy(file_col, "__k").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    numbered = rows.withColumn("__n", F.sum("__s").over(within)).join(sums, [file_col, "__k"]).withColumn("__block", F.col("__n") + F.col("__before"))
    numbered = numbered.where(F.col("__block") > 0) if boundary == "timestamp" else numbered.where(F.col("__s") == 0)
    blocks = numbered.groupBy(file_col, "__block").agg(F.min("line_no").alias("first_line"), F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("l"))
    if boundary == "timestamp":  # the starts have numbered the blocks without a gap
        blocks = blocks.withColumn("number", F.col("__block"))
    else:
        blocks = blocks.withColumn("__k", F.floor(F.col("first_line") / stretch))
        sums = blocks.groupBy(file_col, "__k").agg(F.count(F.lit(1)).alias("n"))
        sums = sums.select(file_col, "__k", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
        order = Window.partitionBy(file_col, "__k").orderBy("__block")
        blocks = blocks.withColumn("__n", F.row_number().over(order)).join(sums, [file_col, "__k"]).withColumn("number", F.col("__n") + F.col("__before"))
    return blocks.select(
        file_col, F.col("number").cast("long").alias("number"), "first_line", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("text"),
        F.concat(F.lit("block:"), F.col("number").cast("string")).alias("source_reference"),
    )


def infer_boundary(lines: DataFrame, file_col: str = "file_id") -> DataFrame:
    """(file, boundary): timestamp where two or more blank-separated blocks have several lines and half of all blocks
    start with a time, blank where two or more have several lines, else line."""
    blocks = segment_records(lines, "blank", file_col)
    votes = blocks.groupBy(file_col).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("text").contains("\n")).alias("several"), F.count_if(strip(F.col("text")).rlike(STARTS_BLOCK)).alias("timed")
    )
    several = F.col("several") >= 2
    return votes.select(file_col, F.when(several & (2 * F.col("timed") >= F.col("n")), "timestamp").when(several, "blank").otherwise("line").alias("boundary"))


def file_votes(lines: DataFrame, file_col: str = "file_id", first_lines: int | None = None) -> DataFrame:
    """One row a file: how its non-blank lines look. first_lines limits the vote to a file's first lines.

    n, syslog_hits, kv_hits, timestamp styles, layout ranking, event and payload styles (none where nothing is found), and
    the line family with its three scores.
    """
    rows = lines.where(strip(F.col("text")) != "")
    if first_lines is not None:
        rows = rows.where(F.col("line_no") <= first_lines)
    text = strip(F.col("text"))
    rest = extract_timestamp(text)["rest"]
    parts = F.split(strip(rest), r"\s+", 3)
    flat = F.coalesce(F.contains(F.get(parts, 0), F.lit("=")) & F.contains(F.get(parts, 1), F.lit("=")), F.lit(False))
    facility, bracket, severity = rest.rlike(vocab.HOST_FACILITY), rest.rlike(vocab.BRACKET_TOOL), rest.rlike(vocab.TOOL_SEVERITY)
    matched = {
        "syslog_host_facility_level": facility, "bracket_tool_severity_event": bracket, "tool_severity_message": severity,
        "tool_token_message": F.get(parts, 1).isNotNull() & ~flat, "none": flat,
    }
    body = F.coalesce(*[F.when(fits, F.regexp_extract(rest, p, k)) for fits, p, k in ((facility, vocab.HOST_FACILITY, 4), (bracket, vocab.BRACKET_TOOL, 4), (severity, vocab.TOOL_SEVERITY, 3))], rest)
    events = {
        "header_event_field": bracket & ~facility, "leading_bracket_token": body.rlike(vocab.BRACKET_EVENT),
        "token_before_gt": body.rlike(vocab.GT_EVENT), "leading_upper_token": body.rlike(vocab.UPPER_EVENT),
    }
    kv, stamped, level = F.regexp_count(text, F.lit(vocab.FAMILY_KV)) >= 2, text.rlike(vocab.FAMILY_TS_PREFIX), text.rlike(vocab.FAMILY_LEVELS)
    marked = stamped & (text.rlike(vocab.FAMILY_FACILITY) | text.rlike(vocab.FAMILY_TAG) | level) | level & (F.size(F.split(text, r"\s+")) >= 4)
    labelled = text.rlike(r"(?s)^[^:]*[^:\s][^:]*:.*\S")
    votes = rows.groupBy(file_col).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(text.rlike(vocab.SYSLOG_LINE)).alias("syslog_hits"), F.count_if(text.rlike(vocab.KV_LINE)).alias("kv_hits"),
        F.count_if(text.rlike(vocab.SYSLOG_TS)).alias("syslog_times"), F.count_if(text.rlike(vocab.ISO_TS)).alias("iso_times"),
        *[F.count_if(c).alias(f"__{n}") for n, c in (matched | events).items()],
        F.count_if(text.rlike(BRACE) & text.contains("=")).alias("brace_kv"), F.count_if(kv).alias("space_kv"), F.count_if(text.rlike(vocab.LABEL_VALUE)).alias("label_value_lines"),
        F.avg(kv.cast("int")).alias("kv_score"), F.avg(marked.cast("int")).alias("syslog_score"), F.avg(labelled.cast("int")).alias("label_score"),
    )
    ranked = F.filter(
        F.array_sort(F.array(*[F.struct((-vocab.LAYOUT_WEIGHTS[n] * F.col(f"__{n}")).alias("votes"), F.lit(k).alias("k"), F.lit(n).alias("layout")) for k, n in enumerate(matched)])),
        lambda x: x["votes"] < 0,
    )
    k, y, b = F.col("kv_score"), F.col("syslog_score"), F.col("label_score")
    family = F.when((y >= 0.6) & (y >= k), "syslog_like_log").when(F.greatest(k, y, b) < 0.4, "unknown_text").when((k >= y) & (k >= b), "kv_line_log").when(y >= b, "syslog_like_log").otherwise("labeled_text_block")
    some = lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("none")))
    styles = lambda **c: some(F.array_compact(F.array(*[F.when(v, n) for n, v in c.items()])))
    return votes.select(
        file_col, "n", "syslog_hits", "kv_hits",
        styles(syslog_mmm_dd_hh_mm_ss=F.col("syslog_times") > 0, iso8601=F.col("iso_times") > 0).alias("timestamp_styles"),
        some(F.transform(ranked, lambda x: x["layout"])).alias("layouts"),
        styles(**{n: F.col(f"__{n}") > 0 for n in events}).alias("event_styles"),
        styles(brace_kv=F.col("brace_kv") > 0, space_kv=F.col("space_kv") > 0, label_value_lines=F.col("label_value_lines") > 0).alias("payload_styles"),
        *[F.round(c, 6).alias(c) for c in ("kv_score", "syslog_score", "label_score")], family.alias("family"),
    )


def spec_coverage(parsed: DataFrame, counts: DataFrame, file_col: str = "file_id") -> DataFrame:
    """One row a file: shares of its records that parse, have a time, have structure, and whether that is enough.

    counts: (file, n) of all records; a file without a parsed record is rejected.
    """
    structure = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in ("tool_id", "channel", "severity", "event_code", "event_type")])
    hits = parsed.groupBy(file_col).agg(F.count(F.lit(1)).alias("hits"), F.count_if(F.col("ts").isNotNull()).alias("times"), F.count_if(structure).alias("structures"))
    met = counts.join(hits, file_col, "left").select(file_col, *[F.round(F.coalesce(c, F.lit(0)) / F.col("n"), 6).alias(a) for c, a in (("hits", "coverage"), ("times", "timestamp_ratio"), ("structures", "structure_ratio"))])
    return met.withColumn("accepted", (F.col("coverage") >= 0.6) & ((F.col("timestamp_ratio") >= 0.3) | (F.col("structure_ratio") >= 0.4)))


def free_form_fallback(files: DataFrame, coverage: DataFrame, file_col: str = "file_id") -> DataFrame:
    """Files that go to the prose lane: those without an accepted spec."""
    return files.join(coverage.where("accepted").select(file_col), file_col, "left_anti")
