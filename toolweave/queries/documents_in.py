"""Queries of adapters, prose and tables in files, over bodies and bags written from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.frames import new_path
from ..operators import adapters as ad
from ..operators import ingest as ig
from ..operators import prose as pr
from ..operators import tables_in as ti
from .records import ordered_bag
from .tables import dealt, table

K = "event_id"


def events(s, d):
    return dealt(s, d, "events")


def bag(s, d):
    """Vendor bags: EquipmentID, Value or value, Severity, and a sensor id."""
    k = F.col(K)
    vendor = ordered_bag([("Equipment-ID", F.concat(F.lit("T"), F.col("user_id").cast("string"))), ("VALUE", F.col("value")), ("@sev", F.col("event_type")), ("sensor_id", k)])
    own = ordered_bag([("EquipmentID", F.lit("E")), ("tool_id", F.lit("own")), ("EventCategory", F.upper("event_type")), ("sensor_id", F.lit(""))])
    return events(s, d).select(K, "event_type", F.when(k % 2 == 0, vendor).otherwise(own).alias("m"))


ALIASES = {"EquipmentID": "tool_id", "Value": "value", "@sev": "severity"}
RULES = [("csv_row", "EventCategory", {"ERROR": "fault_event", "VIEW": "generic_operational_observation"})]


def specs(s, d):
    """A stored spec a customer nation: some rules valid, some not, one that a default would give."""
    k = F.col("c_custkey")
    rows = F.array(
        F.struct(F.lit("alias").alias("kind"), F.lit(0).alias("n"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("field"), F.concat(F.lit("v"), k.cast("string")).alias("key"), F.when(k % 2 == 0, "tool_id").otherwise("no_such").alias("target")),
        F.struct(F.lit("type").alias("kind"), F.lit(0).alias("n"), F.lit("wafer").alias("source"), F.lit(None).cast("string").alias("field"), F.lit("wafer").alias("key"), F.lit("fault_event").alias("target")),
    )
    return table(s, d, "customer").select(F.concat(F.lit("f"), k.cast("string")).alias("fingerprint"), F.inline(rows))


def stored_specs(s, d):
    """A store that all customers' specs went into, and then other ones of every third customer."""
    path = new_path(s, "specs")
    first = specs(s, d)
    ad.save_specs(first, path)
    third = first.where((F.substring("fingerprint", 2, 20).cast("long") % 3 == 0) & (F.col("kind") == "alias")).withColumn("target", F.lit("lot"))
    ad.save_specs(third, path)
    return ad.read_specs(s, path)


def ingested(s, d):
    """The events as a file a user, written and catalogued."""
    path = new_path(s, "landing")
    line = F.concat_ws(" ", F.col(K).cast("string"), "event_type", "props").alias("value")
    rows = events(s, d).repartition("user_id").sortWithinPartitions("user_id", K).select("user_id", line)
    rows.write.partitionBy("user_id").text(path)
    made = ig.ingest_files(s, f"{path}/user_id=*")
    again = ig.ingest_files(s, f"{path}/user_id=*").select("file_id", F.lit(True).alias("same"))
    return made.join(again, "file_id", "left").select(F.regexp_extract("raw_path", r"user_id=(\d+)/", 1).cast("long").alias("user_id"), "extension", "size_bytes", "sha256", F.col("same").isNotNull().alias("same_id_again"))


def observations(s, d):
    k = F.col(K)
    pick = lambda n, *v: F.get(F.array(*[F.lit(x) for x in v]), (k % n).cast("int"))
    data = F.when(k % 3 == 0, ordered_bag([("from_state", F.lit("A")), ("to_state", F.lit("B")), ("state", F.lit("C"))])).when(
        k % 3 == 1, ordered_bag([("measurement", F.lit("p")), ("sensor", F.lit("q")), ("value", F.col("value"))])).otherwise(ordered_bag([("x", F.lit("1"))]))
    return events(s, d).select(
        K, pick(4, "state_change", "measurement_observation", "generic_operational_observation", "nonsense").alias("coarse_type"), pick(5, "log_header_metadata", "note", "note", "note", "note").alias("subtype"),
        (F.col("value") / 10).alias("confidence"), F.when(k % 17 == 0, " ").otherwise(" seen ").alias("evidence_text"), F.lit(False).alias("uncertain"), data.alias("data"),
        F.floor(k % 50 / 10).alias("file_id"), F.concat(F.lit("chunk:"), (k % 10).cast("string")).alias("source_reference"),
    )


def checked(s, d):
    return pr.validate_observations(observations(s, d))


def chunked(s, d):
    """Observations of files of ten chunks of a few events: a lot by the event, every fifth one generic."""
    k = F.col(K)
    generic = k % 5 == 4
    data = ordered_bag([("lot", F.concat(F.lit("L"), (k % 2).cast("string"))), ("n", k), ("step", F.lit("s"))])
    return events(s, d).select(
        K, F.floor(k / 100).alias("file_id"), F.concat(F.lit("chunk:"), (F.floor(k / 10) % 10).cast("string")).alias("source_reference"), F.when(generic, "measurement_observation").otherwise("fault_or_warning").alias("coarse_type"),
        F.when(k % 5 == 0, "sensor_reading").when(generic, None).otherwise("fault_event").alias("final_type"), F.lit("note").alias("subtype"), (k % 7 / 10).alias("confidence"),
        F.concat(F.lit("e"), k.cast("string")).alias("evidence_text"), F.lit(False).alias("uncertain"), data.alias("data"), F.create_map().cast("map<string,string>").alias("extra"))


def apart(s, d):
    """chunked() with identities that only a lot gives, under references that count on over all files."""
    made = chunked(s, d).withColumn("data", F.map_filter("data", lambda k, v: k != "step"))
    return made.withColumn("source_reference", F.concat(F.lit("chunk:"), F.floor(F.col(K) / 10).cast("string")))


def csv_files(s, d):
    """A table a user: its events as rows, one of them too wide."""
    row = F.concat_ws(";", F.date_format("ts", "yyyy-MM-dd"), F.col(K).cast("string"), F.col("event_type"), F.when(F.col(K) % 4 == 0, "").otherwise(F.round("value", 2).cast("string")), F.lit("Pa"))
    row = F.when(F.col(K) % 10 == 0, F.concat(row, F.lit(";extra"))).otherwise(row)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(K, row.alias("r")))), lambda x: x["r"]), "\n")
    return events(s, d).groupBy("user_id").agg(F.concat(F.lit("timestamp;sensor_id;event_type; value ;unit\n"), body).alias("text"))


def csv_rows(s, d):
    return ti.read_csv_diag(csv_files(s, d))


def good_rows(s, d):
    return csv_rows(s, d).where("not malformed").select("user_id", "fields")


def tlv(s, d):
    """A container an event: a header, a sensor record, a fault record; every third is cut short."""
    payload = F.concat(F.lit("metric=p;value="), F.col(K).cast("string"))
    size = F.length(payload)
    head = F.lit("SLOG".encode().hex() + "0100" + "0200")
    whole = F.concat(head, F.lit("03"), F.lpad(F.hex(size), 2, "0"), F.lit("00"), F.hex(F.encode(payload, "UTF-8")), F.lit("0403006b3d76"))
    return events(s, d).select(K, F.unhex(F.when(F.col(K) % 3 == 0, F.substr(whole, F.lit(1), F.length(whole) - 2)).otherwise(whole)).alias("content"))


def as_text(b):
    return F.decode(b, "UTF-8")


QUERIES = {
    "alias_inject": lambda s, d: bag(s, d).select(K, ad.alias_inject(F.col("m"), ALIASES).alias("x")).select(K, *[F.col("x")[c].alias(c) for c in ("tool_id", "value", "severity")]),
    "dispatch_type": lambda s, d: bag(s, d).select(K, ad.dispatch_type(F.when(F.col(K) % 3 == 0, "wafer").otherwise("csv_row"), F.col("m"), F.lit(""), RULES, {"wafer": "wafer_processing_sequence"}).alias("record_type")),
    "fallback_fill": lambda s, d: bag(s, d).select(K, ad.fallback_fill(F.col("m"), F.when(F.col(K) % 3 == 0, "other").otherwise("sensor_reading"))["parameter"].alias("parameter")),
    "spec_sanitize": lambda s, d: ad.spec_sanitize(specs(s, d)).select("fingerprint", "kind", "key", "target"),
    "spec_defaults": lambda s, d: ad.spec_defaults(specs(s, d), "json").groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("key") == "wafer").alias("wafer_rules")),
    "ingest_files": ingested,
    "spec_upsert": lambda s, d: stored_specs(s, d).select("fingerprint", "version", "kind", "key", "target"),
    "adapter_specs_scan": lambda s, d: ad.adapter_specs_scan(table(s, d, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 5 == 0, "none").otherwise(F.concat(F.lit("f"), F.col("o_custkey").cast("string"))).alias("fingerprint")), stored_specs(s, d)).select(
        "o_orderkey", "version", F.array_join(F.transform("rules", lambda r: F.concat_ws(">", r["key"], r["target"])), ",").alias("rules")),
    "sample_by_type": lambda s, d: ad.sample_by_type(events(s, d).withColumnRenamed("event_type", "source_record_type"), K).select("source_record_type", "sample_no", K),
    "chunk_text": lambda s, d: pr.chunk_text(table(s, d, "documents").select("doc_id", F.concat("text", F.lit("\n \nShort. One."), F.repeat(F.lit(" Sentence here."), 200)).alias("text"))).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("chunk_id").alias("last"), F.count_if(F.col("chunk").startswith("Short. One.")).alias("shorts")).select("doc_id", (F.col("n") == F.col("last")).alias("numbered"), "shorts"),
    "rename_fields": lambda s, d: observations(s, d).select(K, pr.rename_fields(F.col("data")).alias("x")).select(K, *[F.col("x")[c].alias(c) for c in ("curr_state", "prev_state", "parameter")]),
    "validate_observations": lambda s, d: checked(s, d).select(K, "final_type", "uncertain", "confidence", "evidence_text"),
    "keep_filter": lambda s, d: pr.keep_filter(checked(s, d)).select(K),
    "dedupe_observations": lambda s, d: pr.dedupe_observations(checked(s, d).withColumn("data", F.map_filter("data", lambda k, v: k != "value")), K).select(K),
    "finalize_type": lambda s, d: pr.finalize_type(checked(s, d)).groupBy("final_type").agg(F.count(F.lit(1)).alias("n")),
    "promote_generic": lambda s, d: pr.promote_generic(pr.finalize_type(checked(s, d).withColumn("final_type", F.lit(None).cast("string")))).select(K, "final_type"),
    "merge_same_chunk": lambda s, d: pr.merge_same_chunk(apart(s, d), K).select(K, "source_reference", "confidence", "evidence_text"),
    "absorb_generic": lambda s, d: pr.absorb_generic(chunked(s, d), K).select(K, "final_type", F.col("extra")["absorbed_observations"].isNotNull().alias("absorbed")),
    "condense": lambda s, d: pr.condense(chunked(s, d).withColumn("confidence", F.lit(0.5)), K).select(K, "final_type"),
    "tlv_fill_in": lambda s, d: tlv(s, d).select(K, F.inline(ti.tlv_records(F.col("content")))).select(K, "record_no", ti.tlv_fill_in(F.col("record_type"), F.col("fields"))["parameter"].alias("parameter")),
    "read_lines": lambda s, d: ti.read_lines(csv_files(s, d)).groupBy("user_id").agg(F.max("line_no").alias("lines")),
    "read_csv_diag": lambda s, d: csv_rows(s, d).select("user_id", "row_no", "n_cells", "expected", "malformed", F.col("fields")["sensor_id"].alias("sensor_id"), F.col("fields")["value"].alias("value")),
    "where_equals": lambda s, d: ti.where_equals(good_rows(s, d), "event_type", "error").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")),
    "common_fields": lambda s, d: ti.common_fields(good_rows(s, d).withColumn("fields", F.map_filter("fields", lambda k, v: v.isNotNull() & (v != "view"))), "user_id").select("user_id", "field", "n"),
    "detect_discriminator": lambda s, d: ti.detect_discriminator(good_rows(s, d), "user_id"),
    "split_by_discriminator": lambda s, d: ti.split_by_discriminator(good_rows(s, d), "user_id").select("user_id", "record_type", "field", "rank", "n"),
    "sensor_csv_detect": lambda s, d: ti.sensor_csv_detect(good_rows(s, d).withColumn("fields", F.map_concat("fields", F.create_map(F.lit("parameter"), F.lit("p")))), "user_id").select("user_id", "is_sensor_table"),
    "generic_json_rows": lambda s, d: ti.generic_json_rows(events(s, d).select(K, F.when(F.col(K) % 3 == 0, F.concat(F.lit("["), F.col("props"), F.lit(","), F.col("props"), F.lit("]"))).when(
        F.col(K) % 3 == 1, F.concat(F.lit('{"a":1,"rows":['), F.col("props"), F.lit("]}"))).otherwise(F.col("props")).alias("text"))).select(K, "item_no", F.get_json_object("item", "$.k").alias("k")),
    "hex_text_to_bytes": lambda s, d: events(s, d).select(K, as_text(ti.hex_text_to_bytes(F.when(F.col(K) % 2 == 0, F.concat(F.lit(":03000000"), F.hex(F.encode(F.lit("abc"), "UTF-8")), F.lit("D7\n:00000001FF"))).otherwise(
        F.concat(F.lit("61 62\n"), F.hex(F.encode(F.col(K).cast("string"), "UTF-8")))))).alias("text")),
    "binary_preview": lambda s, d: tlv(s, d).select(K, ti.binary_preview(F.col("content"), 8).alias("p")).select(K, "p.*"),
    "tlv_records": lambda s, d: tlv(s, d).select(K, F.inline(ti.tlv_records(F.col("content")))).select(K, "record_no", "record_type", F.col("fields")["value"].alias("value")),
}

VALID = """SELECT event_id, event_id % 4 AS c, event_id % 3 AS g, event_id % 5 AS sub, round(value / 10, 3) AS confidence FROM events
    WHERE event_id % 4 <> 3 AND value / 10 BETWEEN 0 AND 1 AND event_id % 17 <> 0"""
FINAL = "CASE WHEN c = 0 AND g = 0 THEN 'equipment_state' WHEN c = 1 AND g = 1 THEN 'sensor_reading' END"
UNCERTAIN = "(c = 0 AND g <> 0 OR c = 1 AND g <> 1)"
NDATA = "CASE g WHEN 0 THEN 2 WHEN 1 THEN 2 ELSE 1 END"
GOOD = "SELECT * FROM events WHERE event_id % 10 <> 0"

ORACLES = {
    "alias_inject": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'T' || CAST(user_id AS VARCHAR) ELSE 'own' END AS tool_id, CASE WHEN event_id % 2 = 0 THEN CAST(value AS VARCHAR) END AS value, CASE WHEN event_id % 2 = 0 THEN event_type END AS severity FROM events",
    "dispatch_type": """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'wafer_processing_sequence' WHEN event_id % 2 = 1 AND event_type = 'error' THEN 'fault_event'
        WHEN event_id % 2 = 1 AND event_type = 'view' THEN 'generic_operational_observation' ELSE 'csv_row' END AS record_type FROM events""",
    "fallback_fill": "SELECT event_id, CASE WHEN event_id % 3 <> 0 AND event_id % 2 = 0 THEN CAST(event_id AS VARCHAR) END AS parameter FROM events",
    "spec_sanitize": """SELECT 'f' || CAST(c_custkey AS VARCHAR) AS fingerprint, 'alias' AS kind, 'v' || CAST(c_custkey AS VARCHAR) AS key, 'tool_id' AS target FROM customer WHERE c_custkey % 2 = 0
        UNION ALL SELECT 'f' || CAST(c_custkey AS VARCHAR), 'type', 'wafer', 'fault_event' FROM customer""",
    "spec_defaults": "SELECT 'f' || CAST(c_custkey AS VARCHAR) AS fingerprint, CAST(2 + 11 + 20 + 2 AS BIGINT) AS n, CAST(1 AS BIGINT) AS wafer_rules FROM customer",
    "ingest_files": """SELECT user_id, '.txt' AS extension, CAST(sum(strlen(line) + 1) AS BIGINT) AS size_bytes, sha256(string_agg(line || chr(10), '' ORDER BY event_id)) AS sha256, true AS same_id_again
        FROM (SELECT *, CAST(event_id AS VARCHAR) || ' ' || event_type || ' ' || props AS line FROM events) GROUP BY 1""",
    "spec_upsert": """SELECT 'f' || CAST(c_custkey AS VARCHAR) AS fingerprint, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS version, 'alias' AS kind, 'v' || CAST(c_custkey AS VARCHAR) AS key,
        CASE WHEN c_custkey % 3 = 0 THEN 'lot' WHEN c_custkey % 2 = 0 THEN 'tool_id' ELSE 'no_such' END AS target FROM customer
        UNION ALL SELECT 'f' || CAST(c_custkey AS VARCHAR), 1, 'type', 'wafer', 'fault_event' FROM customer WHERE c_custkey % 3 <> 0""",
    "adapter_specs_scan": """SELECT o_orderkey, CASE WHEN o_custkey % 5 <> 0 THEN CASE WHEN o_custkey % 3 = 0 THEN 2 ELSE 1 END END AS version,
        CASE WHEN o_custkey % 5 <> 0 THEN 'v' || CAST(o_custkey AS VARCHAR) || '>' || CASE WHEN o_custkey % 3 = 0 THEN 'lot' WHEN o_custkey % 2 = 0 THEN 'tool_id,wafer>fault_event' ELSE 'no_such,wafer>fault_event' END END AS rules FROM orders""",
    "sample_by_type": "SELECT event_type AS source_record_type, CAST(n AS INTEGER) AS sample_no, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events) WHERE n <= 3",
    "chunk_text": "SELECT doc_id, true AS numbered, CAST(1 AS BIGINT) AS shorts FROM documents WHERE text IS NOT NULL",
    "rename_fields": "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'B' END AS curr_state, CASE event_id % 3 WHEN 0 THEN 'A' END AS prev_state, CASE event_id % 3 WHEN 1 THEN 'p' END AS parameter FROM events",
    "validate_observations": f"SELECT event_id, {FINAL} AS final_type, {UNCERTAIN} AS uncertain, confidence, 'seen' AS evidence_text FROM ({VALID})",
    "keep_filter": f"""SELECT event_id FROM ({VALID}) WHERE confidence >= 0.8 AND NOT ({UNCERTAIN} AND {NDATA} < 2) AND NOT (c = 2 AND {NDATA} < 2 AND confidence < 0.95) AND NOT (sub = 0 AND {NDATA} < 3)""",
    "dedupe_observations": f"SELECT min(event_id) AS event_id FROM ({VALID}) GROUP BY event_id % 50, {FINAL}, CASE WHEN sub = 0 THEN 0 ELSE 1 END, g",
    "finalize_type": f"SELECT coalesce({FINAL}, 'generic_operational_observation') AS final_type, count(*) AS n FROM ({VALID}) GROUP BY 1",
    "promote_generic": f"""SELECT event_id, CASE WHEN c = 0 AND g = 0 THEN 'equipment_state' WHEN c = 1 AND g = 1 THEN 'sensor_reading' ELSE 'generic_operational_observation' END AS final_type FROM ({VALID})""",
    "merge_same_chunk": """WITH e AS (SELECT event_id, event_id // 10 AS c, event_id % 2 AS lot, CASE WHEN event_id % 5 = 4 THEN 1 ELSE 0 END AS g, CASE WHEN event_id % 5 = 0 THEN 1 WHEN event_id % 5 = 4 THEN 2 ELSE 3 END AS f FROM events)
        SELECT min(event_id) AS event_id, 'chunk:' || CAST(c AS VARCHAR) AS source_reference, max(event_id % 7) / 10 AS confidence, string_agg('e' || CAST(event_id AS VARCHAR), ' | ' ORDER BY event_id) AS evidence_text
        FROM e GROUP BY c, lot, g, f""",
    "absorb_generic": """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'sensor_reading' ELSE 'fault_event' END AS final_type,
        event_id % 5 = 0 AND EXISTS (SELECT 1 FROM events g WHERE g.event_id // 10 = e.event_id // 10 AND g.event_id % 5 = 4 AND g.event_id % 2 = e.event_id % 2) AS absorbed FROM events e WHERE event_id % 5 <> 4""",
    "condense": "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'sensor_reading' ELSE 'fault_event' END AS final_type FROM events WHERE event_id % 5 <> 4",
    "tlv_fill_in": """SELECT event_id, i AS record_no, CASE i WHEN 1 THEN 'p' END AS parameter FROM events, (VALUES (1), (2)) AS v(i) WHERE i = 1 OR event_id % 3 <> 0""",
    "read_lines": "SELECT user_id, CAST(count(*) + 1 AS INTEGER) AS lines FROM events GROUP BY 1",
    "read_csv_diag": """SELECT user_id, CAST(1 + row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS row_no, CASE WHEN event_id % 10 = 0 THEN 6 ELSE 5 END AS n_cells, 5 AS expected,
        event_id % 10 = 0 AS malformed, CASE WHEN event_id % 10 <> 0 THEN CAST(event_id AS VARCHAR) END AS sensor_id,
        CASE WHEN event_id % 10 <> 0 AND event_id % 4 <> 0 THEN CAST(round(value, 2) AS VARCHAR) END AS value FROM events""",
    "where_equals": f"SELECT user_id, count(*) AS n FROM ({GOOD}) WHERE event_type = 'error' GROUP BY 1",
    "common_fields": f"""WITH t AS (SELECT user_id, count(*) AS r, count(*) FILTER (WHERE event_type <> 'view') AS e, count(*) FILTER (WHERE event_id % 4 <> 0) AS v FROM ({GOOD}) GROUP BY 1),
        f AS (SELECT user_id, 'timestamp' AS field, r AS n, r FROM t UNION ALL SELECT user_id, 'sensor_id', r, r FROM t UNION ALL SELECT user_id, 'unit', r, r FROM t
          UNION ALL SELECT user_id, 'event_type', e, r FROM t UNION ALL SELECT user_id, 'value', v, r FROM t) SELECT user_id, field, n FROM f WHERE n >= 0.5 * r""",
    "detect_discriminator": f"SELECT user_id, 'event_type' AS discriminator FROM ({GOOD}) GROUP BY 1 HAVING count(*) >= 3 AND count(DISTINCT event_type) BETWEEN 2 AND 10",
    "split_by_discriminator": f"""WITH ok AS (SELECT user_id FROM ({GOOD}) GROUP BY 1 HAVING count(*) >= 3 AND count(DISTINCT event_type) BETWEEN 2 AND 10)
        SELECT user_id, event_type || '_event' AS record_type, field, CAST(rank AS INTEGER) AS rank, count(*) AS n FROM ({GOOD}) JOIN ok USING (user_id),
        (VALUES ('event_type', 1), ('sensor_id', 2), ('value', 3), ('unit', 4), ('timestamp', 5)) AS v(field, rank) GROUP BY ALL""",
    "sensor_csv_detect": f"SELECT user_id, count(*) >= 3 AND count(*) FILTER (WHERE event_id % 4 <> 0) >= greatest(3, 0.7 * count(*)) AS is_sensor_table FROM ({GOOD}) GROUP BY 1",
    "generic_json_rows": "SELECT event_id, i AS item_no, json_extract_string(props, '$.k') AS k FROM events, (VALUES (1), (2)) AS v(i) WHERE i = 1 OR event_id % 3 = 0",
    "hex_text_to_bytes": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'abc' ELSE 'ab' || CAST(event_id AS VARCHAR) END AS text FROM events",
    "binary_preview": "SELECT event_id, CAST(8 + 3 + 15 + length(CAST(event_id AS VARCHAR)) + 6 - CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS n_bytes, '534c4f4701000200' AS hex, 'SLOG....' AS text FROM events",
    "tlv_records": """SELECT event_id, i AS record_no, CASE i WHEN 1 THEN 'sensor_reading' ELSE 'fault_event' END AS record_type, CASE i WHEN 1 THEN CAST(event_id AS VARCHAR) END AS value
        FROM events, (VALUES (1), (2)) AS v(i) WHERE i = 1 OR event_id % 3 <> 0""",
}
