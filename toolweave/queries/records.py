"""Queries of the record chain. Every event is written as the field bag a log of its kind would hold and goes through
canonicalize, standardize, normalize, validate, route and project; the SQL starts from the typed event columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import new_path
from ..functions.text import to_int, to_number
from ..functions.units import measurement_family, unit_symbol
from ..operators import sinks
from ..operators.analytics import table_counts
from ..operators.canonical import canonicalize
from ..operators.normalize import coerce_scalars, convert_units, harmonize_fields, normalize
from ..operators.standardize import expand_param_name, standardize
from ..operators.validate import accept_reject_counts, reject_summary, route, validate
from .tables import dealt, files

def key():
    return F.col("event_id")


def pick(n: int, *values):
    """The value of this event's turn among n."""
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), (key() % n).cast("int"))


def ordered_bag(pairs):
    return F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in pairs]))


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed records: seq, file_id, filename, record_type, confidence and the bag."""
    ts = ("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    tool, value = F.concat(F.lit("T"), (F.col("user_id") % 17).cast("string")), F.col("value")
    kind = F.col("event_type")
    data = (
        F.when(kind == "view", ordered_bag([ts, ("tool", tool), ("param", F.lit("chuck_temp")), ("reading", value), ("uom", pick(3, "F", "K", "degC"))]))
        .when(kind == "click", ordered_bag([ts, ("Equipment", tool), ("new_state", F.lit("RUN")), ("from_state", F.lit("IDLE"))]))
        .when(kind == "error", ordered_bag([ts, ("tool_name", tool), ("alarm_code", F.concat(F.lit("A"), (key() % 9).cast("string"))), ("message", F.lit("limit"))]))
        .when((kind == "purchase") & (key() % 10 == 0), ordered_bag([ts, ("machine", tool)]))
        .when(kind == "purchase", ordered_bag([ts, ("machine", tool), ("wafer_id", F.concat(F.lit("W"), (key() % 25).cast("string"))), ("lot_ref", F.lit("L1"))]))
        .otherwise(ordered_bag([ts, ("tool", tool), ("chuck_temp_C", value), ("pressure_mTorr", value)]))
    )
    types = {"view": "sensor_measurement", "click": "control_state_event", "error": "alarm_event", "purchase": "process_job", "signup": "csv_row"}
    record_type = F.element_at(F.create_map(*[F.lit(x) for kv in types.items() for x in kv]), kind)
    return dealt(spark, sf_dir, "events").select(
        key().alias("seq"), (F.col("user_id") % 50).alias("file_id"), F.concat(F.lit("tool_"), (F.col("user_id") % 50).cast("string"), F.lit(".log")).alias("filename"),
        record_type.alias("record_type"), F.when(key() % 13 == 0, 0.3).alias("confidence"), data.alias("data"),
    )


def standardized(spark, d):
    return standardize(canonicalize(parsed(spark, d)))


def validated(spark, d):
    return validate(normalize(standardized(spark, d)))


def _canonicalize(s, d):
    return canonicalize(parsed(s, d)).select("seq", "record_type", "source_record_type", "source_reference", "confidence", F.size("raw_fields").alias("n_fields"))


FIELDS = ("tool_id", "timestamp", "parameter", "value", "unit", "curr_state", "prev_state", "fault_code", "fault_summary", "wafer", "lot")


def _standardize(s, d):
    return standardized(s, d).where("measurement_no = 0").select("seq", "record_type", *[F.col("standardized_fields")[f].alias(f) for f in FIELDS])


def _embedded(s, d):
    return standardized(s, d).where("measurement_no > 0").select(
        "seq", "measurement_no", *[F.col("standardized_fields")[f].alias(f) for f in ("tool_id", "parameter", "value", "unit")]
    )


def _events(s, d):
    return dealt(s, d, "events")


def _coerce(s, d):
    bag = ordered_bag([("a", F.concat(F.lit("00"), key())), ("b", F.lit("+3.50")), ("c", F.lit(" TRUE ")), ("slot", F.concat(F.lit(" 0"), key())), ("e", F.lit("1e7")), ("f", F.lit("1_000"))])
    done = _events(s, d).select("event_id", coerce_scalars(bag).alias("m"))
    return done.select("event_id", *[F.col("m")[k].alias(k) for k in ("a", "b", "c", "slot", "e", "f")])


def _harmonize(s, d):
    bag = F.when(key() % 2 == 0, ordered_bag([("new_state", F.lit("RUN")), ("measured_value", F.col("value"))])).otherwise(
        ordered_bag([("to_state", F.lit("IDLE")), ("units", F.lit("Pa")), ("value", F.lit("1"))]))
    done = _events(s, d).select("event_id", harmonize_fields(bag).alias("m"))
    return done.select("event_id", *[F.col("m")[k].alias(k) for k in ("curr_state", "value", "unit")])


def _convert(s, d):
    rows = _events(s, d).select("event_id", "value", pick(6, "F", "mTorr", "h", "slm", "fraction", "zz").alias("unit"),
                                pick(6, "temp", "pressure", "dwell", "gas_flow", "yield", "other").alias("parameter"))
    done = convert_units(rows, "value", "unit", "parameter")
    return done.select("event_id", F.round("canonical_value", 6).alias("canonical_value"), "canonical_unit", "measurement_family")


def _measured(s, d):
    bag = ordered_bag([("parameter", F.lit("chuck_temp")), ("measured_value", F.col("value")), ("measured_unit", F.lit("F")), ("expected_value", F.lit("300")), ("expected_unit", F.lit("K"))])
    rows = _events(s, d).select("event_id", F.lit(0).alias("x"), bag.alias("standardized_fields"))
    f = F.col("normalized_fields")
    return normalize(rows).select("event_id", F.round(f["measured_value"].cast("double"), 6).alias("measured"), f["measured_unit"].alias("measured_unit"),
                                  F.round(f["expected_value"].cast("double"), 6).alias("expected"), f["expected_unit"].alias("expected_unit"))


def _numbers(s, d):
    text = pick(7, "1,200.5", "true", "n/a", "7.", " .5 ", "-3e2", "7.9")
    return _events(s, d).select("event_id", to_number(text).alias("number"), to_int(text).alias("whole"))


def _recipes_and_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views as process parameters and clicks as generic observations, the kinds that parsed() has none of."""
    rows, data = parsed(spark, sf_dir), F.col("data")
    tool, at = data["tool"], ("ts", data["ts"])
    recipe = ordered_bag([at, ("tool", tool), ("recipe", F.concat(F.lit("R"), (F.col("seq") % 6).cast("string"))), ("parameter", F.lit("overlap")), ("value", data["reading"])])
    note = ordered_bag([at, ("tool", data["Equipment"]), ("event_name", F.concat(F.lit("E"), (F.col("seq") % 5).cast("string"))), ("remark", F.lit("seen"))])
    kinds = (("sensor_measurement", "process_parameter_recipe", recipe), ("control_state_event", "generic_operational_observation", note))
    made = [rows.where(F.col("record_type") == old).withColumns({"record_type": F.lit(new), "data": bag}) for old, new, bag in kinds]
    return made[0].unionByName(made[1])


def _project(s, d):
    """All six tables: parsed once, written by target, each table projected from its own rows."""
    both = parsed(s, d).unionByName(_recipes_and_notes(s, d))
    rows = sinks.stage(validate(normalize(standardize(canonicalize(both)))), new_path(s, "staged"))
    made = [sinks.project_domain_rows(route(rows.where(F.col("target_table") == t)), t).withColumn("table_name", F.lit(t)) for t in sinks.DOMAIN_COLUMNS]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), made).withColumn("value", F.round("value", 6))


def _upsert(s, d):
    f = files(s, d)
    full = f.select("file_id", "filename", *[F.lit(None).cast("string").alias(c) for c in ("extension", "sha256", "source_format", "parser_version", "schema_fingerprint")],
                    F.lit(0).alias("accepted_count"), F.lit(0).alias("rejected_count"), "ingestion_time")
    incoming = full.where("file_id % 3 = 0").withColumns({"source_format": F.lit("kv"), "ingestion_time": F.col("ingestion_time") - F.expr("interval 1 day")})
    return sinks.upsert_files(full, incoming).select("file_id", "source_format", "ingestion_time")


def _written_tables(s, d):
    """Loads the events and counts what the tables hold."""
    base = new_path(s, "load")
    sinks.write_tables(validated(s, d), f"{base}/tables", f"{base}/staging", "load-1")
    filled = ("equipment_states", "sensor_readings", "fault_events", "wafer_processing_sequences", sinks.REJECTED)
    return table_counts({t: s.read.parquet(f"{base}/tables/{t}") for t in filled})


def _written_results(s, d):
    path = f"{new_path(s, 'load')}/results"
    sinks.write_results(validated(s, d).select("filename", "record_type", "validation_reason", "normalized_fields"), path, "load-1")
    return s.read.schema("filename string, record_type string").json(path).groupBy("filename", "record_type").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "write_tables": _written_tables,
    "write_results": _written_results,
    "canonicalize": _canonicalize,
    "standardize_fields": _standardize,
    "explode_embedded_units": _embedded,
    "expand_param_names": lambda s, d: _events(s, d).select("event_id", expand_param_name(pick(4, "Chuck_Tmp", "platen spd", " Press-A", "dur")).alias("name")),
    "coerce_scalars": _coerce,
    "harmonize_fields": _harmonize,
    "unit_alias": lambda s, d: _events(s, d).select("event_id", unit_symbol(pick(6, "°C", "Secs", " ml / min", "PCT", "zzz", " ")).alias("unit")),
    "measurement_family": lambda s, d: _events(s, d).select(
        "event_id", measurement_family(pick(4, "Chuck_Temp", "spindle", "x", "film_thickness"), pick(3, "Pa", "nm", "??")).alias("family")),
    "convert_units": _convert,
    "convert_measured_expected": _measured,
    "to_number": _numbers,
    "validate": lambda s, d: validated(s, d).select("seq", "measurement_no", "record_type", "validation_reason", "accepted"),
    "accept_reject_counts": lambda s, d: accept_reject_counts(validated(s, d)),
    "reject_summary": lambda s, d: reject_summary(validated(s, d)),
    "route_tables": lambda s, d: route(validated(s, d)).groupBy("target_table", "tool_id").agg(F.count(F.lit(1)).alias("n")),
    "project_domain_rows": _project,
    "upsert_files": _upsert,
}

TYPE = """CASE event_type WHEN 'view' THEN 'sensor_reading' WHEN 'click' THEN 'equipment_state' WHEN 'error' THEN 'fault_event'
    WHEN 'purchase' THEN 'wafer_processing_sequence' ELSE 'sensor_reading' END"""
SOURCE = """CASE event_type WHEN 'view' THEN 'sensor_measurement' WHEN 'click' THEN 'control_state_event' WHEN 'error' THEN 'alarm_event'
    WHEN 'purchase' THEN 'process_job' ELSE 'csv_row' END"""
TOOL = "'T' || CAST(user_id % 17 AS VARCHAR)"
TS = "strftime(ts, '%Y-%m-%d %H:%M:%S')"
# A row for each standardized record: signups give two measurements.
ROWS = f"""WITH rows_ AS (
  SELECT *, 0 AS measurement_no FROM events WHERE event_type <> 'signup'
  UNION ALL SELECT *, 1 FROM events WHERE event_type = 'signup' UNION ALL SELECT *, 2 FROM events WHERE event_type = 'signup'),
judged AS (
  SELECT *, {TYPE} AS record_type, CASE WHEN event_id % 13 = 0 THEN 'confidence_below_threshold'
    WHEN event_type = 'purchase' AND event_id % 10 = 0 THEN 'missing_sequence_signal' ELSE 'ok' END AS reason FROM rows_)"""
BY = lambda n, *values: f"CASE event_id % {n} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"

ORACLES = {
    "write_tables": f"""{ROWS} SELECT CASE WHEN reason <> 'ok' THEN 'rejected_records' WHEN record_type = 'sensor_reading' THEN 'sensor_readings' WHEN record_type = 'equipment_state' THEN 'equipment_states'
        WHEN record_type = 'fault_event' THEN 'fault_events' ELSE 'wafer_processing_sequences' END AS table_name, count(*) AS n FROM judged GROUP BY 1""",
    "write_results": f"{ROWS} SELECT 'tool_' || CAST(user_id % 50 AS VARCHAR) || '.log' AS filename, record_type, count(*) AS n FROM judged GROUP BY 1, 2",
    "canonicalize": f"""SELECT event_id AS seq, {TYPE} AS record_type, {SOURCE} AS source_record_type, 'record:' || CAST(event_id AS VARCHAR) AS source_reference,
        CASE WHEN event_id % 13 = 0 THEN 0.3 ELSE 1.0 END::DOUBLE AS confidence,
        CASE event_type WHEN 'view' THEN 5 WHEN 'purchase' THEN CASE WHEN event_id % 10 = 0 THEN 2 ELSE 4 END ELSE 4 END AS n_fields FROM events""",
    "standardize_fields": f"""SELECT event_id AS seq, {TYPE} AS record_type, {TOOL} AS tool_id, {TS} AS timestamp,
        CASE WHEN event_type = 'view' THEN 'chuck_temp' END AS parameter, CASE WHEN event_type = 'view' THEN CAST(value AS VARCHAR) END AS value,
        CASE WHEN event_type = 'view' THEN {BY(3, "'F'", "'K'", "'degC'")} END AS unit,
        CASE WHEN event_type = 'click' THEN 'RUN' END AS curr_state, CASE WHEN event_type = 'click' THEN 'IDLE' END AS prev_state,
        CASE WHEN event_type = 'error' THEN 'A' || CAST(event_id % 9 AS VARCHAR) END AS fault_code, CASE WHEN event_type = 'error' THEN 'limit' END AS fault_summary,
        CASE WHEN event_type = 'purchase' AND event_id % 10 <> 0 THEN 'W' || CAST(event_id % 25 AS VARCHAR) END AS wafer,
        CASE WHEN event_type = 'purchase' AND event_id % 10 <> 0 THEN 'L1' END AS lot FROM events WHERE event_type <> 'signup'""",
    "explode_embedded_units": f"""SELECT event_id AS seq, n AS measurement_no, {TOOL} AS tool_id, CASE n WHEN 1 THEN 'chuck_temperature' ELSE 'pressure' END AS parameter,
        CAST(value AS VARCHAR) AS value, CASE n WHEN 1 THEN 'degC' ELSE 'mTorr' END AS unit FROM events, (VALUES (1), (2)) AS v(n) WHERE event_type = 'signup'""",
    "expand_param_names": f"SELECT event_id, {BY(4, repr('chuck_temperature'), repr('platen_speed'), repr('pressure_a'), repr('duration'))} AS name FROM events",
    "coerce_scalars": "SELECT event_id, CAST(event_id AS VARCHAR) AS a, '3.5' AS b, 'true' AS c, '0' || CAST(event_id AS VARCHAR) AS slot, '10000000.0' AS e, '1_000' AS f FROM events",
    "harmonize_fields": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'RUN' ELSE 'IDLE' END AS curr_state, CASE WHEN event_id % 2 = 0 THEN CAST(value AS VARCHAR) ELSE '1' END AS value, CASE WHEN event_id % 2 = 1 THEN 'Pa' END AS unit FROM events",
    "unit_alias": f"SELECT event_id, {BY(6, repr('degC'), repr('s'), repr('mL/min'), repr('%'), repr('zzz'), 'NULL')} AS unit FROM events",
    "measurement_family": f"""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'temperature' WHEN 1 THEN 'rotational_speed' WHEN 3 THEN 'thickness'
        ELSE {BY(3, repr('pressure'), repr('length'), 'NULL')} END AS family FROM events""",
    "convert_units": f"""SELECT event_id, round({BY(6, '(value - 32) * 5 / 9', 'value * 0.13332236842105263', 'value * 3600', 'value * 1000', 'value * 100', 'value')}, 6) AS canonical_value,
        {BY(6, repr('degC'), repr('Pa'), repr('s'), repr('sccm'), repr('%'), repr('zz'))} AS canonical_unit,
        {BY(6, repr('temperature'), repr('pressure'), repr('time'), repr('gas_flow'), repr('percentage'), 'NULL')} AS measurement_family FROM events""",
    "convert_measured_expected": "SELECT event_id, round((value - 32) * 5 / 9, 6) AS measured, 'degC' AS measured_unit, 26.85::DOUBLE AS expected, 'degC' AS expected_unit FROM events",
    "to_number": f"SELECT event_id, ({BY(7, '1200.5', '1', 'NULL', '7', '0.5', '-300', '7.9')})::DOUBLE AS number, ({BY(7, 'NULL', '1', 'NULL', '7', 'NULL', '-300', 'NULL')})::BIGINT AS whole FROM events",
    "validate": f"{ROWS} SELECT event_id AS seq, measurement_no, record_type, reason AS validation_reason, reason = 'ok' AS accepted FROM judged",
    "accept_reject_counts": f"{ROWS} SELECT user_id % 50 AS file_id, count(*) FILTER (WHERE reason = 'ok') AS accepted_count, count(*) FILTER (WHERE reason <> 'ok') AS rejected_count FROM judged GROUP BY 1",
    "reject_summary": f"{ROWS} SELECT reason AS validation_reason, count(*) AS n FROM judged WHERE reason <> 'ok' GROUP BY 1",
    "route_tables": f"""{ROWS} SELECT CASE record_type WHEN 'sensor_reading' THEN 'sensor_readings' WHEN 'equipment_state' THEN 'equipment_states' WHEN 'fault_event' THEN 'fault_events'
        ELSE 'wafer_processing_sequences' END AS target_table, {TOOL} AS tool_id, count(*) AS n FROM judged WHERE reason = 'ok' GROUP BY 1, 2""",
    "project_domain_rows": f"""{ROWS}, named AS (
          SELECT *, 'tool_' || CAST(user_id % 50 AS VARCHAR) || '.log' AS filename, {TOOL} AS tool_id, {TS} AS event_ts FROM judged)
        SELECT 'sensor_readings' AS table_name, filename, tool_id, event_ts,
          CASE WHEN event_type = 'view' THEN 'chuck_temp' WHEN measurement_no = 1 THEN 'chuck_temperature' ELSE 'pressure' END AS parameter,
          round(CASE WHEN event_type = 'view' THEN {BY(3, '(value - 32) * 5 / 9', 'value - 273.15', 'value')} WHEN measurement_no = 1 THEN value ELSE value * 0.13332236842105263 END, 6) AS value,
          CASE WHEN event_type = 'view' OR measurement_no = 1 THEN 'degC' ELSE 'Pa' END AS unit,
          CAST(NULL AS VARCHAR) AS event_name, CAST(NULL AS VARCHAR) AS slot, CAST(NULL AS VARCHAR) AS action, CAST(NULL AS VARCHAR) AS step, CAST(NULL AS VARCHAR) AS severity,
          CAST(NULL AS DOUBLE) AS duration_s, CAST(NULL AS BIGINT) AS wafer_count
        FROM named WHERE reason = 'ok' AND record_type = 'sensor_reading'
        UNION ALL BY NAME SELECT 'equipment_states' AS table_name, filename, tool_id, event_ts, 'RUN' AS curr_state, 'IDLE' AS prev_state
        FROM named WHERE reason = 'ok' AND record_type = 'equipment_state'
        UNION ALL BY NAME SELECT 'fault_events' AS table_name, filename, tool_id, event_ts, 'A' || CAST(event_id % 9 AS VARCHAR) AS fault_code, 'limit' AS fault_summary
        FROM named WHERE reason = 'ok' AND record_type = 'fault_event'
        UNION ALL BY NAME SELECT 'wafer_processing_sequences' AS table_name, filename, tool_id, event_ts, 'W' || CAST(event_id % 25 AS VARCHAR) AS wafer, 'L1' AS lot
        FROM named WHERE reason = 'ok' AND record_type = 'wafer_processing_sequence'
        UNION ALL BY NAME SELECT 'process_parameters_recipes' AS table_name, filename, tool_id, event_ts, 'R' || CAST(event_id % 6 AS VARCHAR) AS recipe,
          'overlap' AS parameter, round(value, 6) AS value, CAST(NULL AS VARCHAR) AS status FROM named WHERE event_id % 13 <> 0 AND event_type = 'view'
        UNION ALL BY NAME SELECT 'generic_observations_staging' AS table_name, filename, tool_id, event_ts, 'generic_operational_observation' AS record_type,
          'E' || CAST(event_id % 5 AS VARCHAR) AS note FROM named WHERE event_id % 13 <> 0 AND event_type = 'click'""",
    "upsert_files": """SELECT o_orderkey AS file_id, CASE WHEN o_orderkey % 3 = 0 THEN 'kv' END AS source_format,
        CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate - INTERVAL 1 DAY ELSE o_orderdate END AS ingestion_time FROM orders""",
}
