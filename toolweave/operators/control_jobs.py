"""Control-job documents: ControlJob -> ProcessJobs -> ModuleProcessReports -> events, alarms, errors and sensor data.

One typed parse, then a generator a level: jobs, process jobs, module reports and records become rows of their own, each with
the fields it takes from what it lies in, read once. A chain of generators is narrow: there is no shuffle. (Made by functions
in functions within a document's row, every level would copy all records below it once more.) Numbers and flags are read as
text. A list or object of another shape than expected counts as absent.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import without
from ..functions.text import first_present, present

# Where each field of a record is read from, the first name with a value counting.
JOB = {"control_job_id": ["ControlJobID"], "equipment_id": ["EquipmentID", "ToolID", "MachineID"], "operator_id": ["OperatorID"], "start_time": ["StartTime"], "end_time": ["EndTime"]}
PROCESS = {
    "process_job_id": ["PRJobID", "ProcessJobID"], "lot_id": ["LotID"], "wafer_id": ["WaferID"], "slot_id": ["SlotID"],
    "recipe_name": ["RecipeName", "Recipe.RecipeID", "RecipeID"], "recipe_step_name": ["RecipeStepName", "Recipe.Type"],
}
REPORT_KEYS = {"module_id": ["ModuleID"], "recipe_step_id": ["RecipeStepID"], "key_wafer_id": ["WaferID"]}
STATE = {"event_id": ["EventID"], "event_name": ["Name"], "timestamp": ["DateTime", "Timestamp", "TimeStamp"], "message": ["Text", "Message", "Name"]}
ALARM = {
    "alarm_id": ["AlarmID"], "severity": ["Severity"], "timestamp": ["DateTime", "Timestamp"], "message": ["Text", "Message", "Name"],
    "chamber": ["Chamber"], "value": ["Value"], "unit": ["Unit"], "threshold": ["Threshold"],
}
ERROR = {
    "error_id": ["ErrorID"], "severity": ["Severity"], "timestamp": ["DateTime", "Timestamp"], "message": ["Text", "Message", "Name"],
    "expected_value": ["ExpectedValue"], "actual_value": ["ActualValue"], "unit": ["Unit"],
}
SENSOR = {"sensor_id": ["SensorID", "Keys.SensorID"], "sensor_name": ["SensorName"], "unit": ["Unit"]}
MEASUREMENT = {"timestamp": ["DateTime", "Timestamp", "TimeStamp"], "value": ["Value"]}
RECORD_TYPES = ("control_job", "process_job", "control_state_event", "alarm_event", "error_event", "sensor_measurement")


def _schema(fields: dict, **more: str) -> str:
    """The struct type that holds these fields, nested ones by their first name."""
    plain: dict[str, str] = {}
    inner: dict[str, list[str]] = {}
    for paths in fields.values():
        for p in paths:
            head, _, tail = p.partition(".")
            if tail:
                inner.setdefault(head, []).append(tail)
            else:
                plain[p] = "string"
    plain |= {h: "struct<" + ",".join(f"{t}:string" for t in dict.fromkeys(tails)) + ">" for h, tails in inner.items()} | more
    return "struct<" + ",".join(f"{k}:{v}" for k, v in plain.items()) + ">"


FLAT = "array<map<string,string>>"  # by exact name: Timestamp and TimeStamp differ in case alone
MODULE = "struct<" + ",".join([
    "Keys:" + _schema(REPORT_KEYS),
    "Attributes:struct<SlotID:string,RecipeName:string,Recipe:struct<RecipeID:string>,RecipeStepName:string,Events:struct<"
    f"ControlStateEvents:{FLAT},Alarms:{FLAT},Errors:{FLAT}>>",
    f"SensorData:array<{_schema(SENSOR, Measurements=FLAT)}>",
]) + ">"
PROCESS_JOB = _schema(PROCESS, ModuleProcessReports=f"array<{MODULE}>")
SCHEMA = "ControlJob " + _schema(JOB, ProcessJobs=f"array<{PROCESS_JOB}>")


def _at(node: Column, path: str) -> Column:
    return reduce(lambda c, name: c[name], path.split("."), node)


def _read(node: Column, fields: dict) -> dict[str, Column]:
    return {name: first_present(*[_at(node, p) for p in paths]) for name, paths in fields.items()}


def _fields(values: dict[str, Column]) -> Column:
    return F.struct(*[v.alias(k) for k, v in values.items()])


def _bag(fields: dict[str, Column]) -> Column:
    return F.map_filter(F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())


def _below(items: Column, kind: str) -> Column:
    """A generator of what lies below a row: itself first (number 0, null), then each item with its number."""
    return F.posexplode(F.concat(F.array(F.lit(None).cast(kind)), F.coalesce(items, F.array().cast(f"array<{kind}>"))))


def _item(kind: Column, no: Column, item: Column, sensor: Column, at: Column) -> Column:
    """An item of a flat list, its empty values left out: each name is looked up once then."""
    return F.struct(kind.alias("record_type"), no.alias("__no"), F.map_filter(item, lambda k, v: present(v)).alias("__item"), sensor.alias("__sensor"), at.alias("__at"))


def controljob_flatten(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the text with a row (record_type, source_reference, raw_fields) for each record of its control job.

    Six record types; a value that is absent, null or empty isn't in the bag. A document that is no JSON object with a
    ControlJob object gives no row. References number from 1 within what they lie in.
    """
    kept = without(docs, text_col, "record_type", "source_reference", "raw_fields")
    row = F.struct(*[docs[f"`{c}`"] for c in kept.columns]) if kept.columns else F.lit(None)
    # A generator of one row: the filter and what follows use one parse.
    parsed = docs.select(row.alias("__row"), F.inline(F.array(F.struct(F.from_json(docs[text_col], SCHEMA)["ControlJob"].alias("__j"))))).where("__j is not null")
    jobs = parsed.select("__row", _fields(_read(F.col("__j"), JOB)).alias("__job"), F.col("__j")["ProcessJobs"].alias("__list"))
    x = F.col("__x")
    processes = jobs.select("__row", "__job", _below(F.col("__list"), PROCESS_JOB).alias("__i", "__x")).select(
        "__row", "__job", "__i", _fields(_read(x, PROCESS)).alias("__process"), x["ModuleProcessReports"].alias("__list"))
    reports = processes.select("__row", "__job", "__i", "__process", _below(F.col("__list"), MODULE).alias("__k", "__x"))

    i, k = F.col("__i"), F.col("__k")
    job, process = ({f: F.col(c)[f] for f in fields} for c, fields in (("__job", JOB), ("__process", PROCESS)))
    keys, attributes = _read(x["Keys"], REPORT_KEYS), x["Attributes"]
    context = {
        "control_job_id": job["control_job_id"], "equipment_id": job["equipment_id"], "process_job_id": process["process_job_id"], "lot_id": process["lot_id"], "wafer_id": process["wafer_id"],
        "slot_id": first_present(attributes["SlotID"], process["slot_id"]),
        "recipe_name": first_present(attributes["RecipeName"], attributes["Recipe"]["RecipeID"], process["recipe_name"]),
        "recipe_step_name": first_present(attributes["RecipeStepName"], process["recipe_step_name"], keys["recipe_step_id"]), **keys,
    }
    no_sensor, nowhere = F.lit(None).cast("struct<" + ",".join(f"{f}:string" for f in SENSOR) + ">"), F.lit(None).cast("int")
    head = F.array(_item(F.when(i == 0, "control_job").otherwise("process_job"), nowhere, F.lit(None).cast("map<string,string>"), no_sensor, nowhere))
    listed = lambda kind, name: F.coalesce(F.transform(attributes["Events"][name], lambda e, n: _item(F.lit(kind), n + 1, e, no_sensor, nowhere)), F.array())
    measured = lambda s, at: F.coalesce(F.transform(s["Measurements"], lambda m, n: _item(F.lit("sensor_measurement"), n + 1, m, _fields(_read(s, SENSOR)), at + 1)), F.array())
    items = F.when(k == 0, head).otherwise(F.concat(
        listed("control_state_event", "ControlStateEvents"), listed("alarm_event", "Alarms"), listed("error_event", "Errors"),
        F.coalesce(F.flatten(F.transform(x["SensorData"], measured)), F.array())))
    made = reports.select("__row", "__job", "__i", "__process", "__k", _fields(context).alias("__context"), items.alias("__items")).select(
        "__row", "__job", "__i", "__process", "__k", "__context", F.inline("__items"))

    kind, item, no = F.col("record_type"), F.col("__item"), F.col("__no").cast("string")
    shared, sensor = ({f: F.col(c)[f] for f in fields} for c, fields in (("__context", context), ("__sensor", SENSOR)))
    own = lambda fields: {name: F.coalesce(*[item[p] for p in paths]) for name, paths in fields.items()}
    bag = (
        F.when(kind == "sensor_measurement", _bag(shared | sensor | own(MEASUREMENT))).when(kind == "process_job", _bag({f: job[f] for f in ("control_job_id", "equipment_id")} | process))
        .when(kind == "control_state_event", _bag(shared | own(STATE))).when(kind == "alarm_event", _bag(shared | own(ALARM))).when(kind == "error_event", _bag(shared | own(ERROR))).otherwise(_bag(job)))
    at = F.concat(F.lit("ControlJob.ProcessJobs["), i.cast("string"), F.lit("].ModuleProcessReports["), k.cast("string"), F.lit("]"))
    events = F.when(kind == "control_state_event", "ControlStateEvents").when(kind == "alarm_event", "Alarms").otherwise("Errors")
    reference = (
        F.when(kind == "control_job", "ControlJob").when(kind == "process_job", F.concat(F.lit("ControlJob.ProcessJobs["), i.cast("string"), F.lit("]")))
        .when(kind == "sensor_measurement", F.concat(at, F.lit(".SensorData["), F.col("__at").cast("string"), F.lit("].Measurements["), no, F.lit("]")))
        .otherwise(F.concat(at, F.lit(".Attributes.Events."), events, F.lit("["), no, F.lit("]"))))
    return made.select(*[F.col(f"__row.`{c}`") for c in kept.columns], "record_type", reference.alias("source_reference"), bag.alias("raw_fields"))


def record_table(records: DataFrame, record_type: str, fields: list[str]) -> DataFrame:
    """The records of one type with these fields as columns."""
    rows = records.where(F.col("record_type") == record_type)
    return rows.select(*[F.col(f"`{c}`") for c in records.columns if c not in ("record_type", "raw_fields")], *[F.col("raw_fields")[f].alias(f) for f in fields])
