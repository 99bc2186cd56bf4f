"""Cutting records out of documents reads a value once, and copies no records from level to level."""

import json

from pyspark.sql import functions as F

from toolweave.operators import control_jobs as cj
from toolweave.operators import nested as ns


def _plan(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_a_context_is_read_as_text_once(spark):
    docs = {"tool": "T", "a": [{"id": "{x}", "ID": 2, "n": None, "o": {"p": 1}, "k": "1"}, {"id": [1], "k": 1}, 3, None, {"id": "[", "k": "1"}]}
    groups = [{"record_type": "r", "path": "a[]", "field_paths": ["id", "ID", "n", "o", "o.p"], "context_paths": ["tool"], "where": {"field": "k", "equals": "1"}}]
    made = ns.extract_groups(ns.read_json_docs(spark.createDataFrame([(1, json.dumps(docs))], "i int, text string")), groups)
    assert _plan(made).count("$['tool']") <= 3  # as text, and whether text that looks like one is an object or a list
    assert [(r.source_reference, r.data) for r in made.collect()] == [
        ("a[][1]", {"tool": "T", "id": "{x}", "ID": "2", "o.p": "1"}), ("a[][5]", {"tool": "T", "id": "["})]


def test_control_jobs_go_down_by_generators(spark):
    report = {"Keys": {"ModuleID": "m"}, "Attributes": {"Events": {"Errors": [None, {"ErrorID": 5, "Text": ""}]}}, "SensorData": [None, {"Keys": {"SensorID": 9}, "Measurements": [{"Value": 2}]}]}
    text = json.dumps({"ControlJob": {"ToolID": "T", "ProcessJobs": [None, {"LotID": "L", "ModuleProcessReports": [None, report]}]}})
    made = cj.controljob_flatten(spark.createDataFrame([(1, text), (2, "{}"), (3, None)], "id int, text string"))
    assert _plan(made).count("posexplode(") == 2 and "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    at, shared = "ControlJob.ProcessJobs[2].ModuleProcessReports[2]", {"equipment_id": "T", "lot_id": "L", "module_id": "m"}
    assert [tuple(r) for r in made.collect()] == [
        (1, "control_job", "ControlJob", {"equipment_id": "T"}), (1, "process_job", "ControlJob.ProcessJobs[1]", {"equipment_id": "T"}),
        (1, "process_job", "ControlJob.ProcessJobs[2]", {"equipment_id": "T", "lot_id": "L"}),
        (1, "error_event", f"{at}.Attributes.Events.Errors[1]", shared), (1, "error_event", f"{at}.Attributes.Events.Errors[2]", shared | {"error_id": "5"}),
        (1, "sensor_measurement", f"{at}.SensorData[2].Measurements[1]", shared | {"sensor_id": "9", "value": "2"})]
