"""Queries of document structure, over customers (orders of lines of references), conversations, control jobs and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vocab
from ..operators import profile as p
from .nested import control_jobs, conversations, customers
from .tables import dealt, table

K = "event_id"


def docs(s, d):
    named = lambda family, rows: rows.select(F.lit(family).alias("family"), F.col(rows.columns[0]).cast("long").alias("id"), F.col(rows.columns[1]).alias("text"))
    wrapped = dealt(s, d, "events").select(K, F.concat(F.lit('{"events":['), F.col("props"), F.lit(',{"k":"'), F.col("event_type"), F.lit('"}]}')))
    return named("customer", customers(s, d)).unionByName(named("conversation", conversations(s, d))).unionByName(named("event", wrapped))


def rows(s, d):
    return p.leaf_rows(docs(s, d))


def profiled(s, d):
    return p.path_profile(rows(s, d), "family")


def whole(s, d, jobs=True):
    """Structure of every customer, conversation and event, and of every control job where jobs are asked for."""
    texts = docs(s, d)
    if jobs:
        texts = texts.unionByName(control_jobs(s, d).select(F.lit("job").alias("family"), "id", "text"))
    return p.structure_summary(p.leaf_rows(texts).withColumn("doc", F.struct("family", "id")), "doc").select("doc.*", "paths", "repeated")


def groups(s, d):
    return table(s, d, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("id"), F.lit("orders[].lines[].refs[]").alias("path"))


def spec(s, d):
    """A spec path a customer: one that is never filled, one that is, one of another family."""
    k = F.col("c_custkey")
    return table(s, d, "customer").select(F.lit("customer").alias("family"), k, F.when(k % 3 == 0, "home.x").when(k % 3 == 1, "home.NationKey").otherwise("events[].k").alias("path"))


QUERIES = {
    "path_profile": lambda s, d: profiled(s, d).select("family", "path", "type", "n", F.array_join("samples", "|").alias("samples")),
    "record_boundaries": lambda s, d: p.record_boundaries(rows(s, d), "family").select("family", "path", "n", F.array_join("keys", ",").alias("keys")),
    "structure_summary": lambda s, d: whole(s, d).select("family", "id", F.array_join("paths", ",").alias("paths"), F.array_join("repeated", ",").alias("repeated")),
    "schema_family": lambda s, d: whole(s, d).select("family", "id", p.schema_family(F.col("paths")).alias("schema_family")),
    "schema_fingerprint": lambda s, d: whole(s, d, jobs=False).where("family <> 'job'").groupBy("family", p.schema_fingerprint(F.col("paths"), F.col("repeated")).alias("fingerprint")).agg(F.count(F.lit(1)).alias("n")),
    "suggest_mappings": lambda s, d: p.suggest_mappings(profiled(s, d), "family").select("family", "field", F.array_join("paths", ",").alias("paths"), "confidence"),
    "prune_structure": lambda s, d: p.prune_structure(spec(s, d), profiled(s, d), "family").select("c_custkey", "path"),
    "uncovered_paths": lambda s, d: p.uncovered_paths(p.leaf_rows(customers(s, d)), groups(s, d), "id"),
    "parse_observations": lambda s, d: p.parse_observations(dealt(s, d, "events").select(K, F.when(F.col(K) % 3 == 0, F.concat(F.lit('{"records":['), F.col("props"), F.lit(",1,"), F.col("props"), F.lit("]}"))).when(
        F.col(K) % 3 == 1, F.concat(F.lit("["), F.col("props"), F.lit("]"))).otherwise("nothing").alias("text"))).select(K, "record_no", F.get_json_object("record", "$.k").alias("k")),
}

# What each document holds, and every leaf as (family, path, kind, value), from the source columns.
HAS = """c AS (SELECT c_custkey AS id, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) > 0 AS o, (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey) > 0 AS l FROM customer),
j AS (SELECT o_orderkey AS id, coalesce(bool_or(l_returnflag = 'N'), false) AS n, coalesce(bool_or(l_returnflag = 'A'), false) AS a, coalesce(bool_or(l_returnflag = 'R'), false) AS r, count(l_orderkey) > 0 AS l
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)"""
V = lambda x: f"CAST({x} AS VARCHAR)"
LEAVES = f"""leaves AS (
  SELECT 'customer' AS family, 'EquipmentID' AS path, 'str' AS kind, 'E' || {V('c_custkey')} AS v FROM customer
  UNION ALL SELECT 'customer', 'home.NationKey', 'int', {V('c_nationkey')} FROM customer UNION ALL SELECT 'customer', 'home.x', 'null', NULL FROM customer
  UNION ALL SELECT 'customer', 'orders[].OrderID', 'int', {V('o_orderkey')} FROM orders UNION ALL SELECT 'customer', 'orders[].Status', 'str', o_orderstatus FROM orders
  UNION ALL SELECT 'customer', 'orders[].lines[].LineNo', 'int', {V('l_linenumber')} FROM lineitem UNION ALL SELECT 'customer', 'orders[].lines[].Flag', 'str', l_returnflag FROM lineitem
  UNION ALL SELECT 'customer', 'orders[].lines[].Value', 'int', {V('CAST(l_quantity AS INTEGER)')} FROM lineitem
  UNION ALL SELECT 'customer', 'orders[].lines[].refs[].PartID', 'int', {V('CASE r WHEN 0 THEN l_partkey ELSE l_suppkey END')} FROM lineitem, range(2) t(r)
  UNION ALL SELECT 'conversation', '[].turn', 'int', {V('turn')} FROM conversations UNION ALL SELECT 'conversation', '[].role', 'str', role FROM conversations UNION ALL SELECT 'conversation', '[].text', 'str', text FROM conversations
  UNION ALL SELECT 'event', 'events[].k', 'int', json_extract_string(props, '$.k') FROM events UNION ALL SELECT 'event', 'events[].k', 'str', event_type FROM events),
profile AS (
  SELECT family, path, CASE WHEN count(DISTINCT kind) FILTER (WHERE kind <> 'null') = 0 THEN 'null' WHEN count(DISTINCT kind) FILTER (WHERE kind <> 'null') = 1 THEN max(kind) FILTER (WHERE kind <> 'null')
    ELSE 'mixed:' || string_agg(DISTINCT kind, ',' ORDER BY kind) FILTER (WHERE kind <> 'null') END AS type, count(*) FILTER (WHERE kind <> 'null') AS n,
    coalesce(array_to_string(list_sort(list_distinct(list(CASE WHEN length(v) > 80 THEN left(v, 77) || '...' ELSE v END) FILTER (WHERE v IS NOT NULL)))[1:5], '|'), '') AS samples FROM leaves GROUP BY 1, 2)"""
SUMMARY = f"""WITH {HAS},
summary AS (
  SELECT 'customer' AS family, id, 'EquipmentID,home.NationKey,home.x' || CASE WHEN o THEN ',orders[].OrderID,orders[].Status' ELSE '' END || CASE WHEN l THEN ',orders[].lines[].Flag,orders[].lines[].LineNo,orders[].lines[].Value,orders[].lines[].refs[].PartID' ELSE '' END AS paths,
    CASE WHEN l THEN 'orders[],orders[].lines[],orders[].lines[].refs[]' WHEN o THEN 'orders[]' ELSE '' END AS repeated FROM c
  UNION ALL SELECT DISTINCT 'conversation', conv_id, '[].role,[].text,[].turn', '[]' FROM conversations
  UNION ALL SELECT 'event', event_id, 'events[].k', 'events[]' FROM events
  UNION ALL SELECT 'job', id, 'ControlJob.ControlJobID,ControlJob.OperatorID' || CASE WHEN l THEN ',ControlJob.ProcessJobs[].LotID'
    || CASE WHEN a THEN replace(',@Alarms[].AlarmID,@Alarms[].Message,@Alarms[].Severity,@Alarms[].Text,@Alarms[].Value', '@', 'ControlJob.ProcessJobs[].ModuleProcessReports[].Attributes.Events.') ELSE '' END
    || CASE WHEN n THEN replace(',@[].EventID,@[].Name,@[].TimeStamp', '@', 'ControlJob.ProcessJobs[].ModuleProcessReports[].Attributes.Events.ControlStateEvents') ELSE '' END
    || CASE WHEN r THEN replace(',@[].ActualValue,@[].ErrorID,@[].Severity', '@', 'ControlJob.ProcessJobs[].ModuleProcessReports[].Attributes.Events.Errors') ELSE '' END
    || replace(',@Attributes.SlotID,@Keys.ModuleID,@SensorData[].Keys.SensorID,@SensorData[].Measurements[].DateTime,@SensorData[].Measurements[].Value,@SensorData[].Unit', '@', 'ControlJob.ProcessJobs[].ModuleProcessReports[].')
    || ',ControlJob.ProcessJobs[].ProcessJobID,ControlJob.ProcessJobs[].Recipe.RecipeID,ControlJob.ProcessJobs[].SlotID' ELSE '' END || ',ControlJob.ToolID',
    CASE WHEN l THEN 'ControlJob.ProcessJobs[],ControlJob.ProcessJobs[].ModuleProcessReports[]' || CASE WHEN a THEN ',ControlJob.ProcessJobs[].ModuleProcessReports[].Attributes.Events.Alarms[]' ELSE '' END
      || CASE WHEN n THEN ',ControlJob.ProcessJobs[].ModuleProcessReports[].Attributes.Events.ControlStateEvents[]' ELSE '' END || CASE WHEN r THEN ',ControlJob.ProcessJobs[].ModuleProcessReports[].Attributes.Events.Errors[]' ELSE '' END
      || ',ControlJob.ProcessJobs[].ModuleProcessReports[].SensorData[],ControlJob.ProcessJobs[].ModuleProcessReports[].SensorData[].Measurements[]' ELSE '' END FROM j)"""
ALIASES = ", ".join(f"('{field}', '{a.lower()}')" for field, names in vocab.MAPPING_ALIASES.items() for a in names)
QUOTED = lambda c: f"'[' || CASE WHEN {c} = '' THEN '' ELSE '\"' || replace({c}, ',', '\",\"') || '\"' END || ']'"

ORACLES = {
    "path_profile": f"WITH {LEAVES} SELECT family, path, type, n, samples FROM profile",
    "record_boundaries": """SELECT 'customer' AS family, 'orders[]' AS path, count(*) AS n, 'OrderID,Status,lines' AS keys FROM orders UNION ALL SELECT 'customer', 'orders[].lines[]', count(*), 'Flag,LineNo,Value,refs' FROM lineitem
        UNION ALL SELECT 'customer', 'orders[].lines[].refs[]', 2 * count(*), 'PartID' FROM lineitem UNION ALL SELECT 'conversation', '[]', count(*), 'role,text,turn' FROM conversations UNION ALL SELECT 'event', 'events[]', 2 * count(*), 'k' FROM events""",
    "structure_summary": f"{SUMMARY} SELECT family, id, paths, repeated FROM summary",
    "schema_family": f"{SUMMARY} SELECT family, id, CASE WHEN paths LIKE 'ControlJob%' THEN 'control_job' WHEN paths LIKE 'events[]%' THEN 'events' ELSE 'generic' END AS schema_family FROM summary",
    "schema_fingerprint": f"""{SUMMARY} SELECT family, left(sha256('{{"paths":' || {QUOTED('paths')} || ',"repeated":' || {QUOTED('repeated')} || '}}'), 16) AS fingerprint, count(*) AS n FROM summary WHERE family <> 'job' GROUP BY 1, 2""",
    "suggest_mappings": f"""WITH {LEAVES}, hits AS (SELECT DISTINCT family, field, path FROM profile, (VALUES {ALIASES}) AS v(field, alias) WHERE contains(lower(path), alias))
        SELECT family, field, string_agg(path, ',' ORDER BY path) AS paths, CASE WHEN count(*) = 1 THEN 0.9 ELSE 0.7 END::DOUBLE AS confidence FROM hits GROUP BY 1, 2""",
    "prune_structure": f"""WITH {LEAVES}, spec AS (SELECT 'customer' AS family, c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'home.x' WHEN 1 THEN 'home.NationKey' ELSE 'events[].k' END AS path FROM customer)
        SELECT c_custkey, path FROM spec WHERE EXISTS (SELECT 1 FROM profile p WHERE p.family = spec.family AND p.path = spec.path AND p.n > 0)""",
    "uncovered_paths": f"WITH {HAS} SELECT id, CASE WHEN l THEN 'orders[].lines[].refs[]' ELSE 'orders[]' END AS path FROM c WHERE o AND NOT (l AND id % 4 = 0)",
    "parse_observations": "SELECT event_id, i AS record_no, json_extract_string(props, '$.k') AS k FROM events, (VALUES (1), (2)) AS v(i) WHERE event_id % 3 = 0 OR event_id % 3 = 1 AND i = 1",
}
