"""Queries of nested documents, written as JSON and XML from orders, line items, conversations, events and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import control_jobs as cj
from ..operators import markup as mk
from ..operators import nested as ns
from .tables import dealt, table


def text_of(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def order_lines(s, d):
    """Each order with its lines as an array in a fixed order. Orders are dealt out: where the lines are broadcast, the scan's splits stay."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("q"), "l_returnflag")
    lines = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return dealt(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate").join(lines, "o_orderkey", "left").withColumn("lines", F.coalesce("lines", F.array().cast(lines.schema["lines"].dataType)))


def joined(lines, make, mark=","):
    return F.array_join(F.transform(lines, make), mark)


def customers(s, d):
    """A customer as a document of orders of lines of references."""
    line = lambda x: text_of('{"LineNo":', x["l_linenumber"], ',"Flag":"', x["l_returnflag"], '","Value":', x["q"], ',"refs":[{"PartID":', x["l_partkey"], '},{"PartID":', x["l_suppkey"], "}]}")
    order = text_of('{"OrderID":', F.col("o_orderkey"), ',"Status":"', F.col("o_orderstatus"), '","lines":[', joined("lines", line), "]}")
    orders = order_lines(s, d).select("o_custkey", F.struct("o_orderkey", order.alias("t")).alias("o")).groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list("o")).alias("o"))
    both = dealt(s, d, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey").join(orders, "id", "left")
    return both.select("id", text_of('{"EquipmentID":"E', F.col("id"), '","home":{"NationKey":', F.col("c_nationkey"), ',"x":null},"orders":[', F.coalesce(joined("o", lambda x: x["t"]), F.lit("")), "]}").alias("text"))


def conversations(s, d):
    """A conversation as a list of turns."""
    turns = table(s, d, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return turns.select("id", F.to_json("t").alias("text"))


def control_jobs(s, d):
    """An order as a control job: a process job a line; what the line's flag says is a state event, an alarm or an error."""
    only = lambda x, flag, t: F.when(x["l_returnflag"] == flag, t).otherwise("")

    def job(x):
        no, supp = x["l_linenumber"], x["l_suppkey"]
        events = text_of(
            '{"ControlStateEvents":[', only(x, "N", text_of('{"EventID":', no, ',"Name":"go","TimeStamp":"t', no, '"}')), '],"Alarms":[', only(x, "A", text_of('{"AlarmID":"A', no, '","Severity":"WARN","Text":"","Message":"low","Value":', x["q"], "}")),
            '],"Errors":[', only(x, "R", text_of('{"ErrorID":"E', no, '","Severity":"ERROR","ActualValue":', x["q"], "}")), "]}")
        sensor = text_of('[{"Keys":{"SensorID":', supp, '},"Unit":"Pa","Measurements":[{"DateTime":"d', no, '","Value":', x["q"], '},{"Value":1}]}]')
        return text_of('{"ProcessJobID":', no, ',"LotID":"L', x["l_partkey"], '","SlotID":"","Recipe":{"RecipeID":"R', no, '"},"ModuleProcessReports":[{"Keys":{"ModuleID":', supp, '},"Attributes":{"SlotID":', no, ',"Events":', events, '},"SensorData":', sensor, "}]}")

    o = order_lines(s, d)
    return o.select(F.col("o_orderkey").alias("id"), text_of('{"ControlJob":{"ControlJobID":', F.col("o_orderkey"), ',"ToolID":"C', F.col("o_custkey"), '","OperatorID":"","ProcessJobs":[', joined("lines", job), "]}}").alias("text"))


def xml_orders(s, d):
    """An order as markup: an element a line, each with a check of two values."""
    line = lambda x: text_of('<line n="', x["l_linenumber"], '"><part>', x["l_partkey"], "</part><check><qty>", x["q"], "</qty><flag>", x["l_returnflag"], "</flag></check></line> ")
    return order_lines(s, d).select(F.col("o_orderkey").alias("id"), text_of('<?xml version="1.0"?><o:order xmlns:o="urn:orders" id="', F.col("o_orderkey"), '"><!-- state --><state>', F.col("o_orderstatus"), "</state>", joined("lines", line, ""), "</o:order>").alias("text"))


def xml_pages(s, d):
    """A page's url and markup, escaped, in an element; every broken one lacks its end tag."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("\r"), F.lit("&#13;"))
    page = text_of('<page id="', F.col("page_id"), '"><url>', esc(F.col("url")), "</url><html>", esc(F.col("html")), "</html>")
    return table(s, d, "pages").select("page_id", F.when(F.col("page_id") % 5 == 0, page).otherwise(F.concat(page, F.lit("</page>"))).alias("text"))


def bodies(s, d):
    """Everything that may be a JSON document."""
    one = lambda family, rows: rows.select(F.lit(family).alias("family"), F.col(rows.columns[0]).cast("long").alias("id"), F.col(rows.columns[1]).alias("text"))
    return one("customer", customers(s, d)).unionByName(one("conversation", conversations(s, d))).unionByName(one("props", table(s, d, "events").select("event_id", "props"))).unionByName(
        one("document", table(s, d, "documents").select("doc_id", "text"))).unionByName(one("page", table(s, d, "pages").select("page_id", "html")))


GROUPS = [
    {"record_type": "order", "path": "orders[]", "field_paths": ["OrderID", "Status"], "context_paths": ["EquipmentID", "home.x"]},
    {"record_type": "line", "path": "orders[].lines[]", "field_paths": ["LineNo", "Value"], "context_paths": ["EquipmentID", "orders[].OrderID"], "where": {"field": "Flag", "equals": "R"}},
    {"record_type": "ref", "path": "orders[].lines[].refs[]", "field_paths": ["PartID"], "context_paths": ["home.NationKey", "orders[].OrderID", "orders[].lines[].LineNo"]},
]
TURNS = [{"record_type": "turn", "path": "[]", "field_paths": ["turn", "role", "text"], "where": {"field": "role", "equals": "assistant"}}]


def _groups(s, d):
    made = ns.extract_groups(ns.read_json_docs(customers(s, d)), GROUPS)
    c = lambda n: F.col("data")[n]
    return made.select("id", "record_type", "source_reference", c("EquipmentID").alias("equipment"), F.coalesce(c("OrderID"), c("orders[].OrderID")).alias("order_id"), c("Status").alias("status"),
                       F.coalesce(c("LineNo"), c("orders[].lines[].LineNo")).alias("line_no"), c("Value").alias("value"), c("PartID").alias("part_id"), c("home.NationKey").alias("nation"), F.map_contains_key("data", F.lit("home.x")).alias("has_x"))


def _jobs(s, d):
    made = cj.controljob_flatten(control_jobs(s, d))
    c = lambda n: F.col("raw_fields")[n]
    return made.select("id", "record_type", "source_reference", *[c(n).alias(n) for n in ("equipment_id", "lot_id", "slot_id", "recipe_name", "module_id", "event_id", "alarm_id", "error_id", "sensor_id", "timestamp", "message", "value", "actual_value")],
                       F.size("raw_fields").alias("n_fields"))


def _promoted(s, d):
    docs = mk.xml_promote_singletons(mk.xml_list_unify(mk.read_xml_docs(xml_orders(s, d)), "id"), "id")
    groups = [{"record_type": "check", "path": "order.line[].check[]", "field_paths": ["qty", "flag"], "context_paths": ["order.line[].@n", "order.state"]}]
    made = ns.extract_groups(docs, groups, lists=F.col("lists"))
    return made.select("id", F.array_join("lists", ",").alias("lists"), "source_reference", *[F.col("data")[n].alias(a) for n, a in (("qty", "qty"), ("flag", "flag"), ("order.line[].@n", "n"), ("order.state", "state"))])


def _record_nodes(s, d):
    inner = F.regexp_replace(F.regexp_replace("text", "</state>", "</state><lines>"), "</o:order>", "</lines></o:order>")
    made = mk.xml_record_nodes(xml_orders(s, d).withColumn("text", inner))
    return made.select("id", "record_no", F.get_json_object("record", "$.part").alias("part"), F.get_json_object("record", "$.state").alias("state"))


QUERIES = {
    "read_json_docs": lambda s, d: ns.read_json_docs(bodies(s, d)).select("family", "id", "top_type", F.array_join("top_keys", ",").alias("top_keys")),
    "extract_groups": _groups,
    "extract_groups_turns": lambda s, d: ns.extract_groups(ns.read_json_docs(conversations(s, d)), TURNS).select(
        "id", "source_reference", F.col("data")["turn"].alias("turn"), F.sha2(F.col("data")["text"], 256).alias("text_sha256")),
    "controljob_flatten": _jobs,
    "read_xml_docs": lambda s, d: mk.read_xml_docs(xml_pages(s, d)).select("page_id", "root", F.try_variant_get("doc", "$.page['@id']", "bigint").alias("id"), F.try_variant_get("doc", "$.page.url", "string").alias("url"),
                                                                           F.sha2(F.try_variant_get("doc", "$.page.html", "string"), 256).alias("html_sha256")),
    "xml_list_unify": lambda s, d: mk.xml_list_unify(mk.read_xml_docs(xml_orders(s, d)), "id").select("id", "root", F.array_join("lists", ",").alias("lists")),
    "xml_promote_singletons": _promoted,
    "xml_record_nodes": _record_nodes,
}

LINES_SQL = """o AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderstatus AS st, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
l AS (SELECT o.c, o.k, o.st, l_linenumber AS no, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS q, l_returnflag AS f, l_partkey AS p, l_suppkey AS u,
    row_number() OVER (PARTITION BY o.c ORDER BY o.k, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag) AS i,
    row_number() OVER (PARTITION BY o.k ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag) AS j,
    count(*) OVER (PARTITION BY o.k) AS n FROM lineitem JOIN o ON l_orderkey = o.k)"""
V = lambda x: f"CAST({x} AS VARCHAR)"

ORACLES = {
    "read_json_docs": """SELECT 'customer' AS family, c_custkey AS id, 'object' AS top_type, 'EquipmentID,home,orders' AS top_keys FROM customer
        UNION ALL SELECT DISTINCT 'conversation', conv_id, 'list', NULL FROM conversations
        UNION ALL SELECT 'props', event_id, lower(json_type(props)), array_to_string(list_sort(json_keys(props)), ',') FROM events WHERE json_valid(props)
        UNION ALL SELECT 'document', doc_id, lower(json_type(text)), NULL FROM documents WHERE json_valid(text) UNION ALL SELECT 'page', page_id, lower(json_type(html)), NULL FROM pages WHERE json_valid(html)""",
    "extract_groups": f"""WITH {LINES_SQL}
        SELECT c AS id, 'order' AS record_type, 'orders[][' || {V('i')} || ']' AS source_reference, 'E' || {V('c')} AS equipment, {V('k')} AS order_id, st AS status, NULL AS line_no, NULL AS value, NULL AS part_id, NULL AS nation, false AS has_x FROM o
        UNION ALL SELECT c, 'line', 'orders[].lines[][' || {V('i')} || ']', 'E' || {V('c')}, {V('k')}, NULL, {V('no')}, q, NULL, NULL, false FROM l WHERE f = 'R'
        UNION ALL SELECT c, 'ref', 'orders[].lines[].refs[][' || {V('2 * i - 1 + r')} || ']', NULL, {V('k')}, NULL, {V('no')}, NULL, {V('CASE r WHEN 0 THEN p ELSE u END')}, (SELECT {V('c_nationkey')} FROM customer WHERE c_custkey = c), false FROM l, range(2) t(r)""",
    "extract_groups_turns": """SELECT conv_id AS id, '[][' || CAST(i AS VARCHAR) || ']' AS source_reference, CAST(turn AS VARCHAR) AS turn, sha256(text) AS text_sha256
        FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations) WHERE role = 'assistant'""",
    "controljob_flatten": f"""WITH {LINES_SQL},
        p AS (SELECT *, 'ControlJob.ProcessJobs[' || {V('j')} || ']' AS path, 'C' || {V('c')} AS e, 'L' || {V('p')} AS lot, 'R' || {V('no')} AS r, {V('no')} AS s FROM l),
        m AS (SELECT *, path || '.ModuleProcessReports[1]' AS mat, {V('u')} AS mod FROM p)
        SELECT k AS id, 'control_job' AS record_type, 'ControlJob' AS source_reference, 'C' || {V('c')} AS equipment_id, NULL AS lot_id, NULL AS slot_id, NULL AS recipe_name, NULL AS module_id, NULL AS event_id, NULL AS alarm_id, NULL AS error_id, NULL AS sensor_id,
          NULL AS "timestamp", NULL AS message, NULL AS value, NULL AS actual_value, 2 AS n_fields FROM o
        UNION ALL SELECT k, 'process_job', path, e, lot, NULL, r, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 5 FROM p
        UNION ALL SELECT k, 'control_state_event', mat || '.Attributes.Events.ControlStateEvents[1]', e, lot, s, r, mod, s, NULL, NULL, NULL, 't' || s, 'go', NULL, NULL, 11 FROM m WHERE f = 'N'
        UNION ALL SELECT k, 'alarm_event', mat || '.Attributes.Events.Alarms[1]', e, lot, s, r, mod, NULL, 'A' || s, NULL, NULL, NULL, 'low', q, NULL, 11 FROM m WHERE f = 'A'
        UNION ALL SELECT k, 'error_event', mat || '.Attributes.Events.Errors[1]', e, lot, s, r, mod, NULL, NULL, 'E' || s, NULL, NULL, NULL, NULL, q, 10 FROM m WHERE f = 'R'
        UNION ALL SELECT k, 'sensor_measurement', mat || '.SensorData[1].Measurements[' || {V('x + 1')} || ']', e, lot, s, r, mod, NULL, NULL, NULL, mod, CASE x WHEN 0 THEN 'd' || s END, NULL, CASE x WHEN 0 THEN q ELSE '1' END, NULL, CASE x WHEN 0 THEN 11 ELSE 10 END FROM m, range(2) t(x)""",
    "read_xml_docs": r"SELECT page_id, 'page' AS root, page_id AS id, url, sha256(regexp_replace(html, '^[ \n\t\r]+|[ \n\t\r]+$', '', 'g')) AS html_sha256 FROM pages WHERE page_id % 5 <> 0",
    "xml_list_unify": "SELECT o_orderkey AS id, 'order' AS root, CASE WHEN (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) >= 2 THEN 'order.line' ELSE '' END AS lists FROM orders",
    "xml_promote_singletons": f"""WITH {LINES_SQL} SELECT k AS id, 'order.line,order.line.check' AS lists, 'order.line[].check[][' || {V('j')} || ']' AS source_reference, q AS qty, f AS flag, {V('no')} AS n, st AS state FROM l WHERE n >= 2""",
    "xml_record_nodes": f"""WITH {LINES_SQL} SELECT k AS id, CAST(j AS INTEGER) AS record_no, {V('p')} AS part, NULL AS state FROM l WHERE n >= 2
        UNION ALL SELECT k, 1, NULL, st FROM o WHERE (SELECT count(*) FROM lineitem WHERE l_orderkey = k) < 2""",
}
