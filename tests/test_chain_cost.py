"""The record chain's costly steps are compiled by the JVM, and done once for each value."""

from pyspark.sql import functions as F

from toolweave.operators.normalize import normalize
from toolweave.operators.standardize import embedded_measurements

LONGEST = 8000  # bytes of byte code; the JVM leaves longer methods interpreted


def test_no_method_of_normalize_is_too_long_to_compile(spark):
    rows = spark.createDataFrame([({"parameter": "temp", "value": "90", "unit": "F"},), ({"measured_value": "1,200", "measured_unit": "Pa"},), ({"unit": "Secs"},), ({},)], "standardized_fields map<string,string>")
    made = normalize(rows)
    seen = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package").codegenStringSeq(made._jdf.queryExecution().executedPlan())
    assert max(seen.apply(i)._3().maxMethodCodeSize() for i in range(seen.size())) <= LONGEST
    got = sorted(tuple(sorted(r[0].items())) for r in made.select("normalized_fields").collect())
    assert got == [
        (), (("measured_unit", "Pa"), ("measured_value", "1200.0"), ("measurement_family", "pressure"), ("unit", "Pa"), ("value", "1,200")),
        (("measurement_family", "temperature"), ("parameter", "temp"), ("unit", "degC"), ("value", "32.22222222222222")), (("unit", "s"),)]


def test_a_field_name_is_split_once(spark):
    names = ["flow_mL_min", "chuck-temp/C", "temp", "C", "a__b", "_F", "x_y_pct", "_x_m_min"]
    rows = spark.createDataFrame([({n: "1" for n in names} | {"press_Pa": ""},)], "f map<string,string>").select(embedded_measurements(F.col("f")).alias("m"))
    assert rows._jdf.queryExecution().analyzed().toString().count("split(lambda") <= 1
    assert rows._jdf.queryExecution().analyzed().toString().count("split(") <= 2  # the name, and the parameter made of it
    assert {(m.source_key, m.parameter, m.unit) for m in rows.first().m} == {("flow_mL_min", "flow", "mL/min"), ("chuck-temp/C", "chuck_temperature", "degC"), ("x_y_pct", "x_y", "%"), ("_x_m_min", "x_m", "min")}
