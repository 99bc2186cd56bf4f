"""Observations of two files that share chunk numbers stay apart."""

from toolweave.operators import prose as pr

SCHEMA = """event_id long, file_id long, source_reference string, coarse_type string, final_type string, subtype string, confidence double,
    evidence_text string, uncertain boolean, data map<string,string>, extra map<string,string>"""
LOT = {"lot": "L1", "a": "1", "b": "2"}


def _made(spark, *rows):
    """Rows of (id, file, reference, coarse type, final type)."""
    return spark.createDataFrame([(k, f, ref, coarse, final, "note", 0.9, f"e{k}", False, LOT, {}) for k, f, ref, coarse, final in rows], SCHEMA)


def _ids(df):
    return sorted(r.event_id for r in df.collect())


def test_dedupe_keeps_other_files(spark):
    made = _made(spark, *[(k, k % 2, ref, "fault_or_warning", "fault_event") for k, ref in enumerate(["chunk:1"] * 4 + [None] * 4)])
    assert _ids(pr.dedupe_observations(made, "event_id")) == [0, 1, 4, 5]


def test_merge_keeps_other_files(spark):
    made = _made(spark, *[(k, k % 2, ref, "fault_or_warning", "fault_event") for k, ref in enumerate(["chunk:1"] * 4 + [None] * 4)])
    got = {r.event_id: r.evidence_text for r in pr.merge_same_chunk(made, "event_id").collect()}
    assert got == {0: "e0 | e2", 1: "e1 | e3", 4: "e4 | e6", 5: "e5 | e7"}


def test_absorb_and_condense_stay_within_a_file(spark):
    made = _made(spark, (0, 0, "chunk:1", "fault_or_warning", "fault_event"), (1, 0, "chunk:1", "fault_or_warning", None), (2, 1, "chunk:1", "fault_or_warning", None))
    assert _ids(pr.absorb_generic(made, "event_id")) == [0, 2]
    opened = pr.finalize_type(made).withColumn("subtype", pr.F.lit("summary"))
    assert _ids(pr.condense(opened, "event_id")) == [0, 2]
