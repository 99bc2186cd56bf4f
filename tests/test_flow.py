"""The joined flow on odd files."""

from toolweave.operators import flow


def test_odd_files_keep_their_row_in_the_report(spark):
    files = [
        (1, "a", ".json", None), (2, "b", None, ""), (3, "c", ".json", '[{"a":1,"a":2}]'), (4, "d", ".json", '{"tool_id":"T1","record_type":"alarm_event","alarm_code":"A1","message":"hot","x":[1,{"y":2}]}'),
        (5, "e", ".csv", "a,a,b\n1,2,3\n\n"), (6, "f", ".log", "<r><tool_id>T1"), (7, "g", None, "x" * 200_000), (8, "h", ".bin", "\x00\x01\x02"),
        (9, "i", ".txt", "tool_id=T1 tool_id=T2 from_state=A to_state=B\r\n" * 3),
    ]
    df = spark.createDataFrame(files, "file_id long, filename string, extension string, text string").selectExpr("*", "'z' AS lane", "1 AS source_format")
    routed = flow.routed_files(df)
    done = flow.validated_records(routed)
    by = {r.file_id: (r.lane, r.accepted_count, r.rejected_count) for r in flow.file_report(routed, done).collect()}
    assert set(by) == set(range(1, 10)) and by[4] == ("json", 1, 0) and by[9] == ("lines", 3, 0) and by[5][0] == "csv" and sum(by[5][1:]) == 1
    assert all(by[k] == ("none", 0, 0) for k in (1, 2, 6, 7, 8))
    assert {r.normalized_fields["tool_id"] for r in done.where("file_id = 9").collect()} == {"T1"}  # the first of repeated pairs
    twice = flow.routed_files(df.where("file_id = 4").union(df.where("file_id = 4")))
    assert flow.validated_records(twice).count() == 2


def test_no_files(spark):
    none = spark.createDataFrame([], "file_id long, filename string, extension string, text string")
    routed = flow.routed_files(none)
    assert flow.validated_records(routed).count() == 0 and flow.file_report(routed, flow.validated_records(routed)).count() == 0
