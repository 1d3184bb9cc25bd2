import datetime as dt

import pytest

from tidelog import (
    between, conform, events_as_logs, filter_logs, from_date, latest, next_cursor, project_logs, read_logs,
    schema_from_config, since, tail_step, write_logs, TABLE_CONFIG,
)
from plan_text import plan_of

ROWS = [
    ("2024-01-01 10:00:00", "info", "start", "a"),
    ("2024-01-01 10:00:05", "error", "100% done", "a"),
    ("2024-01-01 10:00:05.500000", "error", "100x done", "b"),
    ("2024-01-01 11:00:00.000001", "warning", "a_b", "b"),
    ("2024-01-02 00:00:00", "Error", "axb", "c"),
]
TEXTS = ["100% done", "100x done", "a_b", "axb", "A_B", "back\\slash", "o'brien", "ends\\", "two\nlines"]


def messages(df):
    return sorted(r.Message for r in df.collect())


@pytest.fixture
def logs(make_logs):
    return make_logs(ROWS)


def test_range_includes_both_whole_seconds(logs):
    assert messages(between(logs, "2024-01-01 10:00:00", "2024-01-01 10:00:05")) == ["100% done", "start"]
    assert messages(between(logs, "2024-01-01 10:00:05.9", "2024-01-01 10:00:05.9")) == ["100% done"]


@pytest.mark.parametrize("start,end", [("", "2024-01-01"), ("2024-01-01", None), (None, None)])
def test_range_needs_both_bounds(logs, start, end):
    with pytest.raises(ValueError):
        between(logs, start, end)


def test_since_keeps_microseconds_and_from_date_is_open(logs):
    assert messages(since(logs, "2024-01-01 11:00:00.000001")) == ["a_b", "axb"]
    assert messages(since(logs, "2024-01-01 11:00:00.000002")) == ["axb"]
    assert messages(from_date(logs, dt.date(2024, 1, 2))) == ["axb"]
    assert since(logs).count() == 0


def test_latest_cuts_the_bound_to_the_second(logs):
    now = dt.datetime(2024, 1, 1, 11, 0, 5, 900_000)
    assert messages(latest(logs, now=now)) == ["100% done", "100x done", "a_b", "axb"]
    assert latest(logs).count() == 0


def test_equality_is_exact(logs):
    assert messages(filter_logs(logs, level="error")) == ["100% done", "100x done"]
    assert messages(filter_logs(logs, level="warn")) == []
    assert messages(filter_logs(logs, resource_id="b")) == ["100x done", "a_b"]


def test_conjunction_skips_unset_filters(logs):
    assert filter_logs(logs).count() == 5
    assert filter_logs(logs, start="", end="", level="", contains_text="", resource_id="").count() == 5
    found = filter_logs(logs, "2024-01-01 10:00:05", "2024-01-01 23:59:59", "error", "done", "b")
    assert messages(found) == ["100x done"]


def test_values_are_data_not_sql(logs):
    assert filter_logs(logs, level="' OR 1=1 --").count() == 0
    assert filter_logs(logs, contains_text="' OR 1=1 --").count() == 0


@pytest.mark.parametrize("text,like,literal", [
    ("100%", ["100% done", "100x done"], ["100% done"]),
    ("a_b", ["a_b", "axb"], ["a_b"]),
    ("\\%", ["100% done"], []),
    ("\\_", ["A_B", "a_b"], []),
    ("back\\slash", ["back\\slash"], ["back\\slash"]),
    ("k\\\\s", ["back\\slash"], []),
    ("o'b", ["o'brien"], ["o'brien"]),
    ("two%lines", ["two\nlines"], []),
    ("A", ["A_B"], ["A_B"]),
])
def test_text_filter(make_logs, text, like, literal):
    logs = make_logs([("2024-01-01 00:00:00", "", t, "") for t in TEXTS])
    assert messages(filter_logs(logs, contains_text=text)) == sorted(like)
    assert messages(filter_logs(logs, contains_text=text, text_mode="literal")) == sorted(literal)


def test_text_mode_is_checked(logs):
    with pytest.raises(ValueError):
        filter_logs(logs, contains_text="x", text_mode="regex")


def test_bounds_reach_scan_and_partitions(logs, spark, folder):
    write_logs(logs, folder)
    found = project_logs(filter_logs(read_logs(spark, folder), "2024-01-02 00:00:00", "2024-01-02 12:00:00", "Error"))
    scan = [line for line in plan_of(found).splitlines() if "FileScan" in line][0]
    partitions = scan[scan.index("PartitionFilters"):scan.index("PushedFilters")]
    assert "log_date" in partitions and "status" in partitions
    assert "GreaterThanOrEqual(Timestamp" in scan[scan.index("PushedFilters"):]
    assert messages(found) == ["axb"]
    assert found.columns == ["Timestamp", "Level", "Message", "ResourceID"]
    counted = plan_of(read_logs(spark, folder).groupBy("Level").count())
    assert "ReadSchema: struct<Level:string>" in counted


def test_bounds_reach_a_scan_without_zone(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    plan = plan_of(filter_logs(events_as_logs(events), "2024-01-05 00:00:00", level="error"))
    assert "GreaterThanOrEqual(ts,2024-01-05T00:00)" in plan and "EqualTo(event_type,error)" in plan


def test_declared_schema(spark):
    schema = schema_from_config(TABLE_CONFIG)
    assert schema.simpleString() == "struct<Timestamp:timestamp,Level:string,Message:string,ResourceID:string>"
    assert [f.nullable for f in schema.fields] == [False] * 4
    more = schema_from_config('{"tableName":"t","columns":[{"name":"n","type":"Nullable(Int64)"},{"name":"d","type":"Decimal(10, 2)"}]}')
    assert more.simpleString() == "struct<n:bigint,d:decimal(10,2)>" and more["n"].nullable
    with pytest.raises(ValueError):
        schema_from_config({"columns": [{"name": "x", "type": "Ring"}]})


def test_conform_fills_missing_text(spark):
    df = spark.createDataFrame([("m", "2024-01-01 00:00:00", 7)], "Message string, Timestamp string, extra int")
    row = conform(df).first()
    assert (row.Level, row.Message, row.ResourceID) == ("", "m", "")


def test_cursor_and_step(make_logs):
    at = "2024-01-01 00:00:02"
    seen = make_logs([("2024-01-01 00:00:01", "i", "one", "r"), (at, "i", "two", "r")])
    cursor = next_cursor(seen).first()
    assert cursor.Message == "two" and cursor.Timestamp == dt.datetime(2024, 1, 1, 0, 0, 2)
    now = seen.union(make_logs([(at, "i", "two", "other"), ("2024-01-01 00:00:03", "i", "three", "r")]))
    assert messages(tail_step(now, cursor)) == ["three", "two"]
    assert next_cursor(seen.where("false")).first() is None
    assert tail_step(seen, None).count() == 0


def test_step_with_a_total_order(spark):
    rows = [("2024-01-01 00:00:01", 1), ("2024-01-01 00:00:02", 2), ("2024-01-01 00:00:02", 3), ("2024-01-01 00:00:03", 0)]
    df = spark.createDataFrame(rows, "t string, id int").selectExpr(
        "cast(t as timestamp) Timestamp", "'' Level", "'' Message", "'' ResourceID", "id")
    cursor = next_cursor(df.where("id = 2"), ["id"]).first()
    assert sorted(r.id for r in tail_step(df, cursor, ["id"]).collect()) == [0, 3]
