import glob
import json

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidelog import (
    expanded_rows, export_logs, filter_logs, log_volume, project_logs, read_logs, read_quarantine, summarize_logs,
    summary_rows, to_json_rows, to_log_rows, top_messages, write_logs,
)
from tidelog.functions.timestamps import micros_text
from tidelog.sources.table import is_log_table
from tidelog.session import settings
from plan_text import plan_of

ROWS = [
    ("2024-01-01 15:04:05.000006", "error", 'say "hi"\n', "a"),
    ("2024-01-01 00:04:05", "error", "é", "a"),
    ("2024-01-02 12:00:00", "info", "é", "b"),
    ("2024-01-02 12:30:00", "info", "z", "b"),
]


def text_rows(df):
    return sorted(tuple(r) for r in df.withColumn("Timestamp", micros_text(F.col("Timestamp"))).collect())


def files_of(spark, folder, where):
    stored = read_logs(spark, folder).where(where)
    return stored.select(F.input_file_name()).distinct().count()


@pytest.mark.parametrize("with_reason", [False, True])
def test_files_are_sorted_and_have_time_statistics(spark, folder, with_reason):
    rows = spark.range(0, 5000, 1, 8).selectExpr(
        "timestamp_seconds(1704067200 + pmod(hash(id), 259200)) Timestamp", "'l' Level", "'m' Message", "'r' ResourceID")
    if with_reason:
        rows = rows.selectExpr("*", "if(Timestamp > '2024-01-03 12:00:00', 'rule', cast(null as string)) reason")
    write_logs(rows, folder)
    files = glob.glob(f"{folder}/status=ok/log_date=*/*/*.parquet")
    assert len(files) >= 3
    for file in files:
        parquet = pq.ParquetFile(file)
        times = parquet.read(columns=["Timestamp"]).column(0).to_pylist()
        assert times == sorted(times)
        assert parquet.metadata.row_group(0).column(0).statistics.has_min_max
    assert read_logs(spark, folder).count() + read_quarantine(spark, folder).count() == 5000


def test_columns_are_written_by_name(spark, make_logs, folder):
    logs = make_logs(ROWS)
    write_logs(logs.select("Message", "ResourceID", "Timestamp", "Level"), folder)
    write_logs(logs, folder)
    assert text_rows(project_logs(read_logs(spark, folder))) == sorted(text_rows(logs) * 2)


def test_quarantine_shares_the_commit(spark, folder):
    bodies = ['{"timestamp":"2024-01-01T00:00:00Z","message":"ok"}', '{"timestamp":"x","message":"m"}', "junk"]
    write_logs(to_log_rows(spark.createDataFrame([(b,) for b in bodies], "value string")), folder)
    assert [r.Message for r in read_logs(spark, folder).collect()] == ["ok"]
    assert sorted(tuple(r) for r in read_quarantine(spark, folder).select("body", "reason").collect()) == [
        ("junk", "bad_json"), (bodies[1], "bad_timestamp")]


def test_zero_and_null_times_are_stored(spark, folder):
    df = spark.createDataFrame([("{}",), ("junk",)], "value string")
    write_logs(to_log_rows(df, on_bad_json="empty", on_bad_ts="zero"), folder)
    assert {r[0] for r in text_rows(read_logs(spark, folder))} == {"0001-01-01 00:00:00.000000"}
    write_logs(to_log_rows(df, on_bad_json="empty", on_bad_ts="null"), folder)
    assert read_logs(spark, folder).where("Timestamp is null").count() == 2


def test_a_hot_day_is_split_and_light_days_are_not(spark, folder):
    rows = spark.range(0, 200_000, 1, 8).selectExpr(
        "timestamp_seconds(1704067200 + if(id % 2 = 0, 0, (id % 20) * 86400)) Timestamp",
        "'same' Level", "repeat(cast(id as string), 20) Message", "'r' ResourceID")
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "300k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "300k"}
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        write_logs(rows, folder)
    finally:
        for key in settings:
            spark.conf.set(key, before[key]) if before[key] else spark.conf.unset(key)
    assert files_of(spark, folder, "log_date = '2024-01-01'") > 2
    assert files_of(spark, folder, "log_date = '2024-01-04'") <= 2
    assert read_logs(spark, folder).count() == 200_000


def test_files_may_be_bounded(spark, make_logs, folder):
    write_logs(make_logs([ROWS[0]] * 250), folder, max_rows_per_file=100)
    assert files_of(spark, folder, "true") == 3


def test_json_rows(make_logs):
    values = [json.loads(r.value) for r in to_json_rows(make_logs(ROWS)).collect()]
    assert values[0] == {"Timestamp": "2024-01-01 15:04:05.000006", "Level": "error", "Message": 'say "hi"\n', "ResourceID": "a"}
    assert list(values[0]) == ["Timestamp", "Level", "Message", "ResourceID"]
    assert json.loads(to_json_rows(make_logs([(None, "l", "m", "r")])).first().value)["Timestamp"] is None


def test_summary_and_expanded_rows(make_logs):
    logs = make_logs(ROWS[:2])
    first, second = summary_rows(logs).collect()
    assert (first.shown_at, second.shown_at) == ("1/1/2024, 3:04:05 PM", "1/1/2024, 12:04:05 AM")
    assert json.loads(second.summary)["Message"] == "é"
    assert summary_rows(logs, tz="America/New_York").first().shown_at == "1/1/2024, 10:04:05 AM"
    rows = [tuple(r) for r in expanded_rows(logs.limit(1)).collect()]
    assert rows == [("Timestamp", "1/1/2024, 3:04:05 PM"), ("Level", "error"), ("Message", 'say "hi"\n'), ("ResourceId", "a")]


@pytest.mark.parametrize("fmt", ["json", "csv", "parquet"])
def test_export(spark, make_logs, folder, fmt):
    logs = make_logs(ROWS)
    export_logs(logs, folder, fmt)
    if fmt == "json":
        back = spark.read.schema("Timestamp string, Level string, Message string, ResourceID string").json(folder)
    elif fmt == "csv":
        back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(folder)
    else:
        back = spark.read.parquet(folder)
    back = back.withColumn("Timestamp", F.col("Timestamp").cast("timestamp"))
    assert text_rows(back) == text_rows(logs)


def test_export_format_is_checked(make_logs, folder):
    with pytest.raises(ValueError):
        export_logs(make_logs(ROWS), folder, "xml")


def test_summaries(make_logs):
    logs = make_logs(ROWS)
    found = {(r.Level, r.ResourceID): r for r in summarize_logs(logs).collect()}
    assert found["error", "a"].n_logs == 2 and found["error", "a"].share == 0.5 and found["error", "a"].n_messages == 2
    approx = summarize_logs(logs, ["Level"], approx=True).collect()
    assert sorted((r.Level, r.n_messages) for r in approx) == [("error", 2), ("info", 2)]
    assert summarize_logs(logs.where("false")).collect() == []


def test_top_messages_limits_before_the_shuffle(make_logs):
    logs = make_logs(ROWS * 2 + ROWS[2:3])
    top = top_messages(logs, 1)
    plan = plan_of(top)
    assert plan.count("WindowGroupLimit") == 4 and "Partial" in plan
    assert sorted((r.Level, r.Message, r.n_logs) for r in top.collect()) == [("error", 'say "hi"\n', 2), ("info", "é", 3)]


def test_log_volume(make_logs):
    found = [(r.Level, r.n_logs) for r in log_volume(make_logs(ROWS), "1 day").orderBy("window_start").collect()]
    assert found == [("error", 2), ("info", 2)]


def test_log_tables_are_known_by_their_layout(spark, make_logs, folder):
    assert not is_log_table(spark, folder)
    write_logs(make_logs(ROWS), folder)
    assert is_log_table(spark, folder)


def test_another_time_zone_is_refused(spark, make_logs, folder):
    logs = make_logs(ROWS)
    write_logs(logs, folder)
    with settings(spark, {"spark.sql.session.timeZone": "America/New_York"}):
        for use in (lambda: write_logs(logs, folder), lambda: read_logs(spark, folder), lambda: log_volume(logs), lambda: to_json_rows(logs)):
            with pytest.raises(ValueError):
                use()


def test_summaries_read_their_input_once(spark, make_logs, folder):
    write_logs(make_logs(ROWS * 20), folder)
    logs = filter_logs(read_logs(spark, folder), contains_text="é")
    summary = summarize_logs(logs, ["Level"])
    assert sorted((r.Level, r.n_logs, r.share) for r in summary.collect()) == [("error", 20, 0.5), ("info", 20, 0.5)]
    summary.collect()
    assert "ReusedExchange" in summary._jdf.queryExecution().executedPlan().toString()


def test_top_messages_are_cut_in_slices(spark):
    logs = spark.range(20_000).selectExpr("if(id % 3 = 0, 'hot', 'cold') Level", "cast(id % 7000 as string) Message")
    plan = plan_of(top_messages(logs, 5000))
    assert plan.count("Window [row_number()") == 2 and "_slice" in plan
    found = top_messages(logs, 5000).where("rank <= 3").orderBy("Level", "rank").collect()
    counts = {}
    for i in range(20_000):
        key = ("hot" if i % 3 == 0 else "cold", str(i % 7000))
        counts[key] = counts.get(key, 0) + 1
    expected = [(lv, m, n) for lv in ("cold", "hot") for (l2, m), n in sorted(((k, n) for k, n in counts.items() if k[0] == lv), key=lambda x: (-x[1], x[0][1]))[:3]]
    assert [(r.Level, r.Message, r.n_logs) for r in found] == expected

def test_other_parquet_files_are_read_as_they_are(spark, make_logs, folder):
    make_logs(ROWS).select("Level", "Timestamp", "ResourceID", "Message").write.parquet(folder)
    logs = read_logs(spark, folder)
    assert logs.columns == ["Timestamp", "Level", "Message", "ResourceID"]
    assert text_rows(logs) == text_rows(make_logs(ROWS))
    assert filter_logs(logs, start="2024-01-02").count() == 2
