import datetime as dt
import re

import pytest

from tidelog import (
    NotReadOnlyError, assert_read_only, is_read_only, read_logs, register_logs, search, search_sql,
    statement_is_read_only, write_logs,
)
from tidelog.functions.readonly import assert_plan_inside
from tidelog.plans.day_bounds import implied_days
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import functions as F
from plan_text import plan_of

ACCEPTED = [
    "SELECT * FROM logs", "show tables", "describe logs", "explain select 1",
    "select updated_at from logs", "explain select dropped from x", "selectx",
    "\n\t select 1\n", " select 1", "﻿  select 1", "select * from insert_log",
    "select reflect('java.lang.System','getProperty','user.dir')",
    "select * from parquet.`/path`", "select 1; optimize table logs",
]
REFUSED = [
    "with a as (select 1) select * from a", "(select 1)", "select replace(Message,'a','b') from logs",
    "select * from logs where Message like '%delete%'", "select 1; DROP table logs",
    "select\n1;\ninsert into x", "/* c */ select 1", "", "   ", "select édelete from x",
    "select deleteé from x", "show create table logs", "INSERT INTO logs VALUES (1)", "\x1cselect 1",
    "select TRUNCATE", "select a.merge", "\x85select 1",
]
SIDE_DOORS = [
    "select reflect('java.lang.System','getProperty','user.dir')",
    "select `java_method`('java.lang.System','getProperty','user.dir')",
    "select try_reflect('java.lang.System','getProperty','user.dir')",
    "select transform(Message) using 'cat' from logs",
    "select * from (map Message using /* c */ 'cat' as x from logs)",
    "explain extended select reflect('java.lang.System','getProperty','user.dir')",
    "select identifier('refl' || 'ect')('java.lang.System','getProperty','user.dir')",
    "select identifier(:f)('java.lang.System','getProperty','user.dir')",
    "select IDENTIFIER /* c */ ('refl' || 'ect')('java.lang.System','getProperty','user.dir')",
    "select transform(Message) using/* c */'cat' from logs",
]


def test_gate_on_statements():
    assert [s for s in ACCEPTED if not statement_is_read_only(s)] == []
    assert [s for s in REFUSED if statement_is_read_only(s)] == []


def test_gate_on_a_column(spark):
    df = spark.createDataFrame([(s,) for s in ACCEPTED + REFUSED], "sql string")
    found = {r.sql: r.ok for r in df.select("sql", is_read_only(F.col("sql")).alias("ok")).collect()}
    assert [s for s in ACCEPTED if not found[s]] == []
    assert [s for s in REFUSED if found[s]] == []


@pytest.mark.parametrize("sql,ok", [
    ("select * from logs where Message like '%delete%'", True),
    (r"select 'it''s \' drop' from logs", True),
    ("select 'a' from drop", False),
    ("select '" + "x delete " * 50_000 + "'", True),
    ("select '" + "\\'" * 50_000 + "drop'", True),
])
def test_gate_may_ignore_literals(spark, sql, ok):
    assert statement_is_read_only(sql, ignore_literals=True) is ok
    df = spark.createDataFrame([(sql,)], "sql string")
    assert df.select(is_read_only(F.col("sql"), ignore_literals=True)).first()[0] is ok


@pytest.mark.parametrize("sql", SIDE_DOORS)
def test_side_doors_are_closed(sql):
    with pytest.raises(NotReadOnlyError):
        assert_read_only(sql)


@pytest.fixture
def logs(spark, make_logs):
    rows = [(f"2024-01-0{1 + i % 3} 00:{i // 60:02d}:{i % 60:02d}", "error" if i % 4 else "info", f"m{i % 7}", "a") for i in range(200)]
    df = make_logs(rows)
    register_logs(df)
    return df


def test_every_statement_is_gated(spark, logs):
    with pytest.raises(NotReadOnlyError):
        search_sql(spark, "DROP VIEW logs")
    with pytest.raises(ParseException):
        search_sql(spark, "select 1; optimize table logs")
    with pytest.raises(ParseException):
        search_sql(spark, "selectx")
    assert search_sql(spark, "select count(*) n from logs").first().n == 200


def test_files_are_out_of_reach(spark, logs, folder):
    logs.write.parquet(folder)
    for sql in (f"select * from parquet.`{folder}`", f"select * from text /* c */ . `{folder}`"):
        with pytest.raises(AnalysisException):
            search_sql(spark, sql)
    assert spark.sql(f"select * from parquet.`{folder}`").count() == 200


def test_arguments_are_data(spark, logs):
    found = search_sql(spark, "select * from logs where Level = :level", {"level": "x' or '1'='1"})
    assert found.count() == 0


def test_metadata_statements(spark, logs):
    assert "logs" in [r.tableName for r in search_sql(spark, "SHOW TABLES").collect()]
    assert [r.col_name for r in search_sql(spark, "DESCRIBE logs").collect()] == ["Timestamp", "Level", "Message", "ResourceID"]
    assert "Aggregate" in search_sql(spark, "EXPLAIN SELECT count(*) FROM logs").first()[0]


def test_a_plan_that_leaves_spark_is_refused(spark, logs):
    outside = spark.sql("select reflect('java.lang.System','getProperty','user.dir') as x, 1 as one")
    with pytest.raises(NotReadOnlyError):
        assert_plan_inside(outside.where("one = 1"))
    assert_plan_inside(spark.sql("select 'CallMethodViaReflection' as x, '\"class\":\"a.PythonUDF\"' as y from logs"))


@pytest.mark.parametrize("condition", ["Level = 'info'", "true", "false"])
def test_every_result_has_a_summary(spark, logs, condition):
    result = search(spark, f"select * from logs where {condition}")
    own = logs.where(condition)
    assert sorted(map(tuple, result.logs.collect())) == sorted(map(tuple, own.collect()))
    assert sum(r.n_logs for r in result.summary.collect()) == own.count()


def test_nothing_runs_before_a_result_is_used(spark, logs):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lazy", "lazy")
    search(spark, "select * from logs order by Message")
    assert list(tracker.getJobIdsForGroup("lazy")) == []


def test_small_result_without_log_columns(spark, logs):
    result = search(spark, "select Level, count(*) n from logs group by Level")
    assert result.summary.first().n_logs == 2
    empty = search(spark, "select * from logs where false")
    assert empty.logs.count() == 0 and empty.summary.count() == 0


def test_year_one_survives_a_small_result(spark, make_logs):
    register_logs(make_logs([("0001-01-01 00:00:00", "", "", "")]))
    result = search(spark, "select * from logs")
    assert result.logs.select(F.date_format("Timestamp", "yyyy")).first()[0] == "0001"


def test_view_bounds_prune_days(spark, logs, folder):
    write_logs(logs, folder)
    register_logs(read_logs(spark, folder), start="2024-01-02", end="2024-01-02 23:59:59")
    found = search_sql(spark, "select Level from logs where Level = 'info'")
    assert "log_date" in plan_of(found)
    assert found.columns == ["Level"] and found.count() == logs.where("date(Timestamp) = '2024-01-02' and Level = 'info'").count()


DAY_BOUNDS = [
    ("Timestamp >= '2024-01-02 06:00:00'", "2024-01-02", None),
    ("'2024-01-02' < Timestamp", "2024-01-02", None),
    ("Timestamp BETWEEN timestamp'2024-01-01' AND '2024-01-02 05:00'", "2024-01-01", "2024-01-02"),
    ("date(Timestamp) IN ('2024-01-02', '2024-01-03')", "2024-01-02", "2024-01-03"),
    ("Timestamp IN (timestamp'2024-01-02', timestamp'2024-01-02 10:00')", "2024-01-02", "2024-01-02"),
    ("Timestamp > '2024-01-03' OR Timestamp < '2024-01-03' AND Timestamp > '2024-01-02'", "2024-01-02", None),
    ("Timestamp > '2024-01-03' OR Level = 'info'", None, None),
    ("Timestamp > '2024-01-03' OR Timestamp IS NULL", None, None),
    ("Level = 'info' AND Timestamp < :until", None, "2024-01-02"),
    ("NOT Timestamp < '2024-01-02'", "2024-01-02", None),
    ("Timestamp <> '2024-01-02'", None, None),
    ("date_trunc('day', Timestamp) = '2024-01-02'", None, None),
    ("Timestamp > '0001-01-01' AND Timestamp < '9999-12-31'", "0001-01-01", "9999-12-31"),
    ("false", None, None),
]


@pytest.mark.parametrize("condition,first,last", DAY_BOUNDS)
def test_conditions_name_the_days_to_read(spark, logs, folder, condition, first, last):
    write_logs(logs.unionAll(logs.limit(1).withColumn("Timestamp", F.lit(None).cast("timestamp"))), folder)
    stored = read_logs(spark, folder)
    register_logs(stored)
    args = {"until": "2024-01-02 00:00:01"} if ":until" in condition else None
    found = spark.sql(f"select * from logs where {condition}", args=args)
    assert implied_days(found, "Timestamp", "log_date") == tuple(dt.date.fromisoformat(d) if d else None for d in (first, last))
    pruned = search_sql(spark, f"select * from logs where {condition}", args)
    assert sorted(map(str, pruned.collect())) == sorted(map(str, found.collect()))
    if first or last:
        assert re.search(r"PartitionFilters: \[[^]]*log_date", plan_of(pruned))
    assert spark.table("logs").count() == 201


def test_every_scan_counts(spark, logs, folder):
    """Of a join the days of both sides are read; a scan without a condition needs all."""
    write_logs(logs, folder)
    register_logs(read_logs(spark, folder))
    both = "select count(*) n from logs a join logs b on a.Message = b.Message where a.Timestamp < '2024-01-02' and b.Timestamp >= '2024-01-02'"
    assert implied_days(spark.sql(both), "Timestamp", "log_date") == (None, None)
    one = both.replace(" and b.Timestamp >= '2024-01-02'", "")
    assert implied_days(spark.sql(one), "Timestamp", "log_date") == (None, None)
    assert search_sql(spark, both).first() == spark.sql(both).first()
    inner = "select max(n) m from (select Level, count(*) n from logs where Timestamp >= '2024-01-03' group by Level)"
    assert "log_date" in plan_of(search_sql(spark, inner)) and search_sql(spark, inner).first() == spark.sql(inner).first()


def test_a_view_that_was_replaced_is_left_alone(spark, logs, folder, make_logs):
    write_logs(logs, folder)
    register_logs(read_logs(spark, folder))
    make_logs([("2024-01-02 00:00:00", "own", "m", "r")]).createOrReplaceTempView("logs")
    assert [r.Level for r in search_sql(spark, "select * from logs where Timestamp >= '2024-01-02'").collect()] == ["own"]


def test_days_are_pruned_in_a_stored_table_of_files(spark, logs, folder):
    write_logs(logs, folder)
    register_logs(read_logs(spark, folder))
    found = search_sql(spark, "select * from logs where Timestamp >= '2024-01-02' and Timestamp < '2024-01-02 12:00:00'")
    files = {f.split("log_date=")[1][:10] for f in found.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
    assert files == {"2024-01-02"}
