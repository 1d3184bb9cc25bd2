"""Read-only SQL over the log table."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from operator import and_
from typing import Any, NamedTuple
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidelog.functions.readonly import assert_plan_inside, assert_read_only
from tidelog.operators.filters import Bound, filter_logs
from tidelog.operators.summary import summarize_logs
from tidelog.plans.day_bounds import implied_days
from tidelog.session import settings
from tidelog.sources.table import DATE, LOG_COLUMNS, project_logs

# No ``parquet.`/path```: statements see registered tables, not any file.
_TABLES_ONLY = {"spark.sql.runSQLOnFiles": "false"}


class SearchResult(NamedTuple):
    logs: DataFrame
    summary: DataFrame


# Log tables offered to SQL that are partitioned by day, by session and name.
_BY_DAY: WeakKeyDictionary[SparkSession, dict[str, DataFrame]] = WeakKeyDictionary()


def register_logs(df: DataFrame, name: str = "logs", start: Bound | None = None, end: Bound | None = None) -> None:
    """Offer a log DataFrame to SQL under ``name``. Statements read only the days that
    their own conditions on ``Timestamp`` leave; with bounds, no statement reads more than
    the days between them."""
    bounded = filter_logs(df, start, end)
    known = _BY_DAY.setdefault(df.sparkSession, {})
    known.pop(name, None)
    if DATE in df.columns:
        known[name] = bounded
    project_logs(bounded).createOrReplaceTempView(name)


def _with_own_days(spark: SparkSession, found: DataFrame, again: Callable[[], DataFrame]) -> DataFrame:
    """The statement over views that leave out the days it cannot need. It is analysed
    twice and runs once."""
    for name, logs in list(_BY_DAY.get(spark, {}).items()):
        view = project_logs(logs)
        if not spark.catalog.tableExists(name) or not spark.table(name).sameSemantics(view):
            continue  # the name stands for something else by now
        first, last = implied_days(found, LOG_COLUMNS[0], DATE)
        days = [F.col(DATE) >= F.lit(first.isoformat()).cast("date")] if first else []
        days += [F.col(DATE) <= F.lit(last.isoformat()).cast("date")] if last else []
        if not days:
            continue
        try:
            project_logs(logs.where(reduce(and_, days))).createOrReplaceTempView(name)
            found = again()
        finally:
            view.createOrReplaceTempView(name)
    return found


def search_sql(spark: SparkSession, sql: str, args: Mapping[str, Any] | None = None, ignore_literals: bool = False) -> DataFrame:
    """Rows of one read-only statement. Values belong in ``args``, not in the text."""
    assert_read_only(sql, ignore_literals)

    def analysed() -> DataFrame:
        return spark.sql(sql, args=dict(args) if args else None)

    with settings(spark, _TABLES_ONLY):
        found = _with_own_days(spark, analysed(), analysed)
    assert_plan_inside(found)
    return found


def search(
    spark: SparkSession,
    sql: str,
    args: Mapping[str, Any] | None = None,
    ignore_literals: bool = False,
) -> SearchResult:
    """A statement's rows and their summary. Both are lazy, whatever the size: nothing
    runs before one of them is used. The summary groups by the log columns the statement
    returns; without them it counts the rows."""
    found = search_sql(spark, sql, args, ignore_literals)
    if set(LOG_COLUMNS) <= set(found.columns):
        return SearchResult(found, summarize_logs(found))
    return SearchResult(found, found.agg(F.count("*").alias("n_logs")))
