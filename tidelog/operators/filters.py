"""Search predicates over the log table.

Every bound becomes a literal of the column's own type, so it reaches the parquet
scan; where the table is partitioned by day, the same bound also names the days, so
other days are not even listed. Spark does not derive the second from the first.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from tidelog.functions.text_match import text_predicate
from tidelog.functions.timestamps import bound_literal, local_to_utc_second, parse_bound
from tidelog.sources.table import DATE

Bound = str | dt.datetime | dt.date

# Fixed value: how far the recent window and a new tail look back.
LOOK_BACK = dt.timedelta(hours=1)


def _utc_now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


def _time_predicates(
    df: DataFrame, start: dt.datetime | None = None, end: dt.datetime | None = None
) -> list[Column]:
    type_ = df.schema["Timestamp"].dataType
    predicates = []
    if start is not None:
        predicates.append(F.col("Timestamp") >= bound_literal(start, type_))
    if end is not None:
        predicates.append(F.col("Timestamp") <= bound_literal(end, type_))
    if DATE in df.columns:
        if start is not None:
            predicates.append(F.col(DATE) >= F.lit(start.date()))
        if end is not None:
            predicates.append(F.col(DATE) <= F.lit(end.date()))
    return predicates


def _where(df: DataFrame, predicates: list[Column]) -> DataFrame:
    return df.where(reduce(and_, predicates)) if predicates else df


def _second(value: Bound) -> dt.datetime:
    return parse_bound(value).replace(microsecond=0)


def latest(df: DataFrame, hours: float = 1, now: Bound | None = None) -> DataFrame:
    """Rows of the last ``hours``; the bound is cut to the second."""
    anchor = _utc_now() if now is None else parse_bound(now)
    start = (anchor - dt.timedelta(hours=hours)).replace(microsecond=0)
    return _where(df, _time_predicates(df, start))


def since(df: DataFrame, cursor: Bound | None = None) -> DataFrame:
    """Rows at or after a cursor, which keeps its microseconds."""
    start = (_utc_now() - LOOK_BACK).replace(microsecond=0) if cursor is None else parse_bound(cursor)
    return _where(df, _time_predicates(df, start))


def between(df: DataFrame, start: Bound, end: Bound) -> DataFrame:
    """Rows from ``start`` to ``end``, both whole seconds and both included."""
    if not start or not end:
        raise ValueError("a range needs a start and an end")
    return _where(df, _time_predicates(df, _second(start), _second(end)))


def from_date(df: DataFrame, date: Bound) -> DataFrame:
    """Rows from a date onward; there is no upper bound."""
    return _where(df, _time_predicates(df, parse_bound(date)))


def filter_logs(
    df: DataFrame,
    start: Bound | None = None,
    end: Bound | None = None,
    level: str | None = None,
    contains_text: str | None = None,
    resource_id: str | None = None,
    text_mode: str = "like",
) -> DataFrame:
    """Conjunction of the given filters. None and '' mean unset; none set gives all rows."""
    predicates = _time_predicates(df, _second(start) if start else None, _second(end) if end else None)
    if level:
        predicates.append(F.col("Level") == F.lit(level))
    if contains_text:
        predicates.append(text_predicate(F.col("Message"), contains_text, text_mode))
    if resource_id:
        predicates.append(F.col("ResourceID") == F.lit(resource_id))
    return _where(df, predicates)


def normalize_bound(value: Column | str, tz: str = "UTC") -> Column:
    """A form's local date-time (column, or name of one) as UTC text to the second."""
    return local_to_utc_second(F.col(value) if isinstance(value, str) else value, tz)
