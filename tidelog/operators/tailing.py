"""One polling step of the tail, on a batch."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Row, functions as F

from tidelog.functions.timestamps import bound_literal
from tidelog.operators.filters import since
from tidelog.sources.table import LOG_COLUMNS


def next_cursor(df: DataFrame, tie_break: Sequence[str] = ()) -> DataFrame:
    """One row: the newest log, ties settled by ``tie_break`` columns. Its timestamp has
    no zone, so that collecting it gives UTC digits whatever the driver's own zone."""
    order = F.struct("Timestamp", *tie_break)
    newest = F.max_by(F.struct(*LOG_COLUMNS, *tie_break), order).alias("newest")
    row = df.agg(newest).where(F.col("newest").isNotNull()).select("newest.*")
    return row.withColumn("Timestamp", F.col("Timestamp").cast("timestamp_ntz"))


def tail_step(df: DataFrame, cursor: Row | None, tie_break: Sequence[str] = ()) -> DataFrame:
    """Rows that came after the cursor row.

    With ``tie_break`` the order is total and the step is exact. Without, rows at the
    cursor's own instant count as new unless they equal the cursor in all columns.
    No cursor means nothing was shown yet: all rows of the default window.
    """
    if cursor is None:
        return since(df)
    recent = since(df, cursor["Timestamp"])
    at = bound_literal(cursor["Timestamp"], df.schema["Timestamp"].dataType)
    if tie_break:
        return recent.where((F.col("Timestamp") > at) | _after(tie_break, cursor))
    same = [F.col(c).eqNullSafe(F.lit(cursor[c])) for c in LOG_COLUMNS if c != "Timestamp"]
    return recent.where(~reduce(and_, [F.col("Timestamp") == at, *same]))


def _after(columns: Sequence[str], cursor: Row) -> Column:
    """Lexicographic 'greater than the cursor' over the tie-break columns."""
    after = F.lit(False)
    for name in reversed(columns):
        value = F.lit(cursor[name])
        after = (F.col(name) > value) | ((F.col(name) == value) & after)
    return after
