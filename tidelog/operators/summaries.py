"""Summaries by day that are kept and merged, instead of reading the rows again."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidelog.session import require_utc
from tidelog.sources.table import DATE

# Sketches of distinct messages have 2 ** LG_K cells: a relative standard error of 1.04
# over the root of that, 1.6 %, and exact counts while there are some hundred messages.
LG_K = 12
DISTINCT_ERROR = 1.04 / 2 ** (LG_K / 2)

# Sketches of frequent messages follow so many at once. A count is off by at most some
# four rows in TRACKED rows of its group, and exact while a group has fewer messages.
TRACKED = 10_000


def write_summaries(logs: DataFrame, path: str, by: Sequence[str] = ("Level", "ResourceID")) -> None:
    """Summarise ``logs`` per day and group at ``path``. Days that are there already are
    replaced, others stay: a new day is added, a day that changed is done again. Per group
    the rows, the first and last instant, a sketch of the distinct messages and one of the
    frequent ones are kept; NULL messages are in neither sketch."""
    require_utc(logs.sparkSession)
    day = F.col(DATE) if DATE in logs.columns else F.to_date("Timestamp")
    rows = logs.withColumn(DATE, day)
    # the sketch would pass over an empty text
    message = F.when(F.col("Message").isNotNull(), F.xxhash64("Message"))
    kept = rows.groupBy(DATE, *by).agg(
        F.count("*").alias("n"), F.min("Timestamp").alias("first"), F.max("Timestamp").alias("last"),
        F.hll_sketch_agg(message, LG_K).alias("messages"),
        F.expr(f"approx_top_k_accumulate(Message, {TRACKED}) FILTER (WHERE Message IS NOT NULL)").alias("frequent"),
    )
    writer = kept.hint("rebalance", DATE).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(DATE).parquet(path)


def _days(spark: SparkSession, path: str, first: dt.date | str | None, last: dt.date | str | None) -> DataFrame:
    kept = spark.read.parquet(path)
    if first is not None:
        kept = kept.where(F.col(DATE) >= F.lit(str(first)).cast("date"))
    if last is not None:
        kept = kept.where(F.col(DATE) <= F.lit(str(last)).cast("date"))
    return kept


def merged_summary(
    spark: SparkSession, path: str, by: Sequence[str] = ("Level",), first: dt.date | str | None = None, last: dt.date | str | None = None
) -> DataFrame:
    """The summary of the days from ``first`` to ``last``, per group, from what
    ``write_summaries`` kept; ``by`` may be coarser than there. All is exact but
    ``n_messages``, whose relative standard error is ``DISTINCT_ERROR``. Only the kept rows
    are read: their number is that of days and groups, not that of logs."""
    merged = _days(spark, path, first, last).groupBy(*by).agg(
        F.sum("n").alias("n_logs"), F.min("first").alias("first_seen"), F.max("last").alias("last_seen"),
        F.hll_sketch_estimate(F.hll_union_agg("messages")).alias("n_messages"),
    )
    total = merged.agg(F.sum("n_logs").alias("n")).scalar()
    return merged.select(*by, "n_logs", (F.col("n_logs") / total).alias("share"), "first_seen", "last_seen", "n_messages")


def merged_top_messages(
    spark: SparkSession, path: str, k: int = 5, by: Sequence[str] = ("Level",), first: dt.date | str | None = None, last: dt.date | str | None = None
) -> DataFrame:
    """The ``k`` most frequent messages per group, ties in text order, from the kept
    sketches. Counts are estimates where a group has more than ``TRACKED`` messages."""
    merged = _days(spark, path, first, last).where("frequent IS NOT NULL").groupBy(*by).agg(
        F.expr(f"approx_top_k_estimate(approx_top_k_combine(frequent, {TRACKED}), {TRACKED})").alias("found"))
    items = merged.select(*by, F.explode("found").alias("one")).select(*by, F.col("one.item").alias("Message"), F.col("one.count").alias("n_logs"))
    order = Window.partitionBy(*by).orderBy(F.col("n_logs").desc(), "Message")
    return items.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
