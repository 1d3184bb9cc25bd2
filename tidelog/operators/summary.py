"""Findings over a search result, as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tidelog.operators.summaries import LG_K
from tidelog.session import require_utc

# Slices of a group in which messages are ranked first.
_SLICES = 64


def summarize_logs(df: DataFrame, by: Sequence[str] = ("Level", "ResourceID"), approx: bool = False) -> DataFrame:
    """Per group: rows, share of all rows, first and last instant, distinct messages.

    Rows are counted once, per group and message; the groups and the total, a scalar
    subquery, both follow from these counts and read the same shuffle. ``approx``
    replaces the distinct count, which shuffles every distinct message, by the sketch of
    the kept summaries, whose relative standard error is ``DISTINCT_ERROR``.
    """
    seen = [F.count("*").alias("n"), F.min("Timestamp").alias("first"), F.max("Timestamp").alias("last")]
    if approx:
        # the sketch would pass over an empty text
        message = F.when(F.col("Message").isNotNull(), F.xxhash64("Message"))
        counts = df.groupBy(*by).agg(*seen, F.hll_sketch_estimate(F.hll_sketch_agg(message, LG_K)).alias("messages"))
    else:
        per_message = df.groupBy(*by, "Message").agg(*seen)
        counts = per_message.groupBy(*by).agg(
            F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.count("Message").alias("messages")
        )
    # all columns of the counts, or the total would be planned as another, narrower shuffle
    whole = F.struct(F.sum("n").alias("n"), F.min("first"), F.max("last"), F.sum("messages"))
    total = counts.agg(whole.alias("whole")).scalar()
    return counts.select(
        *by, F.col("n").alias("n_logs"), (F.col("n") / total["n"]).alias("share"),
        F.col("first").alias("first_seen"), F.col("last").alias("last_seen"), F.col("messages").alias("n_messages"),
    )


def top_messages(df: DataFrame, k: int = 5, by: Sequence[str] = ("Level",)) -> DataFrame:
    """The ``k`` most frequent messages per group, ties in text order.

    Counted messages are ranked first within slices of their group, by a hash of the
    message, then the best of each slice within the group. However many messages a group
    has and however large ``k`` is, the last step sees at most ``k`` per slice.
    """
    counts = df.groupBy(*by, "Message").agg(F.count("*").alias("n_logs"))
    sliced = counts.withColumn("_slice", F.pmod(F.xxhash64("Message"), F.lit(_SLICES)))
    best = [F.col("n_logs").desc(), F.col("Message")]
    within = Window.partitionBy(*by, "_slice").orderBy(*best)
    some = sliced.withColumn("_rank", F.row_number().over(within)).where(F.col("_rank") <= k).drop("_rank", "_slice")
    order = Window.partitionBy(*by).orderBy(*best)
    return some.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def log_volume(df: DataFrame, width: str = "1 hour") -> DataFrame:
    """Rows per time window and level, for the volume chart."""
    require_utc(df.sparkSession)
    return (
        df.groupBy(F.window("Timestamp", width).alias("w"), "Level")
        .agg(F.count("*").alias("n_logs"))
        .select(F.col("w.start").alias("window_start"), "Level", "n_logs")
    )
