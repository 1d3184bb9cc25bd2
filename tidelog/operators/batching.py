"""Count-or-time batches: a flush at every 100th row and at every clock tick."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidelog.session import shared_folder

# Rows per flush, seconds to the first tick and between later ones.
MAX_ROWS = 100
FIRST_TICK = 15
TICK = 5

_BLOCK = 1000  # batches written out at once by batch_sizes


def arrival_micros(ts: Column, start: Column) -> Column:
    """Microseconds since the collector started."""
    return F.unix_micros(ts.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))


def tick_index(arrival: Column, first_tick: float = FIRST_TICK, tick: float = TICK) -> Column:
    """Number of the clock tick that ends the interval of an arrival (microseconds)."""
    first, step = int(first_tick * 1_000_000), int(tick * 1_000_000)
    return F.when(arrival < first, F.lit(0).cast("long")).otherwise(_div(arrival - first, step) + 1)


def _div(left: Column, right: int) -> Column:
    return F.call_function("div", left, F.lit(right).cast("long"))


def assign_batches(
    df: DataFrame,
    arrival: str,
    order_by: Sequence[str],
    max_rows: int = MAX_ROWS,
    first_tick: float = FIRST_TICK,
    tick: float = TICK,
    partitions: int | None = None,
) -> DataFrame:
    """Adds ``tick`` and ``chunk``, the flush each row belongs to.

    A row number over each tick would put a busy tick into one task. Instead the rows
    are range partitioned by (tick, arrival, ``order_by``) and numbered where they are;
    per run of a tick inside a partition, the rows before it are added from a table
    with one line per run. ``order_by`` must make the order total, or rows of the same
    instant cannot be spread.

    The ranges come from sampling and both readers must see the same ones, so the call
    itself numbers the rows and checkpoints them in the shared folder. Spark removes the
    checkpoint when nothing refers to the result any more.
    """
    spark = df.sparkSession
    order = ["tick", arrival, *order_by]
    keyed = df.withColumn("tick", tick_index(F.col(arrival), first_tick, tick))
    ranged = keyed.repartitionByRange(partitions, *order) if partitions else keyed.repartitionByRange(*order)
    shared_folder(spark)  # there must be one
    numbered = (
        ranged.sortWithinPartitions(*order)
        .withColumn("_position", F.monotonically_increasing_id())
        .withColumn("_range", F.spark_partition_id())
        .checkpoint()
    )
    runs = numbered.groupBy("tick", "_range").agg(
        F.min("_position").alias("_first"), F.count("*").alias("_rows")
    )
    earlier = Window.partitionBy("tick").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select(
        F.col("tick").alias("_run_tick"),
        F.col("_range").alias("_run_range"),
        (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    same_run = F.col("tick").eqNullSafe(F.col("_run_tick")) & (F.col("_range") == F.col("_run_range"))
    chunk = _div(F.col("_position") + F.col("_shift"), max_rows)
    return numbered.join(offsets, same_run).select(*df.columns, "tick", chunk.alias("chunk"))


def batch_sizes(
    df: DataFrame,
    arrival: str,
    max_rows: int = MAX_ROWS,
    first_tick: float = FIRST_TICK,
    tick: float = TICK,
) -> DataFrame:
    """Flushes and their sizes: ``tick, chunk, n_rows``; a tick without rows has none.

    Sizes follow from the rows per tick alone, so nothing is sorted or numbered. The
    chunks of a tick are written out in blocks, so that no array and no task holds
    them all.
    """
    per_tick = df.groupBy(tick_index(F.col(arrival), first_tick, tick).alias("tick")).agg(
        F.count("*").alias("_rows")
    )
    chunks = _div(F.col("_rows") + (max_rows - 1), max_rows)
    blocks = per_tick.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), _div(chunks - 1, _BLOCK))))
    blocks = blocks.repartition("tick", "_block")
    last = F.least(chunks, (F.col("_block") + 1) * _BLOCK) - 1
    numbered = blocks.withColumn("chunk", F.explode(F.sequence(F.col("_block") * _BLOCK, last)))
    size = F.least(F.lit(max_rows).cast("long"), F.col("_rows") - F.col("chunk") * max_rows)
    return numbered.select("tick", "chunk", size.alias("n_rows"))
