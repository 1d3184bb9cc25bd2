"""Streams that follow the log table: its volume chart and its routes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.operators.ingest import route_logs
from tidelog.operators.output import stored_rows
from tidelog.session import require_utc
from tidelog.sources.table import BATCH, DATE, STATUS
from tidelog.streaming.sink import batch_names, replace_batch
from tidelog.streaming.tail_stream import start_batches

ROUTE = "route"


def start_volume(
    rows: DataFrame, path: str, checkpoint: str, width: str = "1 hour", delay: str | None = None, available_now: bool = False
) -> StreamingQuery:
    """Keep the volume chart of a stream at ``path``, to be read by ``read_volume``.

    Spark's state holds a count per window and level. With ``delay`` a window leaves the
    state when the newest row is that much after its end; rows that come for it later are
    not counted. Without, every window stays and every row counts. A micro-batch writes
    the windows it changed, with their counts so far, and replaces itself when it comes
    again.
    """
    require_utc(rows.sparkSession)
    timed = rows.where(F.col("Timestamp").isNotNull())
    timed = timed.withWatermark("Timestamp", delay) if delay else timed
    counted = timed.groupBy(F.window("Timestamp", width).alias("w"), "Level").agg(F.count("*").alias("n_logs"))
    shown = counted.select(F.col("w.start").alias("Timestamp"), "Level", "n_logs")

    def keep(batch: DataFrame, number: int) -> None:
        replace_batch(batch, f"{number:019d}", path)

    writer = shown.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(keep)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_volume(spark: SparkSession, path: str) -> DataFrame:
    """Rows per window and level: the latest count of each. Batch names are numbers of
    equal length, so their order as text is that of the batches."""
    written = spark.read.schema(f"Timestamp timestamp, Level string, n_logs long, {BATCH} string").parquet(path)
    latest = written.groupBy("Timestamp", "Level").agg(F.max_by("n_logs", BATCH).alias("n_logs"))
    return latest.select(F.col("Timestamp").alias("window_start"), "Level", "n_logs")


def start_routing(
    rows: DataFrame, rules: Sequence[tuple[str, Column]], path: str, checkpoint: str, default: str = "default", available_now: bool = False
) -> StreamingQuery:
    """Deliver every row to the store of the first rule it fulfils. The store of a route is
    a log table of its own, ``path/route=<name>``, for ``read_logs``, searches and tails.

    A micro-batch is written to all stores by one job, each store by days, and replaces
    itself in all of them when it comes again. A route that takes most rows is cut by
    size."""

    name_of = batch_names(checkpoint)

    def deliver(batch: DataFrame, number: int) -> None:
        name = name_of(batch, number)
        routed = route_logs(batch, rules, default)
        stored = stored_rows(routed, ROUTE)
        replace_batch(stored, name, path, (ROUTE, STATUS, DATE))

    return start_batches(rows, deliver, checkpoint, available_now)


def route_store(path: str, route: str) -> str:
    """The log table of a route."""
    return f"{path.rstrip('/')}/{ROUTE}={route}"
