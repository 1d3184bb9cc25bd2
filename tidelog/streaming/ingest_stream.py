"""Streaming ingest: bodies to log table, each body exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidelog.operators.batching import TICK
from tidelog.operators.ingest import to_log_rows
from tidelog.operators.output import stored_rows
from tidelog.session import require_utc
from tidelog.sources.bodies import read_log_bodies
from tidelog.sources.table import DATE, STATUS
from tidelog.streaming.sink import batch_names, replace_batch


def start_stream_write(
    rows: DataFrame,
    path: str,
    checkpoint: str,
    trigger_seconds: float = TICK,
    available_now: bool = False,
    max_rows_per_file: int | None = None,
) -> StreamingQuery:
    """Append a stream of log rows to the table, in the layout of batch writes, so that
    both may fill one table.

    A micro-batch is a partition named by query and number and replaces itself when it
    comes again, so that each row is there once, whatever fails. Accepted and quarantined
    rows leave together and are told apart by partition. The rows of a day are brought
    together, so that a micro-batch adds few files rather than one per task and day;
    adaptive execution cuts a heavy day by size. ``compact_days`` replaces the files of
    finished days by few large ones.
    """
    require_utc(rows.sparkSession)

    name_of = batch_names(checkpoint)

    def append(batch: DataFrame, number: int) -> None:
        name = name_of(batch, number)
        replace_batch(stored_rows(batch), name, path, (STATUS, DATE), max_rows_per_file)

    trigger = {"availableNow": True} if available_now else {"processingTime": f"{int(trigger_seconds * 1000)} milliseconds"}
    return rows.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def start_ingest(
    spark: SparkSession,
    src: str,
    dst: str,
    checkpoint: str,
    on_bad_json: str = "quarantine",
    on_bad_ts: str = "quarantine",
    archive: str | None = None,
    source_options: dict | None = None,
    **write_options,
) -> StreamingQuery:
    """Watch a folder of body files and keep the log table up to date. With ``archive``,
    a folder outside ``src``, files that were taken move there, so that listings stay
    short."""
    options = dict(source_options or {})
    if archive:
        options |= {"cleanSource": "archive", "sourceArchiveDir": archive}
    bodies = read_log_bodies(spark, src, streaming=True, **options)
    rows = to_log_rows(bodies, "value", on_bad_json, on_bad_ts)
    return start_stream_write(rows, dst, checkpoint, **write_options)
