"""Live tail over the log table, as streaming queries."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.functions.timestamps import parse_bound
from tidelog.operators.filters import LOOK_BACK, Bound, since
from tidelog.session import path_exists, require_utc
from tidelog.sources.bodies import ANY_AGE
from tidelog.sources.table import DATE, LOG_COLUMNS, LOG_SCHEMA, OK, STATUS
from tidelog.streaming.sink import replace_batch

# Fixed value: how often a tail looks for new rows.
POLL = dt.timedelta(milliseconds=1500)

_NEWEST = "number long, newest long"


def days_from(day: dt.date) -> str:
    """Glob of the day folders from ``day`` on: for every digit of the date, those that
    begin like it and are larger there, and the day itself."""
    text = day.isoformat()
    found = [f"{DATE}={text}"]
    for k, digit in enumerate(text):
        if digit.isdigit() and digit != "9":
            found.append(f"{DATE}={text[:k]}[{int(digit) + 1}-9]*")
    return "{" + ",".join(found) + "}"


def tail_logs(
    spark: SparkSession, path: str, start: Bound | None = None, plain: bool = False, extra: str = "", **options
) -> DataFrame:
    """Streaming read of the log table from ``start`` on (default: the last hour).

    Stored rows come first, then new ones; the source offsets give every row once, late
    ones too. The table need not be there yet. Only the accepted rows of the days from
    the start on are listed, so that a poll costs as much as those days have files. The
    default start moves with the clock; a tail that is to resume after a pause needs a
    fixed one. ``plain`` tails a folder of other parquet files with the four columns and,
    as ``extra`` declares them, further ones. ``options`` go to the file source.
    """
    require_utc(spark)
    first = dt.datetime.now(dt.timezone.utc) - LOOK_BACK if start is None else parse_bound(start)
    folder = path if plain else f"{path.rstrip('/')}/{STATUS}={OK}/{days_from(first.date())}"
    deep = {} if plain else {"recursiveFileLookup": "true"}
    schema = ", ".join(filter(None, [*[f"`{f.name}` {f.dataType.simpleString()}" for f in LOG_SCHEMA.fields], extra]))
    rows = spark.readStream.schema(schema).options(**{"maxFileAge": ANY_AGE} | deep | options).parquet(folder)
    return since(rows, start)


def flag_late(batch: DataFrame, number: int, checkpoint: str, column: str = "late") -> DataFrame:
    """Adds whether a row is older than the newest one of earlier micro-batches, which a
    polling tail with a time cursor would have lost. No row is dropped, and a row from the
    future only makes others late.

    The newest time so far lies beside the checkpoint in two places that take turns: a
    micro-batch reads what the one before it left and overwrites the other one. So a
    micro-batch that comes again finds the same, and a poll costs the same however many
    there were.
    """
    spark, folder = batch.sparkSession, f"{checkpoint.rstrip('/')}/newest"
    last = f"{folder}/{(number + 1) % 2}"
    found = spark.read.schema(_NEWEST).parquet(last).first() if path_exists(spark, f"{last}/_SUCCESS") else None
    before = found["newest"] if found and found["number"] < number else None
    own = batch.agg(F.max(F.unix_micros("Timestamp"))).first()[0]
    newest = max((x for x in (before, own) if x is not None), default=None)
    spark.createDataFrame([(number, newest)], _NEWEST).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{number % 2}")
    late = F.lit(False) if before is None else F.coalesce(F.unix_micros("Timestamp") < before, F.lit(False))
    return batch.withColumn(column, late)


def start_tail(
    rows: DataFrame,
    checkpoint: str,
    path: str | None = None,
    on_batch: Callable[[DataFrame, int], None] | None = None,
    available_now: bool = False,
    late_column: str | None = None,
) -> StreamingQuery:
    """One consumer's tail: to a parquet folder of its own, where each micro-batch is a
    partition by number, or to ``on_batch``, which gets each new batch and its number (a
    number may come again after a failure; a folder has each once). ``late_column`` adds
    that column, see ``flag_late``. Stopping the query ends the tail; starting it again on
    the checkpoint goes on where it was."""
    if (path is None) == (on_batch is None):
        raise ValueError("a tail needs either a path or a function")

    def deliver(batch: DataFrame, number: int) -> None:
        if late_column:
            batch = flag_late(batch, number, checkpoint, late_column)
        if path is not None:
            replace_batch(batch, f"{number:019d}", path)
        else:
            on_batch(batch, number)

    return start_batches(rows, deliver, checkpoint, available_now)


def read_tail(spark: SparkSession, path: str, *extra: str) -> DataFrame:
    """What a tail has delivered to a folder: the four columns and the ``extra`` ones."""
    return spark.read.parquet(path).select(*LOG_COLUMNS, *extra)


def start_batches(rows: DataFrame, deliver: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(deliver)
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{POLL // dt.timedelta(milliseconds=1)} milliseconds").start()
