"""Streams whose rows may come more than once: each is stored once."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.operators.output import stored_rows
from tidelog.sources.table import BATCH, DATE, KEY, LOG_COLUMNS, OK, STATUS, STORED_SCHEMA, is_log_table
from tidelog.streaming.sink import batch_names, replace_batch
from tidelog.streaming.tail_stream import start_batches

# So many days of a micro-batch are named to the scan of the table one by one, with their
# range of times; beyond, the scan gets the first and last day.
_NAMED_DAYS = 64

_ARRIVED = "arrived_at"


def event_key(keys: Sequence[str]) -> Column:
    """The columns that identify a row to its sender, as JSON text; NULLs count."""
    return F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})


def _compared(keys: Sequence[str] | None) -> list[str]:
    """The stored columns that tell rows apart: the day's key, or all four columns."""
    return [KEY] if keys else list(LOG_COLUMNS)


def _where_held(stored: DataFrame) -> Column | None:
    """Which part of the table can hold copies of the rows, by day and time; None if the
    rows are none."""
    seen = stored.groupBy(DATE).agg(F.min("Timestamp").cast("timestamp_ntz").alias("low"), F.max("Timestamp").cast("timestamp_ntz").alias("high"))
    days = seen.limit(_NAMED_DAYS + 1).collect()
    if not days:
        return None
    if len(days) > _NAMED_DAYS:
        low, high = stored.agg(F.min(DATE), F.max(DATE)).first()
        return F.col(DATE).between(low, high) | F.col(DATE).isNull()

    def in_utc(value: dt.datetime) -> Column:
        return F.lit(value.replace(tzinfo=dt.timezone.utc)).cast("timestamp")

    # a row without a time has no day
    parts = [
        F.col(DATE).isNull() if r[DATE] is None
        else (F.col(DATE) == F.lit(r[DATE])) & F.col("Timestamp").between(in_utc(r["low"]), in_utc(r["high"]))
        for r in days
    ]
    return reduce(or_, parts)


def unseen_rows(batch: DataFrame, path: str, keys: Sequence[str] | None = None, own: str | None = None) -> DataFrame:
    """One row of each kind in a batch that the log table does not hold yet. Rows are of a
    kind when their ``keys`` are equal, without keys when all four columns are; copies
    have the same time. Copies are reduced within each task first, so a row may be any
    share of the batch; of the table only the days and times of the batch are read, and
    not what a first run of the batch has written under its ``own`` name."""
    spark, same_columns = batch.sparkSession, _compared(keys)
    if keys and KEY not in batch.columns:
        batch = batch.withColumn(KEY, event_key(keys))
    stored = stored_rows(batch).dropDuplicates(same_columns)
    if not is_log_table(spark, path):
        return stored
    # copies have the same day and time, so the batch itself says where to look
    part = _where_held(stored_rows(batch))
    if part is None:
        return stored
    held = spark.read.schema(STORED_SCHEMA).parquet(path).where((F.col(STATUS) == OK) & part)
    if own:
        held = held.where(F.col(BATCH) != F.lit(own))
    held = held.select(F.col(DATE).alias("_day"), F.xxhash64(*same_columns).alias("_held"), *[F.col(c).alias(f"_{c}") for c in same_columns])
    stored = stored.withColumn("_hash", F.xxhash64(*same_columns))
    same = [F.col(DATE).eqNullSafe(F.col("_day")), F.col("_hash") == F.col("_held")]
    same += [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same_columns]
    return stored.join(held, reduce(and_, same), "left_anti").drop("_hash")


def dedup_stream(rows: DataFrame, keys: Sequence[str] | None = None, delay: str = "10 minutes") -> DataFrame:
    """The stream without the copies that arrive within ``delay`` of the first one, by
    Spark's keyed state. The watermark is on the time of arrival, which is the same when a
    micro-batch comes again, and not on the rows' own: no row is ever behind it, so none
    is dropped for its age, and the state holds the keys of the last arrivals only."""
    keyed = rows.withColumn(KEY, event_key(keys)) if keys else rows
    arrived = keyed.withColumn(_ARRIVED, F.current_timestamp()).withWatermark(_ARRIVED, delay)
    return arrived.dropDuplicatesWithinWatermark(_compared(keys))


def split_by_age(batch: DataFrame, delay: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``dedup_stream`` that nobody can have stored before, and the others. A row
    whose own time is within half the delay before its arrival had no earlier chance to
    come than the state remembers, even if the sender's clock is off by the other half.
    Older rows, those from the future and those without a time may have come before."""
    age = F.unix_micros(_ARRIVED) - F.unix_micros(F.col("Timestamp").cast("timestamp"))
    half = F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"INTERVAL '{delay}'")) / 2
    young = F.coalesce((age >= 0) & (age < half), F.lit(False))
    return batch.where(young).drop(_ARRIVED), batch.where(~young).drop(_ARRIVED)


def start_dedup(
    rows: DataFrame,
    path: str,
    checkpoint: str,
    available_now: bool = False,
    keys: Sequence[str] | None = None,
    delay: str = "10 minutes",
) -> StreamingQuery:
    """Append the rows of an at-least-once source to a log table that has each of them
    once, by the sender's ``keys`` or else by all columns. The first copy to arrive stays.

    Copies that come soon meet the state. Rows that may have come before the state's time
    are compared with the table itself, so that a copy is recognised however late it
    comes; a live stream has few of those, a load of old rows has nothing else. Copies
    carry the same time. A micro-batch that comes again replaces itself and is not
    compared with what it has written.
    """
    name_of = batch_names(checkpoint)

    def append(batch: DataFrame, number: int) -> None:
        name = name_of(batch, number)
        # what follows goes through the batch several times, the state once
        batch.persist()
        try:
            young, other = split_by_age(batch.select("row.*"), delay)
            fresh = stored_rows(young).unionByName(unseen_rows(other, path, keys, name))
            replace_batch(fresh, name, path, (STATUS, DATE))
        finally:
            batch.unpersist()

    # a batch with the state's partitioning would not be known as the kept one in a union
    packed = dedup_stream(rows, keys, delay).select(F.struct("*").alias("row"))
    return start_batches(packed, append, checkpoint, available_now)
