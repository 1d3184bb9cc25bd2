"""Writing the log table, and the text forms in which rows leave it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from tidelog.functions.timestamps import DISPLAY_FORMAT, display_text, micros_text
from tidelog.operators.ingest import REASON
from tidelog.session import require_utc, settings
from tidelog.sources.table import BATCH, DATE, KEY, LOG_COLUMNS, OK, QUARANTINE, STATUS, STORED_SCHEMA

# Labels of the expanded view, by column.
LABELS = {"Timestamp": "Timestamp", "Level": "Level", "Message": "Message", "ResourceID": "ResourceId"}

# Timestamps as 64-bit integers: the default form has no minimum and maximum in the file
# footers, and time filters could skip nothing inside a day.
STORAGE = {
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    # Opening a day's file takes longer than writing some rows, so small days are dealt to
    # all cores instead of being merged into one task; a day stays in one task all the same.
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k",
}

# Bloom filters let a search for one resource skip row groups in which the column has too
# many values for a dictionary.
FILE_OPTIONS = {
    "parquet.bloom.filter.enabled#ResourceID": "true",
    "parquet.bloom.filter.adaptive.enabled": "true",
}


def stored_rows(rows: DataFrame, *extra: str) -> DataFrame:
    """Log rows in the layout of the table but for the batch, which the write names.
    Columns are chosen by name, ``extra`` ones come first; rows that carry a reason go to
    quarantine. The day is the UTC one."""
    require_utc(rows.sparkSession)
    reason = F.col(REASON) if REASON in rows.columns else F.lit(None)
    body = F.col("body") if "body" in rows.columns else F.lit(None)
    values = {name: F.col(name) for name in LOG_COLUMNS}
    values |= {
        REASON: reason,
        "body": body,
        KEY: F.col(KEY) if KEY in rows.columns else F.lit(None),
        STATUS: F.when(reason.isNull(), F.lit(OK)).otherwise(F.lit(QUARANTINE)),
        DATE: F.when(reason.isNull(), F.to_date("Timestamp")),
    }
    return rows.select(*extra, *[values[f.name].cast(f.dataType).alias(f.name) for f in STORED_SCHEMA.fields if f.name in values])


def write_logs(rows: DataFrame, path: str, max_rows_per_file: int | None = None, batch: str | None = None) -> None:
    """Append rows to the log table.

    Rows of a day are brought together, so that a day is few files rather than one per
    task. The rebalance splits a heavy day over several tasks by size and merges light
    ones; sorting by time inside a task gives row groups narrow time ranges. A ``batch``
    with a name that was used before replaces what that name wrote to the same days, so
    that a load that failed can be run again; without a name it is added.
    """
    spark = rows.sparkSession
    stored, folder, parts = stored_rows(rows), path, [STATUS, DATE]
    if REASON not in rows.columns:
        # Only accepted rows: write below their partition. A constant partition column
        # would make the writer sort again, by partition alone.
        stored, folder, parts = stored.drop(STATUS), f"{path.rstrip('/')}/{STATUS}={OK}", [DATE]
    stored = stored.withColumn(BATCH, F.lit(batch or f"load-{uuid.uuid4().hex}"))
    writer = (
        stored.hint("rebalance", *parts)
        .sortWithinPartitions(*parts, BATCH, "Timestamp")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .options(**FILE_OPTIONS)
        .partitionBy(*parts, BATCH)
    )
    if max_rows_per_file:
        writer = writer.option("maxRecordsPerFile", max_rows_per_file)
    with settings(spark, STORAGE):
        writer.parquet(folder)


def write_routed(rows: DataFrame, path: str, column: str = "route") -> None:
    """Append routed rows, each route to a folder of its own, in one pass. A route that
    takes most rows is cut by size."""
    with settings(rows.sparkSession, STORAGE):
        rows.hint("rebalance", column).write.mode("append").options(**FILE_OPTIONS).partitionBy(column).parquet(path)


def to_json_rows(df: DataFrame, column: str = "value") -> DataFrame:
    """One JSON object per row, the timestamp as text with microseconds."""
    require_utc(df.sparkSession)
    fields = [
        (micros_text(F.col(name)) if name == "Timestamp" else F.col(name)).alias(name) for name in df.columns
    ]
    return df.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias(column))


def summary_rows(df: DataFrame, tz: str = "UTC", pattern: str = DISPLAY_FORMAT) -> DataFrame:
    """Collapsed view: displayed timestamp and the whole row as JSON text."""
    require_utc(df.sparkSession)
    fields = [micros_text(F.col("Timestamp")).alias("Timestamp"), *LOG_COLUMNS[1:]]
    return df.select(
        display_text(F.col("Timestamp"), tz, pattern).alias("shown_at"),
        F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("summary"),
    )


def expanded_rows(df: DataFrame, ids: tuple[str, ...] = (), tz: str = "UTC", pattern: str = DISPLAY_FORMAT) -> DataFrame:
    """Expanded view: four labelled rows ``(field, value)`` per log, with ``ids`` to tell
    the logs apart."""
    shown = df.select(
        *ids,
        display_text(F.col("Timestamp"), tz, pattern).alias(LABELS["Timestamp"]),
        *[F.col(name).alias(LABELS[name]) for name in LOG_COLUMNS[1:]],
    )
    return shown.unpivot(list(ids), list(LABELS.values()), "field", "value")


def export_logs(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Write a search result to a new folder as JSON lines, CSV or parquet."""
    if fmt == "json":
        to_json_rows(df).write.text(path)
    elif fmt == "csv":
        texts = [micros_text(F.col(name)).alias(name) if name == "Timestamp" else F.col(name) for name in df.columns]
        options = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        df.select(*texts).write.options(**options).csv(path)
    elif fmt == "parquet":
        df.write.parquet(path)
    else:
        raise ValueError(f"export format must be json, csv or parquet, not {fmt!r}")
