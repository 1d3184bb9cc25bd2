"""Micro-batches as partitions that replace themselves, and compacting finished days."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidelog.operators.output import FILE_OPTIONS, STORAGE
from tidelog.session import delete_path, path_exists, settings
from tidelog.sources.table import BATCH, DATE, OK, STATUS, STORED_SCHEMA


def batch_names(checkpoint: str) -> Callable[[DataFrame, int], str]:
    """Names of the micro-batches of the query that keeps its progress at ``checkpoint``:
    Spark's own id of the query, and the number. A checkpoint that was removed and made
    anew has another id, so that its micro-batches, which are numbered from 0 again,
    replace nothing."""
    known: list[str] = []

    def name(batch: DataFrame, number: int) -> str:
        if not known:
            metadata = batch.sparkSession.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0]
            known.append(json.loads(metadata)["id"])
        return f"{known[0]}-{number}"

    return name


def replace_batch(
    batch: DataFrame, name: str, path: str, parts: Sequence[str] = (), max_rows_per_file: int | None = None
) -> None:
    """Write ``batch`` below the parquet folder ``path``, partitioned by ``parts`` and last
    by its own ``name``, in place of what that name has written there.

    One Spark job with dynamic partition overwrite: the files come into place when all are
    written. A batch that comes again after a failure, wherever it failed, has the same
    rows and so the same partitions, and replaces them; other batches are left alone. A
    tail that runs meanwhile takes the replaced files for new ones.
    """
    rows = batch.withColumn(BATCH, F.lit(name))
    keys = [*parts, BATCH]
    rows = rows.hint("rebalance", *keys).sortWithinPartitions(*keys, "Timestamp")
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").options(**FILE_OPTIONS)
    if max_rows_per_file:
        writer = writer.option("maxRecordsPerFile", max_rows_per_file)
    with settings(batch.sparkSession, STORAGE):
        writer.partitionBy(*keys).parquet(path)


def compact_days(spark: SparkSession, path: str, before: dt.date, min_files: int = 2) -> list[dt.date]:
    """Rewrite each day before ``before`` that has ``min_files`` files or more as few
    sorted ones, cut by size. Returns the days.

    For finished days: nothing may write to them meanwhile, and a running tail that
    watches such a day would take the new files for new rows. A day is first written to a
    table of its own beside the days, then overwritten from it, and the table removed; a
    run that breaks off in between leaves the table, from which the next one goes on.
    """
    top = path.rstrip("/")
    accepted = spark.read.schema(STORED_SCHEMA).parquet(path).where((F.col(STATUS) == OK) & (F.col(DATE) < F.lit(before)))
    files = accepted.select(DATE, F.col("_metadata.file_path").alias("file")).distinct()
    many = files.groupBy(DATE).count().where(F.col("count") >= min_files).collect()
    columns = [f for f in STORED_SCHEMA.names if f not in (STATUS, DATE, BATCH)]
    halfway = [r[0] for r in _days_in(spark, f"{top}/_compacting") if r[0] < before]
    done = sorted({r[DATE] for r in many} | set(halfway))
    for day in done:
        work, folder = f"{top}/_compacting/day={day}", f"{top}/{STATUS}={OK}/{DATE}={day}"
        with settings(spark, STORAGE):
            if not path_exists(spark, f"{work}/_SUCCESS"):
                rows = accepted.where(F.col(DATE) == F.lit(day)).select(*columns)
                rows.hint("rebalance").sortWithinPartitions("Timestamp").write.mode("overwrite").options(**FILE_OPTIONS).parquet(work)
            kept = spark.read.parquet(work).withColumn(BATCH, F.lit("compacted"))
            kept.sortWithinPartitions("Timestamp").write.mode("overwrite").options(**FILE_OPTIONS).partitionBy(BATCH).parquet(folder)
        delete_path(spark, work)
    return done


def _days_in(spark: SparkSession, work: str) -> list:
    """Days whose own tables an earlier run has left."""
    if not path_exists(spark, work):
        return []
    return spark.read.schema("day date").parquet(work).select("day").distinct().collect()
