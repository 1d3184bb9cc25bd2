"""Skipping files in text searches: a filter per file over its messages' trigrams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidelog.functions.binding import bound
from tidelog.functions.text_match import literal_runs, text_predicate
from tidelog.session import path_exists, settings
from tidelog.sources.table import DATE, LOG_COLUMNS, OK, STATUS, STORED_SCHEMA

# Bits of a file's filter. A trigram sets one of them, so that of a file with a tenth of
# them set a text of six letters (four trigrams) is taken for present once in 10,000.
BITS = 1 << 20

_FILE = "file string, bucket long, bitmap binary"

# Bits of a row of the index, as Spark's bitmap functions cut them: place 0 alone is
# bucket 0, places from 1 on follow.
_BUCKET = 1 << 15

# A message's places are some bytes per character, so few messages go to Python at a time.
_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "64"}


def _trigrams(text: Column) -> Column:
    """Places of a text's trigrams among the bits. The text is cut into characters once;
    taking pieces of it one by one would go through it from the start each time."""

    def places(chars: Column) -> Column:
        starts = F.when(F.size(chars) >= 3, F.sequence(F.lit(0), F.size(chars) - 3)).otherwise(F.array().cast("array<int>"))
        three = F.transform(starts, lambda i: F.pmod(F.xxhash64(chars[i], chars[i + 1], chars[i + 2]), F.lit(BITS)))
        return F.array_distinct(three)

    return bound(F.filter(F.split(text, ""), lambda c: c != ""), places)


def _name(file: str) -> str:
    """A file's path, however its scheme is written."""
    return unquote(urlparse(file).path)


def _accepted(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STORED_SCHEMA).parquet(path).where(F.col(STATUS) == OK)


def index_text(spark: SparkSession, path: str, index: str) -> None:
    """Bring the text index of the log table ``path`` up to date: files it does not know
    are read once and get a filter each. To be run after writes; files without a filter
    are always searched, so a search is right in any case."""
    rows = _accepted(spark, path).select(F.col("_metadata.file_path").alias("file"), "Message")
    if path_exists(spark, f"{index.rstrip('/')}/_SUCCESS"):
        known = [r[0] for r in spark.read.schema(_FILE).parquet(index).select("file").distinct().collect()]
        if known:
            rows = rows.where(~F.col("_metadata.file_path").isin(known))
    places = rows.select("file", _trigrams(F.coalesce("Message", F.lit(""))).alias("places"))
    # a file cut over several tasks has a filter from each
    filters = places.mapInArrow(_file_filters, _FILE).groupBy("file", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    with settings(spark, _BATCH):
        filters.hint("rebalance").write.mode("append").parquet(index)


def _file_filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Filters of the files of one task. A scan goes through file by file, and a filter
    leaves when the next file begins, so that one is held however many rows there are."""
    file, seen = None, np.zeros(BITS, bool)
    for batch in batches:
        names, places = batch["file"].to_pylist(), batch["places"]
        flat, ends = places.values.to_numpy(), places.offsets.to_numpy()
        for k, name in enumerate(names):
            if name != file:
                if file is not None:
                    yield _rows_of(file, seen)
                file, seen = name, np.zeros(BITS, bool)
            seen[flat[ends[k] : ends[k + 1]]] = True
    if file is not None:
        yield _rows_of(file, seen)


def _rows_of(file: str, seen: np.ndarray) -> pa.RecordBatch:
    """A file's rows of the index. One without any trigram has place 0, or it would be
    searched every time."""
    seen[0] |= not seen.any()
    whole = np.packbits(np.append(seen[1:], False), bitorder="little").reshape(-1, _BUCKET // 8)
    used = np.flatnonzero(whole.any(axis=1))
    buckets, maps = [int(k) + 1 for k in used], [whole[k].tobytes() for k in used]
    if seen[0]:
        buckets, maps = [0, *buckets], [b"\1".ljust(_BUCKET // 8, b"\0"), *maps]
    return pa.RecordBatch.from_pydict({"file": [file] * len(buckets), "bucket": buckets, "bitmap": maps})


def files_with(spark: SparkSession, path: str, index: str, text: str, text_mode: str = "like") -> list[str] | None:
    """Files of the table that may hold a message with ``text``; None when the text has
    no three characters in a row that must occur, so that nothing can be skipped. The
    driver sees names of files, as it does for every scan."""
    runs = literal_runs(text) if text_mode == "like" else [text]
    runs = [run for run in runs if len(run) >= 3]
    if not runs or not path_exists(spark, f"{index.rstrip('/')}/_SUCCESS"):
        return None
    asked = spark.range(1).select(F.explode(F.array_distinct(F.concat(*[_trigrams(F.lit(run)) for run in runs]))).alias("p"))
    places = asked.select(F.bitmap_bucket_number("p").alias("bucket"), F.bitmap_bit_position("p").alias("bit")).collect()

    def is_set(bit: int) -> Column:
        byte = F.conv(F.hex(F.substring("bitmap", bit // 8 + 1, 1)), 16, 10).cast("int")
        return byte.bitwiseAND(1 << bit % 8) != 0

    hits = reduce(add, [F.when((F.col("bucket") == r["bucket"]) & is_set(r["bit"]), 1).otherwise(0) for r in places])
    found = spark.read.schema(_FILE).parquet(index).groupBy("file").agg((F.sum(hits) == len(places)).alias("may"))
    may = {_name(r["file"]): r["may"] for r in found.collect()}
    return [file for file in sorted(_accepted(spark, path).inputFiles()) if may.get(_name(file), True)]


def search_text(spark: SparkSession, path: str, index: str, text: str, text_mode: str = "like") -> DataFrame:
    """Rows of the log table whose message holds ``text``, by the text filter itself; the
    index only spares it files that cannot have any."""
    files = files_with(spark, path, index, text, text_mode)
    rows = _accepted(spark, path)
    if files is not None:
        base = spark.read.schema(STORED_SCHEMA).option("basePath", path)
        rows = base.parquet(*files).where(F.col(STATUS) == OK) if files else rows.limit(0)
    return rows.where(text_predicate(F.col("Message"), text, text_mode)).select(*LOG_COLUMNS, DATE)
