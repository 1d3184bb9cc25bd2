"""Joins by time: the last row before, the interval a time lies in, and what lies in each
interval counted without the pairs.

None is an equality, and all would be planned as nested loops. Here time is cut into
buckets, so that the work is spread by key and bucket, and a key that most rows share is
cut as well.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

# Sides of the union, in the order in which they stand at one instant: what came from
# earlier buckets, rows to be found, rows that look.
_CARRIED, _RIGHT, _LEFT = range(3)

HOUR = 3_600_000_000


def _micros(time: str) -> Column:
    return F.unix_micros(F.col(time).cast("timestamp"))


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    time: str = "Timestamp",
    columns: Sequence[str] | None = None,
    prefix: str = "last_",
    tie_break: Sequence[str] = (),
    bucket_micros: int = HOUR,
    tolerance_micros: int | None = None,
    inner: bool = False,
) -> DataFrame:
    """Each row of ``left`` beside the last row of ``right`` with equal ``on`` columns that
    is not later, its ``columns`` (default: all) under ``prefix``. Of right rows at one
    instant the one largest in ``tie_break`` counts. Rows without one get NULLs, or go with
    ``inner``; so do those whose last row is older than ``tolerance_micros``. NULL keys and
    times find nothing.

    Both sides meet by key and time bucket and take the last row from one window over
    that. What a bucket inherits is the last right row of the buckets before it; there is
    one candidate per key and bucket, and the second window runs over those only. So the
    rows of one key are spread over its buckets, however many they are.
    """
    wanted = list(columns) if columns is not None else list(right.columns)
    keys = [F.col(c) for c in on]
    usable = F.col(time).isNotNull()
    for key in keys:
        usable = usable & key.isNotNull()
    value = F.struct(*[F.col(c) for c in dict.fromkeys([time, *wanted])]).alias("_right")
    shape = [F.col(c).alias(f"_k{i}") for i, c in enumerate(on)]
    names = [f"_k{i}" for i in range(len(on))]
    bucket = F.floor(_micros(time) / bucket_micros).alias("_bucket")
    empty_row, empty_left = F.lit(None), F.lit(None)

    own = F.struct(*left.columns).alias("_left")
    right_type = right.where("false").select(value).schema["_right"].dataType
    left_type = left.where("false").select(own).schema["_left"].dataType
    tie = F.struct(*[F.col(c) for c in tie_break]) if tie_break else F.lit(0)
    tie_type = right.where("false").select(tie.alias("t")).schema["t"].dataType

    looking = left.where(usable).select(
        *shape, bucket, _micros(time).alias("_at"), F.lit(_LEFT).alias("_side"), F.lit(None).cast(tie_type).alias("_tie"),
        empty_row.cast(right_type).alias("_right"), own)
    found = right.where(usable).select(
        *shape, bucket, _micros(time).alias("_at"), F.lit(_RIGHT).alias("_side"), tie.alias("_tie"),
        value, empty_left.cast(left_type).alias("_left"))

    newest = found.groupBy(*names, "_bucket").agg(F.max_by("_right", F.struct("_at", "_tie")).alias("_right"))
    buckets = looking.select(*names, "_bucket").distinct().withColumn("_right", F.lit(None).cast(right_type))
    earlier = Window.partitionBy(*names).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    each = newest.unionByName(buckets).groupBy(*names, "_bucket").agg(F.first("_right", ignorenulls=True).alias("_right"))
    inherited = F.last("_right", ignorenulls=True).over(earlier)
    carried = each.select(*names, "_bucket", inherited.alias("_right")).where(F.col("_right").isNotNull())
    carried = carried.join(buckets.select(*names, "_bucket"), [*names, "_bucket"], "left_semi").select(
        *names, "_bucket", F.lit(None).cast("long").alias("_at"), F.lit(_CARRIED).alias("_side"),
        F.lit(None).cast(tie_type).alias("_tie"), "_right", empty_left.cast(left_type).alias("_left"))

    order = Window.partitionBy(*names, "_bucket").orderBy(F.col("_at").asc_nulls_first(), "_side", "_tie")
    last = F.last("_right", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    matched = looking.unionByName(found).unionByName(carried).withColumn("_found", last).where(F.col("_side") == _LEFT)
    near = F.col("_found").isNotNull()
    if tolerance_micros is not None:
        near = near & (F.col("_at") - F.unix_micros(F.col(f"_found.{time}").cast("timestamp")) <= tolerance_micros)
    shown = [F.when(near, F.col(f"_found.{c}")).alias(prefix + c) for c in wanted]
    if inner:
        return matched.where(near).select("_left.*", *shown)
    rest = left.where(~F.coalesce(usable, F.lit(False))).select(*left.columns, *[
        F.lit(None).cast(right_type[c].dataType).alias(prefix + c) for c in wanted])
    return matched.select("_left.*", *shown).unionAll(rest)


def range_join(
    points: DataFrame,
    intervals: DataFrame,
    time: str,
    start: str,
    end: str,
    on: Sequence[str] = (),
    bucket_micros: int = HOUR,
) -> DataFrame:
    """Pairs of a row of ``points`` and a row of ``intervals`` with ``start <= time <= end``
    and equal ``on`` columns, which come once; other names must differ. NULLs pair with
    nothing, intervals that end before they start neither.

    An equality join by bucket. An interval lies in buckets of a width not below its own
    length, a power of two times ``bucket_micros``, and so in two of them at most; a point
    is looked up in one bucket of every width there is. Long intervals are therefore not
    cut into many, there are some forty widths at most, and every pair meets once.
    """
    clash = {c.lower() for c in points.columns} & ({c.lower() for c in intervals.columns} - {c.lower() for c in on})
    if clash:
        raise ValueError(f"both sides have columns {sorted(clash)}")
    length = _micros(end) - _micros(start)
    doublings = F.ceil(F.log2(F.greatest(length / bucket_micros, F.lit(1.0)))).cast("int")
    sound = intervals.where(F.col(start) <= F.col(end)).withColumn("_level", doublings)
    levels = sorted(r[0] for r in sound.select("_level").distinct().collect())
    width = lambda level: F.lit(bucket_micros).cast("long") * F.pow(F.lit(2), level).cast("long")
    cell = lambda at, level: F.floor(at / width(level)).cast("long")
    level = F.col("_level")
    first, last = cell(_micros(start), level), cell(_micros(end), level)
    spread = sound.withColumn("_cell", F.explode(F.when(first == last, F.array(first)).otherwise(F.sequence(first, last))))
    places = F.array(*[F.lit(x) for x in levels]) if levels else F.array().cast("array<int>")
    looked = points.where(F.col(time).isNotNull()).withColumn("_level", F.explode(places)).withColumn("_cell", cell(_micros(time), level))
    pairs = looked.join(spread, ["_level", "_cell", *on])
    return pairs.where((F.col(time) >= F.col(start)) & (F.col(time) <= F.col(end))).drop("_level", "_cell")


# Points, and intervals, that ``range_counts`` brings together in one group; more are cut.
_TOGETHER = 1_000_000


def range_counts(
    points: DataFrame,
    intervals: DataFrame,
    time: str,
    start: str,
    end: str,
    by: str,
    value: str,
    bucket_micros: int = HOUR,
    together: int = _TOGETHER,
) -> DataFrame:
    """Per ``by`` of the intervals, what grouping ``range_join`` would give: ``n_pairs``,
    the pairs, and ``n_values``, the distinct ``value`` of their points, NULLs aside.
    Those without a pair are left out.

    Pairs grow with the product of both sides; here a point goes to two groups of every
    width of interval there is and an interval to one. A group is two buckets of time, not
    shorter than the interval, so it has all points of its intervals. Where it has more
    than ``together`` points they are cut by their value, so that the numbers of the cuts
    add up; where it has more than ``together`` intervals, these are cut too. Only the
    points of one value in two buckets stay in one place.

    Repeated equal intervals of one ``by`` are counted once and multiplied. Different ones
    can share values, which only the pairs tell: such a ``by`` is counted from them.
    """
    sound = intervals.where(F.col(start) <= F.col(end)).select(F.col(by).alias("_by"), start, end)
    extent = [f(c).alias(f"_{f.__name__}_{k}") for k, c in (("s", start), ("e", end)) for f in (F.min, F.max)]
    each = sound.groupBy("_by").agg(F.count("*").alias("_copies"), *extent)
    alike = (F.col("_min_s") == F.col("_max_s")) & (F.col("_min_e") == F.col("_max_e"))
    timed = points.where(F.col(time).isNotNull()).select(F.col(time), F.col(value).alias("_value"))

    length = F.col("_end") - F.col("_begin")
    doublings = F.ceil(F.log2(F.greatest(length / bucket_micros, F.lit(1.0)))).cast("int")
    width = lambda level: F.lit(bucket_micros).cast("long") * F.pow(F.lit(2), level).cast("long")
    cell = lambda at, level: F.call_function("div", at - F.pmod(at, width(level)), width(level))
    ranges = each.where(alike).select("_by", "_copies", _micros("_min_s").alias("_begin"), _micros("_max_e").alias("_end"))
    ranges = ranges.withColumn("_level", doublings + F.when(length > width(doublings), 1).otherwise(0))
    levels = sorted(r[0] for r in ranges.select("_level").distinct().collect())
    ranges = ranges.withColumn("_cell", cell(F.col("_begin"), F.col("_level")))
    places = F.array(*[F.lit(x) for x in levels]) if levels else F.array().cast("array<int>")
    looked = timed.select(_micros(time).alias("_at"), "_value", F.explode(places).alias("_level"))
    own = cell(F.col("_at"), F.col("_level"))
    looked = looked.withColumn("_cell", F.explode(F.array(own - 1, own)))

    group = ["_level", "_cell"]
    cuts = lambda side: F.ceil(F.sum(side) / together).cast("int")
    sizes = looked.groupBy(*group).agg(F.count("*").alias("_p")).withColumn("_i", F.lit(0).cast("long")).unionByName(
        ranges.groupBy(*group).agg(F.count("*").alias("_i")).withColumn("_p", F.lit(0).cast("long")))
    large = sizes.groupBy(*group).agg(cuts("_p").alias("_p"), cuts("_i").alias("_i")).where((F.col("_p") > 1) | (F.col("_i") > 1))
    number = lambda c: F.greatest(F.coalesce(c, F.lit(1)), F.lit(1))
    every = lambda c: F.explode(F.sequence(F.lit(0), number(c) - 1))
    cut = lambda key, c: F.pmod(F.xxhash64(key), number(F.col(c))).cast("int")
    key = F.when(F.col("_value").isNull(), F.xxhash64("_at")).otherwise(F.xxhash64("_value"))
    looked = looked.join(F.broadcast(large), group, "left").select(
        *group, cut(key, "_p").alias("_cut"), every(F.col("_i")).alias("_part"), "_at", "_value")
    ranges = ranges.join(F.broadcast(large), group, "left").select(
        *group, every(F.col("_p")).alias("_cut"), cut(F.col("_by"), "_i").alias("_part"), "_by", "_copies", "_begin", "_end")

    shape = StructType([sound.schema["_by"], *[StructField(c, LongType()) for c in ("n_pairs", "n_values")]])
    group += ["_cut", "_part"]
    counted = looked.groupBy(*group).cogroup(ranges.groupBy(*group)).applyInArrow(_count_in_ranges, shape)
    counted = counted.groupBy("_by").agg(F.sum("n_pairs").alias("n_pairs"), F.sum("n_values").alias("n_values"))

    several = each.where(~alike).select(F.col("_by").alias("_other"))
    unlike = sound.join(several, F.col("_by").eqNullSafe(F.col("_other")), "left_semi").select(
        "_by", F.col(start).alias("_begin"), F.col(end).alias("_end"))
    pairs = range_join(timed.withColumnRenamed(time, "_at"), unlike, "_at", "_begin", "_end", (), bucket_micros)
    rest = pairs.groupBy("_by").agg(F.count("*").alias("n_pairs"), F.count_distinct("_value").alias("n_values"))
    return counted.where("n_pairs > 0").unionByName(rest).withColumnRenamed("_by", by)


def _count_in_ranges(points: pa.Table, ranges: pa.Table) -> pa.Table:
    """Points of a group in each of its ranges, and their distinct values. Of a value in a
    range one point counts: that whose predecessor of the same value lies before it."""
    at = points["_at"].to_numpy()
    order = np.argsort(at, kind="stable")
    at = at[order]
    low = np.searchsorted(at, ranges["_begin"].to_numpy(), "left")
    high = np.searchsorted(at, ranges["_end"].to_numpy(), "right")
    codes = points["_value"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()[order]
    by_value = np.argsort(codes, kind="stable")
    again = codes[by_value[1:]] == codes[by_value[:-1]]
    # places from 1; 0: none before
    before = np.zeros(len(at), np.int64)
    before[by_value[1:][again]] = by_value[:-1][again] + 1
    before[codes < 0] = len(at) + 1
    n_values = _count_below(before, low, high, low + 1)
    n_pairs = (high - low) * ranges["_copies"].to_numpy()
    return pa.table({"_by": ranges["_by"], "n_pairs": n_pairs.astype(np.int64), "n_values": n_values})


def _count_below(values: np.ndarray, low: np.ndarray, high: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """How many of ``values[low:high]`` are below ``limit``, for many ranges at once. Bit
    by bit from the top, the values with 0 are put before those with 1; those with 0 where
    the limit has 1 are below it, and the range goes on among those with its own bit."""
    found = np.zeros(len(low), np.int64)
    for bit in reversed(range(max(int(values.max(initial=0)), int(limit.max(initial=0))).bit_length())):
        one = (values >> bit) & 1 == 1
        zeros = np.concatenate([[0], np.cumsum(~one)])
        up = (limit >> bit) & 1 == 1
        first, last = zeros[low], zeros[high]
        found += np.where(up, last - first, 0)
        low, high = np.where(up, zeros[-1] + low - first, first), np.where(up, zeros[-1] + high - last, last)
        values = np.concatenate([values[~one], values[one]])
    return found
