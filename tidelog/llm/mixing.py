"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidelog.llm.common import SPACE, saved

# Weights by the place of a source in code point order, the size of the
# mix as a share of all words, and how often a document may be taken.
WEIGHTS = (5.0, 2.0, 1.0)
MIX_SHARE = 1.5
MAX_EPOCHS = 2

# Weight of a source over training time, as (time, factor) knots joined by lines, by the
# source's mix weight: heavy sources fade out, light ones fade in. Only the shape counts.
Schedule = Sequence[tuple[float, float]]
SCHEDULES: Mapping[float, Schedule] = {
    5.0: ((0.0, 1.25), (0.5, 1.0), (1.0, 0.75)),
    2.0: ((0.0, 1.0), (1.0, 1.0)),
    1.0: ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
}

# Words are summed over blocks of a source's order, 16 to this power of them, so that no
# source is one task's work.
BLOCK_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = MIX_SHARE, epochs: int = MAX_EPOCHS) -> DataFrame:
    """``m_source, source_size, weight, target`` from ``source, size`` rows.

    A target is the smaller of ``epochs`` times the source's size and its weight times a
    level that all sources have in common. Sources reach their bound in the order of
    bound by weight, so the level follows from running sums in that order.
    """
    totals = sizes.groupBy(F.col("source").alias("m_source")).agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("m_source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weighted = totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1))
    bound = F.col("source_size") * float(epochs)
    by_bound = Window.orderBy(F.col("bound") / F.col("weight"), F.col("m_source").asc_nulls_last())
    everything = Window.partitionBy()
    running = weighted.withColumn("bound", bound).withColumns(
        {
            "bounds_before": F.coalesce(F.sum("bound").over(by_bound.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "weights_from": F.sum("weight").over(by_bound.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
            "mix_size": F.sum("source_size").over(everything) * float(share),
        }
    )
    # the level if this source and those after it stay below their bounds
    level = (F.col("mix_size") - F.col("bounds_before")) / F.col("weights_from")
    free = running.withColumn("level", level).withColumn("is_free", F.col("bound") >= F.col("level") * F.col("weight"))
    # from the first free source on the level only falls, also among equal ones
    common = F.max(F.when(F.col("is_free"), F.col("level"))).over(everything)
    target = F.when(F.col("is_free"), common * F.col("weight")).otherwise(F.col("bound"))
    return free.select("m_source", "source_size", "weight", F.coalesce(target, F.lit(0.0)).alias("target"))


def time_of_demand(part: Column, schedule: Schedule) -> Column:
    """Training time at which a source has given ``part`` (0 to 1) of its words: the
    inverse of the integral of its weight schedule, piece by piece."""
    pieces, area = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        pieces.append((area, t0, w0, (w1 - w0) / (t1 - t0)))
        area += (w0 + w1) / 2 * (t1 - t0)
    demand = part * area
    time = None
    for before, t0, w0, slope in pieces:
        rest = F.greatest(demand - before, F.lit(0.0))
        # w0 x + slope x^2 / 2 = rest, in the form that holds for slope 0 too
        x = 2 * rest / (w0 + F.sqrt(F.greatest(w0 * w0 + 2 * slope * rest, F.lit(0.0))))
        here = F.lit(t0) + x
        time = here if time is None else F.when(demand >= before, here).otherwise(time)
    return F.least(time, F.lit(float(schedule[-1][0])))


def _sized(docs: DataFrame, *extra: Column) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", "source", word_count(text).alias("size"), F.xxhash64(text).alias("content"), *extra)


def _source_key(source: str) -> Column:
    """A source as text that is never NULL. Rows dealt by it for a window need not be
    dealt again for a join, as they would be for one that takes NULLs for equal."""
    return F.when(F.col(source).isNull(), "-").otherwise(F.concat(F.lit("+"), source))


def _with_order(sized: DataFrame) -> DataFrame:
    """A random but repeatable order of the documents, and the block of the order."""
    ordered = sized.withColumn("order", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return ordered.withColumns({"block": F.substring("order", 1, BLOCK_DIGITS), "source_key": _source_key("source")})


def _placed(sized: DataFrame, sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds ``start``, the words before a document in its source's order, and the
    source's size, weight and target. ``sizes`` has the same documents without the
    columns that only travel along. Words are summed per block of the order first, so
    that a source may hold any share of the documents."""
    blocks = _with_order(sizes).groupBy(F.col("source_key").alias("b_key"), F.col("block").alias("b_block")).agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("b_key").orderBy("b_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("b_key", "b_block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    offsets = offsets.join(targets, F.col("b_key") == _source_key("m_source")).drop("m_source")
    inside = Window.partitionBy("source_key", "block").orderBy("order", "content", "size").rowsBetween(Window.unboundedPreceding, -1)
    summed = _with_order(sized).withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    same = (F.col("source_key") == F.col("b_key")) & (F.col("block") == F.col("b_block"))
    return summed.join(offsets, same).withColumn("start", F.col("before") + F.col("within"))


def _takes(epochs: int, cut: bool, schedules: Mapping[float, Schedule]) -> list[tuple[Column, Column]]:
    """Per epoch: the words taken of a document, and the training time at which its
    source's demand has reached it."""
    goal = F.floor("target") if cut else F.col("target")
    takes = []
    for epoch in range(epochs):
        before = F.col("source_size") * epoch + F.col("start")
        missing = goal - before
        if cut:
            words = F.greatest(F.least(missing.cast("long"), F.col("size")), F.lit(0))
        else:
            words = F.when(2 * missing >= F.col("size"), F.col("size")).otherwise(0)
        part = F.when(F.col("target") > 0, F.least(before / F.col("target"), F.lit(1.0)))
        time = F.lit(None).cast("double")
        for weight, schedule in schedules.items():
            time = F.when(F.col("weight") == float(weight), time_of_demand(part, schedule)).otherwise(time)
        takes.append((words.cast("long"), time))
    return takes


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = MIX_SHARE,
    epochs: int = MAX_EPOCHS,
    schedules: Mapping[float, Schedule] = SCHEDULES,
) -> DataFrame:
    """Per document: its ``size`` in words, its source's size and target, the words the
    mix takes of it (``taken``) and when it comes first in training (``position``, 0 to
    1, NULL if it never does). Rows are sorted by position over all partitions.

    A source gives its documents in a repeatable random order, again and again up to
    ``epochs`` times, until its target is reached; the last document gives only the words
    that are missing. The words before a document, as a share of the target, are the
    source's demand at which it comes; the source's weight schedule, integrated and
    inverted, says at which time that demand is reached.

    A NULL text has no words, and documents without words take none. A NULL source is a
    source of its own, the last one; a NULL doc_id and rows that repeat a document are
    documents too. An empty table gives an empty result; extra columns are left out.
    """
    sizes = saved(_sized(docs), "sizes")
    rows = _placed(sizes, sizes, source_targets(sizes, weights, share, epochs))
    takes = _takes(epochs, True, schedules)
    taken = sum((words for words, _ in takes[1:]), takes[0][0])
    rows = rows.withColumn("taken", taken).withColumn("position", F.when(F.col("taken") > 0, takes[0][1]))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "position").orderBy(
        F.col("position").asc_nulls_last(), "doc_id"
    )


def mix_documents(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = MIX_SHARE,
    epochs: int = MAX_EPOCHS,
    schedules: Mapping[float, Schedule] = SCHEDULES,
) -> DataFrame:
    """The mix itself: whole documents with all their columns, each as often as it is
    taken, range-sorted by training position. A source's last document is taken or not,
    whichever comes nearer to the target. Nulls and repeats count as in ``mix``."""
    sizes = saved(_sized(docs), "sizes")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = _placed(_sized(docs, whole), sizes, source_targets(sizes, weights, share, epochs))
    takes = [F.struct(words.alias("words"), time.alias("time")) for words, time in _takes(epochs, False, schedules)]
    copies = rows.select("row", F.explode(F.filter(F.array(*takes), lambda x: x["words"] > 0)).alias("take"))
    return copies.orderBy("take.time", "row.doc_id").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
