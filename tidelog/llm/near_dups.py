"""Near-duplicate documents: MinHash with tensored banding, links confirmed on full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tidelog.llm.common import saved

# Similarity in percent from which two documents are linked.
PERCENT = 80

# Two small collections of hashes: single minimums, and pairs of minimums. Every
# combination of one from each is a table key: 6 * 10 tables from 6 + 20 minimums. Two
# sets of similarity 0.8 share no key with probability 0.2^6 + 0.36^10 = 1e-4.
SINGLES = 6
PAIRS = 10
N_HASHES = SINGLES + 2 * PAIRS

# Candidates that agree on fewer minimums are not verified: at similarity 0.8 this
# happens with probability 2e-5.
MIN_AGREE = 11

# Buckets left with several components are compared in blocks: up to some BLOCK members
# outside the main component with up to some SLICE members at a time. In a sketch, each
# shingle flips one of BITS bits.
BLOCK = 1024
SLICE = 8192
BITS = 2048

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_RANDOM = np.random.RandomState(20).randint(0, 1 << 62, size=(2, N_HASHES), dtype=np.int64).astype(np.uint64)
_FACTORS, _SHIFTS = _RANDOM[0] * np.uint64(2) + np.uint64(1), _RANDOM[1]
_CACHE_WORDS = 1_000_000


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, width: int, known: dict) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; all words are one run when
    there are fewer. Words are what ASCII white space separates, A-Z in lower case."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    run = min(width, len(words))
    rolled = np.full(len(words) - run + 1, run, np.uint64)
    for i in range(run):
        rolled = rolled * _PRIME + hashes[i : i + len(rolled)]
    return np.unique(_mixed(rolled))


def _minimums(sets: list[np.ndarray]) -> np.ndarray:
    """One row of minimums per (non-empty) set."""
    if not sets:
        return np.zeros((0, N_HASHES), np.uint32)
    every = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    found = np.empty((len(sets), N_HASHES), np.uint32)
    for i in range(N_HASHES):
        found[:, i] = np.minimum.reduceat(every * _FACTORS[i] + _SHIFTS[i], starts) >> np.uint64(32)
    return found


def _chunks(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for at in range(0, max(batch.num_rows, 1), rows):
        yield batch.slice(at, rows)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, n_shingles, h1, h2, sig``: size and hash of each document's set, and its
    minimums; no hash and no minimums for an empty set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHash()
        for whole in batches:
            for batch in _chunks(whole):
                sets = [shingle_set(t, width, known) for t in batch.column("text").to_pylist()]
                lows = iter(_minimums([s for s in sets if len(s)]))
                digests = [np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64).tolist() if len(s) else (None, None) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").cast(pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([d[0] for d in digests], pa.int64()),
                        pa.array([d[1] for d in digests], pa.int64()),
                        pa.array([next(lows).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "h1", "h2", "sig"],
                )

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, n_shingles long, h1 long, h2 long, sig binary")


def _signature_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, N_HASHES)


def table_keys(classes: DataFrame) -> DataFrame:
    """``key, t, id``: every combination of a single minimum and a pair of minimums, and
    the number of its table."""

    def tensor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = _signature_rows(batch.column("sig")).astype(np.uint64)
            single = _mixed(sig[:, :SINGLES] + (np.arange(SINGLES, dtype=np.uint64) + np.uint64(1)) * _PRIME)
            pairs = sig[:, SINGLES:].reshape(len(sig), PAIRS, 2)
            pair = _mixed((pairs[:, :, 0] << np.uint64(32) | pairs[:, :, 1]) + (np.arange(PAIRS, dtype=np.uint64) + np.uint64(101)) * _PRIME)
            keys = _mixed(single[:, :, None] * np.uint64(3) + pair[:, None, :]).reshape(len(sig), -1)
            ids = np.repeat(batch.column("id").to_numpy(zero_copy_only=False), SINGLES * PAIRS)
            tables = np.tile(np.arange(SINGLES * PAIRS, dtype=np.int32), len(sig))
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys.reshape(-1).view(np.int64)), "t": tables, "id": pa.array(ids)})

    return classes.select("id", "sig").mapInArrow(tensor, "key long, t int, id long")


def _shared(keys: DataFrame) -> DataFrame:
    """``key, t, id, first``: members of the buckets that hold at least two."""
    buckets = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first")).where(F.col("n") > 1)
    return keys.join(buckets.drop("n"), "key")


def _likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs ``a, b`` whose sizes allow a link and whose minimums agree often enough."""
    left = classes.select(F.col("id").alias("a"), F.col("sig").alias("sig_a"), F.col("n_shingles").alias("n_a"))
    right = classes.select(F.col("id").alias("b"), F.col("sig").alias("sig_b"), F.col("n_shingles").alias("n_b"))
    both = pairs.join(left, "a").join(right, "b").where(_may_link("n_a", "n_b"))

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = (_signature_rows(batch.column("sig_a")) == _signature_rows(batch.column("sig_b"))).sum(1) >= MIN_AGREE
            yield pa.RecordBatch.from_pydict({c: batch.column(c).filter(pa.array(same)) for c in ("a", "b")})

    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(agree, "a long, b long")


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """``id, items``: the sets of the named documents, from their texts."""
    wanted = docs.select("doc_id", "text").join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHash()
        for whole in batches:
            for batch in _chunks(whole):
                items = [shingle_set(t, width, known).tobytes() for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_pydict({"id": batch.column("doc_id").cast(pa.int64()), "items": pa.array(items, pa.binary())})

    return wanted.mapInArrow(build, "id long, items binary")


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("items").alias("items_a"))
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("items_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "items_a", "items_b")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("items_a").to_pylist(), batch.column("items_b").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                joint = np.sort(np.concatenate([x, y]), kind="stable")
                common = int((joint[1:] == joint[:-1]).sum())
                good.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_pydict({c: batch.column(c).filter(pa.array(good, pa.bool_())) for c in ("a", "b")})

    return both.mapInArrow(confirm, "a long, b long")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``id, component``: the smallest id reachable over the links ``a, b``, for ids that
    have one. Each round hangs neighbours on the smallest one around them, first the
    larger ones, then the smaller ones, until nothing moves."""
    edges, before = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), None
    for _ in range(rounds):
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        larger = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = larger.groupBy("a").agg(F.min("b").alias("low"))
        smaller = larger.join(low, "a")
        hung = smaller.select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", F.col("low").alias("b")))
        edges = saved(hung.where("a <> b").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))


def _with_component(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Adds ``component``, the id itself where it has no link."""
    return rows.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _open(rows: DataFrame) -> DataFrame:
    """Members of buckets that still hold several components, with the bucket's ``main``
    component, the largest one there, its ``n`` members and how many ``others`` are not of
    that component."""
    counts = rows.groupBy("key", "component").agg(F.count("*").alias("c"))
    spans = counts.groupBy("key").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.sum("c").alias("n"), (F.sum("c") - F.max("c")).alias("others"))
    return rows.join(spans.where("others > 0"), "key")


def _may_link(a: str, b: str) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def _firsts_left(firsts: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs of a member and a bucket's first one that are in different components."""
    label = found.select(F.col("id").alias("b"), F.col("component").alias("other"))
    rows = firsts.select("a", "b").join(found.withColumnRenamed("id", "a"), "a", "left").join(label, "b", "left")
    return rows.where(F.coalesce("component", "a") != F.coalesce("other", "b")).select("a", "b")


def _sketch(items: np.ndarray) -> bytes:
    """Which of ``BITS`` bits an odd number of the set's hashes falls on. The sketches of two
    sets differ in at most as many bits as there are hashes in only one of the sets."""
    return np.packbits(np.bincount((items % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1).tobytes()


def _sketches(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """``id, size, bits``: size and sketch of the sets of the named documents."""
    wanted = docs.select("doc_id", "text").join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHash()
        for whole in batches:
            for batch in _chunks(whole):
                sets = [shingle_set(t, width, known) for t in batch.column("text").to_pylist()]
                bits = pa.array([_sketch(s) for s in sets], pa.binary())
                yield pa.RecordBatch.from_pydict({"id": batch.column("doc_id").cast(pa.int64()), "size": pa.array(map(len, sets), pa.int64()), "bits": bits})

    return wanted.mapInArrow(build, "id long, size long, bits binary")


_DEALT = ("key", "block", "slice")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The rows of one key, block and slice after the other, from rows sorted by them."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        if not held.num_rows:
            continue
        places = np.stack([held.column(c).to_numpy() for c in _DEALT])
        starts = np.flatnonzero((places[:, 1:] != places[:, :-1]).any(0)) + 1
        if len(starts):
            yield from _cut(held.slice(0, starts[-1]), starts[:-1])
            held = held.slice(starts[-1])
    if held is not None and held.num_rows:
        yield from _cut(held, np.zeros(0, np.int64))


def _cut(rows: pa.Table, starts: np.ndarray) -> Iterator[dict[str, np.ndarray]]:
    values = {c: rows.column(c).to_numpy() for c in ("t", "id", "component", "main", "size", "asks")}
    values["sig"] = _signature_rows(rows.column("sig"))
    values["bits"] = np.frombuffer(b"".join(rows.column("bits").to_pylist()), np.uint64).reshape(-1, BITS // 64)
    for begin, end in zip([0, *starts], [*starts, rows.num_rows]):
        yield {c: v[begin:end] for c, v in values.items()}


def _may_be_linked(rows: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the pairs ``x, y`` of rows of a bucket are this bucket's to compare and,
    by sizes and sketches, similar enough."""
    once = (rows["component"][y] == rows["main"][y]) | (rows["id"][x] < rows["id"][y])
    small, large = np.minimum(rows["size"][x], rows["size"][y]), np.maximum(rows["size"][x], rows["size"][y])
    good = once & (100 * small >= PERCENT * large)
    # of the tables that the two share the first one compares them
    same = rows["sig"][x] == rows["sig"][y]
    pairs = same[:, SINGLES:].reshape(len(x), PAIRS, 2).all(2)
    good &= same[:, :SINGLES].argmax(1) * PAIRS + pairs.argmax(1) == rows["t"][x]
    differ = np.bitwise_count(rows["bits"][x] ^ rows["bits"][y]).sum(1, dtype=np.int64)
    return good & ((100 + PERCENT) * differ <= (100 - PERCENT) * (small + large))


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs ``a > b`` of an asking row and another one of its group that may be linked."""
    some = 1 << 16
    for rows in _groups(batches):
        asks, others, sig = np.flatnonzero(rows["asks"]), np.flatnonzero(~rows["asks"]), rows["sig"]
        for at in range(0, len(asks), BLOCK):
            for to in range(0, len(others), BLOCK):
                x, y = asks[at : at + BLOCK], others[to : to + BLOCK]
                agree = np.zeros((len(x), len(y)), np.uint8)
                for k in range(N_HASHES):
                    agree += sig[x, k][:, None] == sig[y, k]
                apart = rows["component"][x][:, None] != rows["component"][y]
                i, j = np.nonzero((agree >= MIN_AGREE) & apart)
                for begin in range(0, len(i), some):
                    left, right = x[i[begin : begin + some]], y[j[begin : begin + some]]
                    good = _may_be_linked(rows, left, right)
                    a, b = rows["id"][left[good]], rows["id"][right[good]]
                    yield pa.RecordBatch.from_pydict({"a": np.maximum(a, b), "b": np.minimum(a, b)})


def _members_left(members: DataFrame, found: DataFrame, classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """Pairs of different components that share a bucket and may be linked.

    Each member outside the main component of its bucket is compared with all its
    members. The former are dealt into blocks and the latter into slices by their number,
    and every block meets every slice, so that a group of rows is small however large its
    bucket. Sketches rule out what is clearly below the threshold, and nothing else.
    """
    open_ = saved(_open(_with_component(members.select("key", "t", "id"), found)), "open")
    sketches = saved(_sketches(docs, open_.select("id").distinct().hint("merge"), width), "sketches")
    rows = open_.join(classes.select("id", "sig"), "id").join(sketches, "id")
    blocks, slices = F.ceil(F.col("others") / BLOCK), F.ceil(F.col("n") / SLICE)
    columns = ["key", "t", "id", "component", "main", "size", "sig", "bits"]

    def every(number: Column) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), number - 1))

    asking = rows.where("component <> main").select(
        *columns, F.lit(True).alias("asks"), F.pmod(F.xxhash64("id"), blocks).alias("block"), every(slices).alias("slice")
    )
    asked = rows.select(
        *columns, F.lit(False).alias("asks"), every(blocks).alias("block"), F.pmod(F.xxhash64("id"), slices).alias("slice")
    )
    dealt = asking.union(asked).repartition(*_DEALT).sortWithinPartitions(*_DEALT)
    return dealt.mapInArrow(_compared, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every document.

    A document's set is that of its runs of ``width`` words. Documents are linked when
    100 * intersection size >= ``percent`` * union size, confirmed on whole sets;
    ``component_id`` is the smallest doc_id reachable over links, and the document that
    has it is ``kept``.

    Equal sets first become one class, so that copies never form pairs. In the tables of
    combined keys, each class is compared first with the first member it shares most
    tables with, then with the first members of its other buckets; buckets that then still
    hold several components are compared in full, block by block.

    Texts without words, NULL ones too, have no shingles, are linked with nothing and
    kept. A document whose doc_id is NULL is linked with nothing: component NULL, kept.
    Rows that share a doc_id are one document with several texts and get one component.
    An empty table gives an empty result; extra columns are left out.
    """
    if percent < PERCENT:
        raise ValueError(f"the tables are built for similarities from {PERCENT} percent on")
    signed = saved(signatures(docs, width), "signatures")
    there = signed.where("doc_id IS NOT NULL AND h1 IS NOT NULL")
    by_set = there.groupBy("h1", "h2").agg(
        F.min("doc_id").alias("id"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles")
    )
    classes = saved(by_set, "classes")
    members = saved(_shared(table_keys(classes)), "members")

    # candidates in three steps, each only between what is not yet one component
    firsts = members.where("id <> first").groupBy("id", "first").agg(F.count("*").alias("n"))
    firsts = saved(firsts.select(F.col("id").alias("a"), F.col("first").alias("b"), "n"), "firsts")
    best = firsts.groupBy("a").agg(F.max_by("b", F.struct("n", -F.col("b"))).alias("b"))
    tried = saved(_likely(best, classes), "pairs")
    ids = tried.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = saved(_sets(docs, ids.hint("merge"), width), "sets")
    links = saved(_links(tried, sets, percent), "links")
    found = saved(components(links), "components")
    for step in range(2):
        if step == 0:
            pairs = _likely(_firsts_left(firsts, found).join(tried, ["a", "b"], "left_anti"), classes)
        else:
            pairs = _members_left(members, found, classes, docs, width).join(tried, ["a", "b"], "left_anti")
        pairs = saved(pairs, "pairs")
        if pairs.isEmpty():
            continue
        new = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(sets.select("id"), "id", "left_anti")
        sets = sets.union(saved(_sets(docs, saved(new, "ids"), width), "sets"))
        links = links.union(saved(_links(pairs, sets, percent), "links"))
        tried = tried.union(pairs)
        found = saved(components(links), "components")

    # rows of one doc_id in several classes are one document
    ids = there.select("doc_id", "h1", "h2").join(classes.select("h1", "h2", "id"), ["h1", "h2"]).select("doc_id", "id")
    reached = _with_component(ids, found).groupBy("doc_id").agg(F.min("component").alias("component"))
    rows = signed.select("doc_id", "n_shingles").join(reached, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return rows.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """The documents without those that are not kept; all columns stay."""
    gone = near_duplicates(docs, width, percent).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
