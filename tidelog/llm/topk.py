"""Exact top-k search by inner product, pruned by segment statistics from coarse to fine."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from tidelog.llm.common import saved

# Vectors per block, and segments per vector at each resolution.
BLOCK = 1024
RESOLUTIONS = (1, 4, 16)

# Query blocks whose best scores a task holds at once.
_HELD = 16
_SEED = 128
_PAIRS = 1 << 16
_SALTS = 64

_BLOCK_SCHEMA = "dim int, ids binary, data binary"
_LONG = np.iinfo(np.int64)


# --- blocks ---------------------------------------------------------------------------

def _whole_vectors(batch: pa.RecordBatch, scale: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """By dimension: ids and vectors floor(scale * x) of the rows that take part."""
    batch = batch.filter(pc.and_(batch.column("id").is_valid(), batch.column("vector").is_valid()))
    ids = batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
    vectors = batch.column("vector")
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    values = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes[sizes > 0]):
        mine = np.flatnonzero(sizes == dim)
        rows = values[starts[mine, None] + np.arange(dim)]
        good = np.isfinite(rows).all(1)
        yield int(dim), ids[mine[good]], np.floor(scale * rows[good])


def vector_blocks(vectors: DataFrame, scale: float, rows: int = BLOCK) -> DataFrame:
    """Blocks of at most ``rows`` vectors of one dimension, from ``id, vector``."""

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out(dim: int, ids: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {"dim": pa.array([dim], pa.int32()), "ids": pa.array([ids.tobytes()]), "data": pa.array([data.tobytes()])}
            )

        for batch in batches:
            for dim, ids, data in _whole_vectors(batch, scale):
                if dim in held:
                    ids, data = np.concatenate([held[dim][0], ids]), np.concatenate([held[dim][1], data])
                full = len(ids) // rows * rows
                for at in range(0, full, rows):
                    yield out(dim, ids[at : at + rows], data[at : at + rows])
                held[dim] = [ids[full:].copy(), data[full:].copy()]
        for dim, (ids, data) in held.items():
            if len(ids):
                yield out(dim, ids, data)

    return vectors.mapInArrow(block, _BLOCK_SCHEMA)


# --- search within blocks -----------------------------------------------------------------

class _Vectors:
    """Vectors of a block with their statistics at each resolution. For every segment of
    n components: sqrt(n) times mean and deviation. The product of two such rows is the
    largest inner product that vectors with these statistics can have, which is the
    smallest distance they can have."""

    def __init__(self, ids: bytes, data: bytes, dim: int):
        self.ids = np.frombuffer(ids, np.int64)
        self.data = np.frombuffer(data, np.float64).reshape(-1, dim)
        self.most = float(np.abs(self.data).max(initial=0.0))
        self.levels = []
        for n in RESOLUTIONS:
            if n > dim:
                break
            edges = np.linspace(0, dim, n + 1).astype(np.int64)
            sizes = np.diff(edges)
            means = np.add.reduceat(self.data, edges[:-1], axis=1) / sizes
            spread = self.data - np.repeat(means, sizes, axis=1)
            deviations = np.sqrt(np.add.reduceat(spread * spread, edges[:-1], axis=1) / sizes)
            self.levels.append(np.hstack([means, deviations]) * np.sqrt(np.hstack([sizes, sizes])))


def _products(a: np.ndarray, b: np.ndarray, whole: bool) -> np.ndarray:
    """Inner products row by row: exact in floating point while all sums stay whole,
    else in unbounded integers, cut to 64 bits."""
    if whole:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    sums = [sum(int(x) * int(y) for x, y in zip(u, v)) for u, v in zip(a.tolist(), b.tolist())]
    return np.array([min(max(s, _LONG.min), _LONG.max) for s in sums], np.int64)


def _mostly(open_: np.ndarray) -> bool:
    """Whether so many pairs are open that one product of all is cheaper."""
    return np.count_nonzero(open_) * 16 > open_.size


def _some(open_: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The open pairs, a bounded number at a time."""
    query, row = np.nonzero(open_)
    for at in range(0, len(query), _PAIRS):
        yield query[at : at + _PAIRS], row[at : at + _PAIRS]


class _Best:
    """The best ``k`` candidates so far of every query of a block."""

    def __init__(self, queries: _Vectors, k: int):
        self.queries, self.k = queries, k
        self.query = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int64)
        self.scores = np.zeros(0, np.int64)

    def floor(self) -> np.ndarray:
        """The k-th best score of each query, below everything while there are fewer."""
        counts = np.bincount(self.query, minlength=len(self.queries.ids))
        low = np.full(len(counts), -np.inf)
        ends = np.cumsum(counts) - 1
        low[counts >= self.k] = self.scores[ends[counts >= self.k]]
        return low

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        query, ids, scores = (np.concatenate(x) for x in ((self.query, query), (self.ids, ids), (self.scores, scores)))
        order = np.lexsort((ids, -scores.astype(object) if scores.min(initial=0) == _LONG.min else -scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        first = np.searchsorted(query, query, "left")
        keep = np.arange(len(query)) - first < self.k
        self.query, self.ids, self.scores = query[keep], ids[keep], scores[keep]

    def look(self, found: _Vectors) -> None:
        """Seeds the bounds with a few candidates, then prunes the rest."""
        self._search(found, 0, min(_SEED, len(found.ids)))
        if len(found.ids) > _SEED:
            self._search(found, _SEED, len(found.ids))

    def _search(self, found: _Vectors, begin: int, end: int) -> None:
        low = self.floor()
        size = self.queries.most * found.most * found.data.shape[1]
        slack = 1e-9 * size + 1e-6  # rounding of the bounds
        open_ = np.ones((len(low), end - begin), bool)
        for mine, theirs in zip(self.queries.levels, found.levels):
            bound = (low - slack)[:, None]
            if _mostly(open_):
                open_ &= mine @ theirs[begin:end].T >= bound
            else:
                for query, row in _some(open_):
                    left = np.einsum("ij,ij->i", mine[query], theirs[row + begin]) >= bound[query, 0]
                    open_[query, row] = left
        # sums that stay whole are exact in floating point
        whole = size < 2.0**52
        dense = self.queries.data @ found.data[begin:end].T if whole and _mostly(open_) else None
        for query, row in _some(open_):
            other = self.queries.ids[query] != found.ids[row + begin]
            query, row = query[other], row[other]
            scores = dense[query, row].astype(np.int64) if dense is not None else _products(self.queries.data[query], found.data[row + begin], whole)
            near = scores >= low[query]
            self.add(query[near], found.ids[row[near] + begin], scores[near])

    def result(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"query_id": self.queries.ids[self.query], "vec_id": self.ids, "score": self.scores})


def _search_blocks(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[int, _Best] = OrderedDict()
        for batch in batches:
            names = ("number", "dim", "q_ids", "q_data", "ids", "data")
            for number, dim, q_ids, q_data, ids, data in zip(*(batch.column(n) for n in names)):
                key = number.as_py()
                if key not in held:
                    if len(held) >= _HELD:
                        yield held.popitem(last=False)[1].result()
                    held[key] = _Best(_Vectors(q_ids.as_py(), q_data.as_py(), dim.as_py()), k)
                held.move_to_end(key)
                held[key].look(_Vectors(ids.as_py(), data.as_py(), dim.as_py()))
        for best in held.values():
            yield best.result()

    return search


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest integer inner products of each
    query with all vectors but its own, ties to the smaller id. Both tables have columns
    ``id, vector``.

    Components become floor(``scale`` * x). Blocks of queries meet blocks of vectors; in
    a block, means and deviations of ever finer segments bound the inner product (and so
    the distance) from above (below), and exact products are computed only for pairs that
    no bound rules out. A task keeps k candidates per query; those of all tasks are
    ranked again.

    A vector that is NULL or empty or has a NULL or non-finite component, and one without
    id, takes no part; vectors meet only those of their own dimension. Of several vectors
    of one query id the smallest asks; vectors that repeat as candidates each count, but
    never those with the query's own id. Scores beyond 64 bits are cut to them. Fewer
    candidates than ``k`` give fewer rows, no queries none; extra columns are left out.
    """
    unusable = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    asking = queries.select("id", "vector").where(~unusable).groupBy("id").agg(F.min("vector").alias("vector"))
    q = saved(
        vector_blocks(asking, scale).select(
            F.monotonically_increasing_id().alias("number"), "dim", F.col("ids").alias("q_ids"), F.col("data").alias("q_data")
        ),
        "query-blocks",
    )
    c = saved(vector_blocks(vectors.select("id", "vector"), scale).withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(_SALTS))), "vector-blocks")
    # every vector block goes once to each query block; salts spread the vector blocks of
    # one query block over several tasks
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))).alias("salt")
    pairs = c.join(q.select("*", salts).hint("merge"), ["dim", "salt"])
    found = pairs.select("number", "dim", "q_ids", "q_data", "ids", "data").mapInArrow(
        _search_blocks(k), "query_id long, vec_id long, score long"
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
