"""Whitening of embeddings by spectral divide-and-conquer on polar decompositions.

The covariance, gathered by Spark, is shifted and its polar factor computed by the
QR-based dynamically weighted Halley iteration. The factor of a symmetric matrix is its
sign, so that half of its sum with the identity projects on the eigenvectors above the
shift. Their space and its complement are split again until the components are single.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Parameters: offset and steps of the exact integer form of a component.
STEPS, OFFSET = 1024, 100_000
COMPONENTS = 8

# Entries from this size on are taken for faults, as their steps leave no room for sums.
LARGEST = 2.0**30

# The covariance of so many dimensions at most goes to the driver, and as many numbers
# times the components to every task.
MAX_DIMENSIONS = 4096

_EPS = float(np.finfo(np.float64).eps)
_LONG = 2**63


# --- spectral divide-and-conquer, on the covariance ------------------------------------

def polar_sign(matrix: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix without zero eigenvalues, which is
    its sign, by QDWH: each step is one QR decomposition of the matrix over the identity,
    its weights follow the lower bound of the singular values."""
    size = len(matrix)
    scale = float(np.linalg.norm(matrix, 2))
    x = matrix / scale
    low = max(float(1 / np.linalg.norm(np.linalg.inv(x), 2)), _EPS) * 0.9
    for _ in range(30):
        root = np.cbrt(4 * (1 - low**2) / low**4) if low < 1 else 0.0
        a = np.sqrt(1 + root) + 0.5 * np.sqrt(8 - 4 * root + 8 * (2 - low**2) / (low**2 * np.sqrt(1 + root)))
        b = (a - 1) ** 2 / 4
        c = a + b - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, np.eye(size)]))
        new = (b / c) * x + (a - b / c) / np.sqrt(c) * (q[:size] @ q[size:].T)
        new = (new + new.T) / 2
        low = min(low * (a + b * low**2) / (1 + c * low**2), 1.0)
        change = float(np.linalg.norm(new - x))
        x = new
        if change < 4 * _EPS ** (1 / 3) and 1 - low < 8 * _EPS:
            break
    return x


def _basis(projector: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of what a projector keeps and of the rest. Two rounds of
    subspace iteration on the projector's strongest columns are enough, as its
    eigenvalues are zero and one."""
    strongest = np.argsort(-np.einsum("ij,ij->j", projector, projector), kind="stable")
    q, _ = np.linalg.qr(projector[:, strongest], mode="complete")
    for _ in range(2):
        q, _ = np.linalg.qr(np.hstack([projector @ q[:, :rank], q[:, rank:] - projector @ q[:, rank:]]), mode="complete")
    return q[:, :rank], q[:, rank:]


def _split(matrix: np.ndarray, level: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of two invariant subspaces of a symmetric matrix, that of the larger
    eigenvalues first; None when all eigenvalues are one within rounding."""
    size = len(matrix)
    diagonal = np.diag(matrix)
    middle = float(np.trace(matrix)) / size
    rest = matrix - middle * np.eye(size)
    spread = float(np.linalg.norm(rest))
    if spread <= 4 * _EPS * size * level:
        return None
    # the median is the shift that halves best; near a mean there are always eigenvalues
    # on both sides, and the steps away from it avoid a shift that hits one
    for shift in (float(np.median(diagonal)), middle, *(middle + spread / size * t for t in (0.01, -0.01, 0.1, -0.1, 0.3, -0.3))):
        moved = matrix - shift * np.eye(size)
        try:
            projector = (np.eye(size) + polar_sign(moved)) / 2
        except np.linalg.LinAlgError:
            continue
        rank = int(round(float(np.trace(projector))))
        if 0 < rank < size:
            upper, lower = _basis(projector, rank)
            if np.linalg.norm(lower.T @ matrix @ upper) <= 64 * _EPS * size * level:
                return upper, lower
    return None


def top_components(covariance: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns. Only the
    parts that hold one of the largest are split on. Eigenvalues that are equal within
    rounding have any orthonormal basis of their space."""
    size = len(covariance)
    level = float(np.linalg.norm(covariance, 2)) if size else 0.0
    values: list[float] = []
    vectors: list[np.ndarray] = []
    parts = [(covariance, np.eye(size))]  # larger eigenvalues last
    while parts and len(values) < count:
        block, basis = parts.pop()
        if not len(block):
            continue
        found = _split(block, level) if len(block) > 1 else None
        if found is None:
            for k in np.argsort(-np.diag(block), kind="stable"):
                values.append(float(block[k, k]))
                vectors.append(basis[:, k])
            continue
        for part in reversed(found):
            own = basis @ part
            inner = own.T @ covariance @ own
            parts.append(((inner + inner.T) / 2, own))
    return np.array(values[:count]), np.array(vectors[:count]).reshape(len(vectors[:count]), size).T


# --- Spark --------------------------------------------------------------------------------

def _lengths_and_faults(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per vector its first place and its length among all components, and whether it is
    usable; and the components."""
    valid = np.array(column.is_valid())
    lengths = np.where(valid, column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
    values = column.flatten().cast(pa.float64())
    numbers = values.fill_null(float("nan")).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    faults = np.concatenate([[0], np.cumsum(~(np.abs(numbers) < LARGEST))])
    return ends - lengths, lengths, valid & (faults[ends] == faults[ends - lengths]), numbers


def _exact(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a batch take part, and their vectors in whole steps."""
    starts, lengths, usable, numbers = _lengths_and_faults(batch.column("vector"))
    rows = np.flatnonzero(usable & (lengths == width))
    taken = numbers[starts[rows][:, None] + np.arange(width)]
    return rows, np.floor(taken * STEPS).astype(np.int64) + OFFSET


def _apart(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - sums``, exact: in 64 bits where that holds it, else in whole numbers of any size."""
    largest = int(np.abs(x).max(initial=0)) * n + max(map(abs, sums), default=0)
    kind = np.int64 if largest < _LONG else object
    return x.astype(kind) * n - np.array(sums, kind)


def _deviations(apart: np.ndarray) -> list[int | None]:
    """Exact sums of squares per row, NULL beyond 64 bits."""
    if apart.dtype != object and float(np.abs(apart).max(initial=0)) ** 2 * max(1, apart.shape[1]) < _LONG / 2:
        return (apart * apart).sum(axis=1).tolist()
    exact = [sum(int(v) ** 2 for v in row) for row in apart.tolist()]
    return [v if v < _LONG else None for v in exact]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (_apart(x, n, sums) / n).astype(np.float64)


def _width(vectors: DataFrame) -> int | None:
    """The length most usable vectors have; of equally frequent ones the shortest."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[int] = Counter()
        for batch in batches:
            _, lengths, usable, _ = _lengths_and_faults(batch.column("vector"))
            found.update(lengths[usable].tolist())
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int32()), pa.array(found.values(), pa.int64())], names=["w", "n"])

    lengths = vectors.select("vector").mapInArrow(count, "w int, n long").groupBy("w").agg(F.sum("n").alias("n"))
    most = lengths.orderBy(F.col("n").desc(), "w").first()
    return most["w"] if most else None


def _sums(vectors: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of vectors and their exact sums. Every task adds up its own first."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * (width + 1)
        for batch in batches:
            rows, x = _exact(batch, width)
            total = [a + b for a, b in zip(total, [*x.sum(axis=0).tolist(), len(rows)])]
        yield pa.RecordBatch.from_arrays([pa.array(range(width + 1), pa.int32()), pa.array(total, pa.int64())], names=["k", "v"])

    added = F.sum(F.col("v").cast("decimal(20,0)")).alias("v")
    cells = vectors.select("vector").mapInArrow(add, "k int, v long").groupBy("k").agg(added).collect()
    found = {r["k"]: int(r["v"]) for r in cells}
    return found.get(width, 0), [found.get(k, 0) for k in range(width)]


def _products(vectors: DataFrame, width: int, n: int, sums: list[int], onto: np.ndarray | None = None) -> np.ndarray:
    """Mean products of the centred vectors, or of their projections. Every task adds up
    its own; their sums are added per entry of the matrix, not on the driver."""
    size = width if onto is None else onto.shape[1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            centred = _centred(_exact(batch, width)[1], n, sums)
            centred = centred if onto is None else centred @ onto
            total += centred.T @ centred
        at = np.arange(size * size, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel())], names=["k", "v"])

    cells = vectors.select("vector").mapInArrow(add, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(size * size)
    for r in cells:
        flat[r["k"]] = r["v"]
    return flat.reshape(size, size) / max(n, 1)


OUT_SCHEMA = "vec_id long, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"


def whiten(df: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per usable vector: ``whitened``, its projections on the strongest
    components over the roots of their eigenvalues, ``explained``, the eigenvalues'
    shares of the whole, ``n``, ``deviation`` and ``identity_error``, the same for all.

    Rows whose vector is NULL or holds NULL or non-finite entries (or such of ``LARGEST``
    or more in size) go, and so do vectors of another length than most have (of two
    lengths equally frequent the shorter counts), as they have no covariance with the rest. A NULL key is kept; rows that repeat one count
    and are returned each; extra columns are left out. Components whose eigenvalue is zero
    within rounding cannot be whitened and are left out, so that a table of equal vectors
    gives empty lists. An empty table gives an empty result. A deviation beyond 64 bits is
    NULL.

    Only sums reach the driver: one number per dimension, and per pair of at most
    ``MAX_DIMENSIONS`` of them. The projection is sent to the tasks, the vectors stay
    where they are read; nothing but partial sums is shuffled.
    """
    vectors = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    width = _width(vectors) or 0
    if width > MAX_DIMENSIONS:
        raise ValueError(f"{width} dimensions are beyond {MAX_DIMENSIONS}")
    n, sums = _sums(vectors, width)
    covariance = _products(vectors, width, n, sums)
    values, basis = top_components((covariance + covariance.T) / 2, min(components, width))
    whole = float(np.trace(covariance))
    solid = values > 16 * _EPS * width * whole
    values, basis = values[solid], basis[:, solid]
    onto = basis / np.sqrt(values)
    error = 0.0
    if len(values):
        error = float(np.abs(_products(vectors, width, n, sums, onto) - np.eye(len(values))).max())
    shares = (values / whole).tolist() if len(values) else []

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = _exact(batch, width)
            apart = _apart(x, n, sums)
            shown = (apart / n).astype(np.float64) @ onto
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(rows)),
                    pa.array(np.full(len(rows), n, np.int64)),
                    pa.array(_deviations(apart), pa.int64()),
                    pa.array(list(shown), pa.list_(pa.float64())),
                    pa.array([shares] * len(rows), pa.list_(pa.float64())),
                    pa.array(np.full(len(rows), error)),
                ],
                names=["vec_id", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.mapInArrow(project, OUT_SCHEMA)


def by_component(whitened: DataFrame) -> DataFrame:
    """One row per vector and component, numbered from 1."""
    paired = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "pair")
    rows = whitened.select("vec_id", "n", "deviation", "identity_error", paired)
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation",
        F.col("pair.whitened").alias("whitened"), F.col("pair.explained").alias("explained"), "identity_error",
    )
