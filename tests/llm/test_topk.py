"""Exact top-k search against plain Python."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm.topk import RESOLUTIONS, _Vectors, top_k

SCHEMA = "id long, vector array<float>"


def plain_top(vectors, queries, k=5):
    def whole(v):
        if v is None or not v or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(256 * float(x)) for x in v]

    rows = [(i, whole(v)) for i, v in vectors if i is not None]
    found = set()
    for q, v in queries:
        own = whole(v)
        if q is None or own is None:
            continue
        score = lambda w: max(min(sum(a * b for a, b in zip(own, w)), 2**63 - 1), -(2**63))
        near = [(-score(w), i) for i, w in rows if w is not None and i != q and len(w) == len(own)]
        found |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(near)[:k])}
    return found


def run(spark, vectors, queries, **options):
    df = spark.createDataFrame(vectors, SCHEMA).repartition(3)
    return {tuple(r) for r in top_k(df, spark.createDataFrame(queries, SCHEMA), **options).collect()}


def float32(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


@pytest.mark.parametrize("shape", ["random", "clustered", "ties"])
def test_search_matches_plain_python(spark, shape):
    rng = np.random.RandomState(3)
    if shape == "random":
        data = rng.randn(2600, 24) / 5
    elif shape == "clustered":  # the bounds rule out most pairs
        data = np.repeat(rng.randn(26, 24), 100, axis=0) + rng.randn(2600, 24) / 50
    else:
        data = rng.randint(-1, 2, (2600, 3)).astype(float)
    rows = float32([(i, v.tolist()) for i, v in enumerate(data)])
    queries = [r for r in rows if r[0] % 50 == 0]
    assert run(spark, rows, queries) == plain_top(rows, queries)


def test_hard_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = float32([
        (0, [0.5, -0.25]), (1, [0.5, 0.5]), (2, None), (3, []), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]),
        (7, [1.0, 2.0, 3.0]), (8, [0.001, -0.001]), (None, [9.0, 9.0]), (1, [0.5, 0.5]), (9, [1e20, -1e20]), (10, [3e30, 1.0]),
    ])
    queries = [r for r in rows if r[0] in (0, 2, 4, 6, 7, 9, 10)]
    assert run(spark, rows, queries) == plain_top(rows, queries)


def test_few_candidates_and_no_rows(spark):
    rows = float32([(0, [1.0, 0.0]), (50, [0.0, 1.0])])
    assert run(spark, rows, rows) == {(0, 1, 50, 0), (50, 1, 0, 0)}
    assert run(spark, rows, []) == set() and run(spark, [], rows) == set()


def test_repeated_queries_and_extra_columns(spark):
    rows = float32([(i, [i / 7, 1.0]) for i in range(20)])
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS dim", "2 AS salt", "'x' AS data")
    twice = df.where("id = 0").union(df.where("id = 0"))
    assert {tuple(r) for r in top_k(df, twice).collect()} == plain_top(rows, rows[:1])
    assert top_k(df, twice).count() == 5


def test_statistics_bound_products():
    rng = random.Random(1)
    ids = np.arange(40).tobytes()
    a, b = (np.floor(256 * np.array([[rng.gauss(0, 1) for _ in range(37)] for _ in range(40)])) for _ in range(2))
    left, right = _Vectors(ids, a.tobytes(), 37), _Vectors(ids, b.tobytes(), 37)
    assert len(left.levels) == len(RESOLUTIONS)
    bounds = [m @ t.T for m, t in zip(left.levels, right.levels)]
    exact = a @ b.T
    for bound in bounds:
        assert (bound >= exact - 1e-6).all()
    assert bounds[0].sum() > bounds[1].sum() > bounds[2].sum()
