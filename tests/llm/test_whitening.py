"""Whitening against a plain eigenvalue decomposition."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import whitening
from tidelog.llm.queries import QUERIES
from tidelog.llm.whitening import by_component, polar_sign, top_components, whiten

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, width):
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in rows], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    apart = x * n - sums
    deviation = [int(sum(a * a for a in row)) for row in apart]
    centred = (apart / n).astype(float)
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1][:width], basis[:, ::-1][:, :width]
    return deviation, centred @ basis / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def matrices():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(500, 40))
    q, _ = np.linalg.qr(rng.normal(size=(20, 20)))
    yield a.T @ a / 500
    yield (a * np.logspace(0, -6, 40)).T @ (a * np.logspace(0, -6, 40)) / 500
    yield np.diag(np.arange(30.0))
    yield q @ np.diag([5.0] * 6 + [3.0] * 6 + [1.0] * 8) @ q.T
    yield np.eye(7)
    yield np.zeros((4, 4))
    yield np.ones((6, 6))
    yield np.array([[2.5]])


@pytest.mark.parametrize("matrix", list(matrices()))
def test_components_are_eigenvectors(matrix):
    matrix = (matrix + matrix.T) / 2
    values, basis = top_components(matrix, 8)
    expected = np.linalg.eigvalsh(matrix)[::-1][:8]
    scale = max(abs(expected).max(), 1e-300)
    assert np.abs(values - expected).max() / scale < 1e-13
    assert np.abs(matrix @ basis - basis * values).max() / scale < 1e-13
    assert np.abs(basis.T @ basis - np.eye(len(values))).max() < 1e-13


def test_polar_factor_is_the_sign():
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.normal(size=(30, 30)))
    values = np.concatenate([np.logspace(-8, 0, 15), -np.logspace(-7, 1, 15)])
    sign = polar_sign(q @ np.diag(values) @ q.T)
    assert np.abs(sign - q @ np.diag(np.sign(values)) @ q.T).max() < 1e-7
    assert np.abs(sign @ sign - np.eye(30)).max() < 1e-13


def test_query_against_numpy(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding").collect()]
    deviation, whitened, explained = plain(rows, 8)
    found = QUERIES["op13_qdwh_whitening"](spark, FOLDER)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    cells = {(r["vec_id"], r["component"]): r for r in found.collect()}
    assert len(cells) == 8 * len(rows)
    ours = np.array([[cells[i, k]["whitened"] for k in range(1, 9)] for i, _ in rows])
    assert np.abs(np.abs(ours) - np.abs(whitened)).max() < 1e-8
    signs = np.sign((ours * whitened).sum(axis=0))
    assert np.abs(ours - whitened * signs).max() < 1e-8
    assert [cells[i, 1]["deviation"] for i, _ in rows] == deviation
    some = cells[rows[0][0], 1]
    assert some["n"] == len(rows) and some["identity_error"] < 1e-9
    assert all(abs(cells[rows[0][0], k + 1]["explained"] / explained[k] - 1) < 1e-9 for k in range(8))


def hard_rows():
    rng = random.Random(4)
    good = [(k, [rng.gauss(0, 1), rng.gauss(0, 2), rng.gauss(1, 3)]) for k in range(60)]
    good += [good[3], good[3], (None, [0.5, -0.5, 2.0])]
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, float("nan"), 2.0]), (103, [float("inf"), 0.0, 0.0]),
           (104, [1.0, 2.0]), (105, []), (106, [float("-inf")] * 3), (107, [1e30, 0.0, 0.0])]
    return good, bad


def test_hard_rows(spark):
    good, bad = hard_rows()
    df = spark.createDataFrame(good + bad, SCHEMA).repartition(4).withColumn("n", F.lit("x")).withColumn("Vector", F.lit(1))
    rows = whiten(df).collect()
    assert sorted(str(r["vec_id"]) for r in rows) == sorted(str(i) for i, _ in good)
    deviation, whitened, _ = plain(good, 3)
    first = next(r for r in rows if r["vec_id"] == 5)
    assert first["deviation"] == deviation[5] and len(first["whitened"]) == 3
    assert np.abs(np.abs(first["whitened"]) - np.abs(whitened[5])).max() < 1e-9
    shown = [tuple(r["whitened"]) for r in rows if r["vec_id"] == 3]
    assert len(shown) == 3 and len(set(shown)) == 1
    assert by_component(whiten(df)).count() == 3 * len(good)


def test_empty_equal_and_flat_tables(spark):
    assert whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whiten(spark.createDataFrame([(1, None), (2, [None])], SCHEMA)).count() == 0
    assert [r["n"] for r in whiten(spark.createDataFrame([(1, []), (2, [])], SCHEMA)).collect()] == [2, 2]
    equal = whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 4, SCHEMA)).collect()
    assert [(r["deviation"], r["whitened"]) for r in equal] == [(0, [])] * 4
    line = whiten(spark.createDataFrame([(k, [float(k), 2.0 * k]) for k in range(5)], SCHEMA)).collect()
    assert [len(r["whitened"]) for r in line] == [1] * 5 and abs(line[0]["explained"][0] - 1) < 1e-12


def test_large_numbers_stay_exact(spark):
    rows = [(k, [float(2**29 - 2**6 * k), float(k)]) for k in range(6)]
    found = {r["vec_id"]: r["deviation"] for r in whiten(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [found[k] for k in range(6)] == plain(rows, 2)[0]
    apart = np.array([[2**40, 2**40]], object)
    assert whitening._deviations(apart) == [None]
