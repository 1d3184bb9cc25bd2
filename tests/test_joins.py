"""Joins by time against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from plan_text import plan_of
from tidelog import asof_join, range_counts, range_join

BEGIN = dt.datetime(2024, 1, 1)


def at(seconds):
    return None if seconds is None else BEGIN + dt.timedelta(seconds=seconds)


@pytest.fixture
def sides(spark):
    """A key with most rows, ties, NULL keys and times, keys on one side only."""
    rng = random.Random(5)

    def rows(n, odd):
        return [
            (k, rng.choice(["hot"] * 6 + ["a", "b", None, odd]), rng.choice([None] + [rng.randint(0, 40_000)] * 9)) for k in range(n)
        ]

    left, right = rows(300, "left only"), rows(200, "right only") + [(900, "a", 7), (901, "a", 7), (902, "hot", -9_000_000)]
    frame = lambda data: spark.createDataFrame(
        [(k, key, at(s)) for k, key, s in data], "id long, key string, Timestamp timestamp").repartition(3)
    return left, right, frame(left), frame(right)


def plain_asof(left, right, tolerance=None):
    found = []
    for k, key, s in left:
        earlier = [(t, i) for i, other, t in right if key is not None and other == key and None not in (s, t) and t <= s]
        best = max(earlier, default=None)
        found.append((k, best[1] if best and (tolerance is None or s - best[0] <= tolerance) else None))
    return sorted(found)


@pytest.mark.parametrize("bucket", [60, 3600, 10**7])
def test_asof_join(sides, bucket):
    left, right, l, r = sides
    found = asof_join(l, r, ["key"], columns=["id"], tie_break=["id"], bucket_micros=bucket * 10**6)
    assert found.columns == ["id", "key", "Timestamp", "last_id"]
    assert sorted((x["id"], x["last_id"]) for x in found.collect()) == plain_asof(left, right)


def test_asof_join_within_a_tolerance(sides):
    left, right, l, r = sides
    found = asof_join(l, r, ["key"], columns=["id"], tie_break=["id"], tolerance_micros=600 * 10**6)
    assert sorted((x["id"], x["last_id"]) for x in found.collect()) == plain_asof(left, right, 600)
    inner = asof_join(l, r, ["key"], columns=["id"], tie_break=["id"], tolerance_micros=600 * 10**6, inner=True)
    assert sorted((x["id"], x["last_id"]) for x in inner.collect()) == [p for p in plain_asof(left, right, 600) if p[1] is not None]


def test_asof_join_of_empty_sides_and_all_columns(sides):
    left, right, l, r = sides
    assert asof_join(l, r.limit(0), ["key"]).where("last_id is null and last_key is null").count() == len(left)
    assert asof_join(l.limit(0), r, ["key"]).columns == ["id", "key", "Timestamp", "last_id", "last_key", "last_Timestamp"]


def test_a_hot_key_is_cut_by_time(sides):
    *_, l, r = sides
    plan = plan_of(asof_join(l, r, ["key"], columns=["id"]))
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan
    assert "hashpartitioning(_k0" in plan and "_bucket" in plan


def intervals(spark, rng):
    """Short, long, empty, reversed ones and such with NULLs."""
    rows = []
    for k in range(120):
        s = rng.choice([None] + [rng.randint(-50_000, 40_000)] * 9)
        size = rng.choice([0, 1, 59, 60, 61, 3600, 50_000, 10**6, -5, None])
        rows.append((k, rng.choice(["hot", "hot", "a", None]), s, None if None in (s, size) else s + size))
    return rows, spark.createDataFrame([(k, key, at(s), at(e)) for k, key, s, e in rows], "iv long, key string, s timestamp, e timestamp")


@pytest.mark.parametrize("on", [(), ("key",)])
def test_range_join(spark, sides, on):
    left, _, l, _ = sides
    rows, right = intervals(spark, random.Random(6))
    points = l if on else l.drop("key")
    found = range_join(points, right if on else right.drop("key"), "Timestamp", "s", "e", on, 60 * 10**6)
    expected = sorted(
        (k, iv) for k, key, t in left for iv, other, s, e in rows
        if None not in (t, s, e) and s <= t <= e and (not on or (key is not None and key == other)))
    assert sorted((x["id"], x["iv"]) for x in found.collect()) == expected and len(expected) > 500
    plan = plan_of(found)
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan


def test_range_join_of_empty_sides_and_clashing_names(spark, sides):
    *_, l, r = sides
    _, right = intervals(spark, random.Random(6))
    assert range_join(l, right.limit(0), "Timestamp", "s", "e", ["key"]).count() == 0
    assert range_join(l.limit(0), right, "Timestamp", "s", "e", ["key"]).count() == 0
    with pytest.raises(ValueError):
        range_join(l, right, "Timestamp", "s", "e")
    assert "id" in range_join(l, right.withColumn("x", F.lit(1)), "Timestamp", "s", "e", ["key"]).columns


@pytest.mark.parametrize("together", [10**6, 40])
def test_range_counts(spark, sides, together):
    left, _, l, _ = sides
    rows, _ = intervals(spark, random.Random(7))
    # equal intervals under one id, different ones under another, an id that is NULL
    rows += [(5, "a", s, e) for k, _, s, e in rows if k == 5] + [(6, "a", -20_000, 900), (6, "a", 500, 30_000), (None, "a", 0, 3600)]
    right = spark.createDataFrame([(k, at(s), at(e)) for k, _, s, e in rows], "iv long, s timestamp, e timestamp")
    found = range_counts(l, right, "Timestamp", "s", "e", "iv", "key", 60 * 10**6, together)
    expected = {}
    for k, _, s, e in rows:
        for i, key, t in left:
            if None not in (t, s, e) and s <= t <= e:
                expected.setdefault(k, []).append(key)
    expected = {k: (len(keys), len(set(keys) - {None})) for k, keys in expected.items()}
    got = [(x["iv"], (x["n_pairs"], x["n_values"])) for x in found.collect()]
    assert dict(got) == expected and len(got) == len(expected) > 25
    assert range_counts(l.limit(0), right, "Timestamp", "s", "e", "iv", "key").count() == 0
    assert range_counts(l, right.limit(0), "Timestamp", "s", "e", "iv", "key").count() == 0


def test_range_counts_make_no_pairs(spark):
    """20,000 intervals that hold 20,000 points each."""
    points = spark.range(20_000).selectExpr("timestamp_micros(id) Timestamp", "id % 777 key")
    right = spark.range(20_000).selectExpr("id iv", "timestamp_micros(-id) s", "timestamp_micros(20000 + id) e")
    found = range_counts(points, right, "Timestamp", "s", "e", "iv", "key")
    assert found.agg(F.count("*"), F.min("n_pairs"), F.max("n_pairs"), F.min("n_values"), F.max("n_values")).first() == (20_000, 20_000, 20_000, 777, 777)
    plan = plan_of(found)
    assert "FlatMapCoGroupsInArrow" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
