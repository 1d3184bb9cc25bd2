import gc
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from plan_text import plan_of
from tidelog import assign_batches, batch_sizes


def buffer_loop(arrivals, max_rows=100, first=15_000_000, step=5_000_000):
    """The buffer as a loop: {id: (tick, chunk)}."""
    found, tick, end, chunk, held = {}, 0, first, 0, 0
    for us, id_ in sorted(arrivals):
        while us >= end:
            tick, end, chunk, held = tick + 1, end + step, 0, 0
        found[id_] = (tick, chunk)
        held += 1
        if held == max_rows:
            chunk, held = chunk + 1, 0
    return found


def cases():
    rng = random.Random(7)
    spread = [(rng.randrange(60_000_000), i) for i in range(3000)]
    hot_tick = [(rng.randrange(20_000_000, 25_000_000), i) for i in range(2500)] + [(rng.randrange(90_000_000), 2500 + i) for i in range(300)]
    hot_instant = [(21_000_000, i) for i in range(1500)] + [(rng.randrange(40_000_000), 1500 + i) for i in range(1500)]
    edges = [(0, 0), (14_999_999, 1), (15_000_000, 2), (19_999_999, 3), (20_000_000, 4), (500_000_000, 5)]
    return {"spread": spread, "hot_tick": hot_tick, "hot_instant": hot_instant, "edges": edges}


@pytest.mark.parametrize("name", ["spread", "hot_tick", "hot_instant", "edges"])
def test_batches_equal_the_loop(spark, name):
    arrivals = cases()[name]
    expected = buffer_loop(arrivals)
    df = spark.createDataFrame(arrivals, "us long, id long").repartition(7)
    assigned = assign_batches(df, "us", ["id"], partitions=6).collect()
    assert {r.id: (r.tick, r.chunk) for r in assigned} == expected
    sizes = {}
    for batch in expected.values():
        sizes[batch] = sizes.get(batch, 0) + 1
    assert {(r.tick, r.chunk): r.n_rows for r in batch_sizes(df, "us").collect()} == sizes


def test_a_hot_instant_is_spread_over_tasks(spark):
    df = spark.createDataFrame(cases()["hot_instant"], "us long, id long")
    assigned = assign_batches(df, "us", ["id"], partitions=6)
    sizes = assigned.where("us = 21000000").groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= 1
    plan = plan_of(assigned)
    assert "RDDScan" in plan.replace(" ", "") or "ExistingRDD" in plan


def checkpointed(spark):
    """Data files in the checkpoint folder."""
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    return {os.path.join(top, name) for top, _, names in os.walk(folder) for name in names}


def test_numbered_rows_go_with_the_result(spark):
    """The checkpoint is Spark's own, which removes it when the result is gone."""
    before = checkpointed(spark)
    assigned = assign_batches(spark.range(500).selectExpr("id", "id * 1000 us"), "us", ["id"])
    assert assigned.count() == 500
    del assigned
    for _ in range(40):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        if checkpointed(spark) <= before:
            break
        time.sleep(0.25)
    assert checkpointed(spark) <= before


def test_rows_without_arrival_are_kept(spark):
    df = spark.createDataFrame([(None, 1), (5, 2)], "us long, id long")
    assert sorted(r.id for r in assign_batches(df, "us", ["id"]).collect()) == [1, 2]


def test_chunks_beyond_one_block(spark):
    df = spark.range(2500).selectExpr("id", "1L us")
    assert batch_sizes(df, "us", max_rows=1).count() == 2500
    assert batch_sizes(df.limit(0), "us").count() == 0
