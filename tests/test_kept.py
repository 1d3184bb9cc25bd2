"""Kept summaries and the text index."""

import random

import pytest
from plan_text import plan_of
from pyspark.sql import DataFrameWriter

from tidelog import (
    files_with, filter_logs, index_text, merged_summary, merged_top_messages, read_logs, search_text, summarize_logs,
    top_messages, write_logs, write_summaries,
)
from tidelog.operators import text_index
from tidelog.operators.summaries import DISTINCT_ERROR
from pyspark.sql import functions as F


@pytest.fixture
def logs(make_logs):
    rng = random.Random(3)
    rows = [
        (f"2024-01-{rng.randint(1, 6):02d} {rng.randint(0, 23):02d}:00:00", rng.choice(["error", "info"]),
         rng.choice([None, "", f"m{rng.randint(0, 30)}"]), rng.choice(["a", "b", None]))
        for _ in range(400)
    ]
    return make_logs(rows)


def same(found, expected):
    columns = sorted(expected.columns)
    return sorted(map(str, found.select(columns).collect())) == sorted(map(str, expected.select(columns).collect()))


@pytest.mark.parametrize("by", [["Level"], ["Level", "ResourceID"], ["ResourceID"]])
def test_merged_summaries_are_those_of_the_rows(spark, logs, folder, by):
    write_summaries(logs, folder)
    assert same(merged_summary(spark, folder, by), summarize_logs(logs, by))
    some = logs.where("date(Timestamp) between '2024-01-02' and '2024-01-04'")
    assert same(merged_summary(spark, folder, by, "2024-01-02", "2024-01-04"), summarize_logs(some, by))


def test_a_day_done_again_replaces_itself(spark, logs, folder):
    days = F.dayofmonth("Timestamp")
    write_summaries(logs.where(days != 3), folder)
    write_summaries(logs.where((days == 3) & (F.col("Level") == "info")), folder)
    write_summaries(logs.where(days >= 3), folder)
    assert same(merged_summary(spark, folder, ["Level"]), summarize_logs(logs, ["Level"]))


def test_merged_top_messages(spark, logs, folder):
    write_summaries(logs, folder)
    expected = top_messages(logs.where("Message is not null"), 7)
    assert same(merged_top_messages(spark, folder, 7), expected)


def test_sketches_keep_their_bound(spark, folder):
    rows = spark.range(0, 60_000, 1, 4).selectExpr(
        "timestamp'2024-01-01' + make_interval(0,0,0,id % 5) Timestamp", "'i' Level", "concat('message ', id % 40000) Message", "'r' ResourceID")
    write_summaries(rows, folder)
    estimate = merged_summary(spark, folder).first().n_messages
    assert abs(estimate - 40_000) <= 4 * DISTINCT_ERROR * 40_000
    approx = summarize_logs(rows, ["Level"], approx=True).first().n_messages
    assert abs(approx - 40_000) <= 0.1 * 40_000


def test_the_sketch_keeps_its_bound_in_every_group(spark):
    rows = spark.range(0, 60 * 3000, 1, 4).selectExpr(
        "timestamp'2024-01-01' Timestamp", "concat('g', id % 60) Level", "concat('message ', id) Message", "'r' ResourceID")
    found = summarize_logs(rows, ["Level"], approx=True).collect()
    assert len(found) == 60 and all(abs(r.n_messages - 3000) <= 4 * DISTINCT_ERROR * 3000 for r in found)


def test_summaries_of_nothing(spark, logs, folder):
    write_summaries(logs, folder)
    write_summaries(logs.limit(0), folder)
    assert merged_summary(spark, folder).count() == 2
    assert merged_summary(spark, folder, first="2030-01-01").count() == 0


TEXTS = ["needle", "%needle%", "ne_dle", "né", "日本語", "x\\%y", "no such text", "ab", "", "a%needle", "needle in"]


@pytest.fixture
def texts(spark, make_logs, folder):
    """Twelve days, a file each; two of them hold the needle, one comes after the index."""
    rows = []
    for day in range(1, 13):
        message = {3: "a needle in hay", 5: "日本語 né", 7: "x%y", 9: "ab", 10: None}.get(day, "hay " * 50 + str(day))
        rows += [(f"2024-01-{day:02d} 00:00:00", "i", message, "r"), (f"2024-01-{day:02d} 00:00:01", "i", "plain", "r")]
    write_logs(make_logs(rows), f"{folder}/logs")
    index_text(spark, f"{folder}/logs", f"{folder}/index")
    write_logs(make_logs([("2024-01-20 00:00:00", "i", "the last needle", "r")]), f"{folder}/logs")
    return folder


@pytest.mark.parametrize("text", TEXTS)
def test_the_index_changes_no_result(spark, texts, text):
    for mode in ("like", "literal"):
        found = search_text(spark, f"{texts}/logs", f"{texts}/index", text, mode)
        expected = filter_logs(read_logs(spark, f"{texts}/logs"), contains_text=text, text_mode=mode) if text else read_logs(spark, f"{texts}/logs")
        expected = expected.where("Message is not null")
        assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))


def test_files_without_the_text_are_not_read(spark, texts):
    files = files_with(spark, f"{texts}/logs", f"{texts}/index", "needle")
    assert [f.split("log_date=")[1][:10] for f in files] == ["2024-01-03", "2024-01-20"]
    assert [f.split("log_date=")[1][:10] for f in files_with(spark, f"{texts}/logs", f"{texts}/index", "日本語")] == ["2024-01-05", "2024-01-20"]
    assert files_with(spark, f"{texts}/logs", f"{texts}/index", "ab") is None
    assert set(search_text(spark, f"{texts}/logs", f"{texts}/index", "needle").inputFiles()) == set(files)


def test_the_index_is_brought_up_to_date(spark, texts):
    for _ in range(2):
        index_text(spark, f"{texts}/logs", f"{texts}/index")
    rows = spark.read.parquet(f"{texts}/index")
    assert rows.select("file").distinct().count() == 13 and rows.groupBy("file", "bucket").count().where("count > 1").count() == 0
    assert len(files_with(spark, f"{texts}/logs", f"{texts}/index", "the last needle")) == 1
    assert search_text(spark, f"{texts}/logs", f"{texts}/index", "no such text at all").count() == 0


def test_filters_equal_sparks_own_bitmaps(spark, make_logs, folder, monkeypatch):
    """Files in several tasks, rows without a trigram; nothing is sorted per character."""
    rows = [(f"2024-01-{k % 3 + 1:02d} 00:00:00", "i", [None, "ab", "日本語の文 😀", f"message {k} " * 9][k % 4] if k % 3 else None, "r") for k in range(90)]
    for part in (rows[:40], rows[40:]):
        write_logs(make_logs(part), f"{folder}/logs", max_rows_per_file=7)
    plans, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: (plans.append(plan_of(self._df)), write(self, *a, **k)))
    index_text(spark, f"{folder}/logs", f"{folder}/index")
    monkeypatch.undo()
    assert "Generate explode" not in plans[0] and "construct" not in plans[0]
    stored = spark.read.parquet(f"{folder}/logs").select(F.col("_metadata.file_path").alias("file"), "Message")
    places = stored.select("file", F.explode_outer(text_index._trigrams(F.coalesce("Message", F.lit("")))).alias("place"))
    texts = places.where("place is not null")
    empty = places.groupBy("file").agg(F.max("place").alias("place")).where("place is null").select("file", F.lit(0).cast("long").alias("place"))
    expected = texts.unionByName(empty).groupBy("file", F.bitmap_bucket_number("place").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bitmap"))
    found = spark.read.parquet(f"{folder}/index")
    assert same(found, expected) and found.count() > 30
