import datetime as dt
import fnmatch
import glob
import os
import re
import time

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from plan_text import plan_of
from tidelog import (
    compact_days, days_from, dedup_stream, log_volume, project_logs, read_logs, read_quarantine, read_volume, replace_batch,
    route_store, start_dedup, start_ingest, start_routing, start_tail, start_volume, tail_logs, unseen_rows, write_logs,
)
from tidelog.operators.output import stored_rows
from tidelog.session import settings
from tidelog.streaming import dedup_stream as dedup_module

START = "2024-01-01 00:00:00"


def body(second, message="m"):
    return f'{{"timestamp":"2024-01-01T00:00:{second:02d}Z","level":"info","message":"{message}","resourceID":"r"}}'


def add_bodies(spark, folder, bodies):
    spark.createDataFrame([(b,) for b in bodies], "value string").write.mode("append").text(folder)


def run_ingest(spark, folder, **options):
    query = start_ingest(spark, f"{folder}/in", f"{folder}/logs", f"{folder}/progress", available_now=True, **options)
    query.awaitTermination()
    return sorted(r.Message for r in read_logs(spark, f"{folder}/logs").select("Message").collect())


def run_tail(spark, folder, **options):
    rows = tail_logs(spark, f"{folder}/logs", START, **options)
    start_tail(rows, f"{folder}/tail", path=f"{folder}/seen", available_now=True).awaitTermination()
    return sorted(r.Message for r in spark.read.parquet(f"{folder}/seen").collect())


def forget_commit(checkpoint, number):
    """As if the stream had stopped after a batch was delivered and before that was noted."""
    for file in (f"{checkpoint}/commits/{number}", f"{checkpoint}/commits/.{number}.crc"):
        os.remove(file)


def log(second, message):
    return (f"2024-01-01 00:00:{second:02d}", "info", message, "r")


def test_ingest_resumes_where_it_stopped(spark, folder):
    add_bodies(spark, f"{folder}/in", [body(1, "one"), "junk", body(2, "two")])
    assert run_ingest(spark, folder) == ["one", "two"]
    assert run_ingest(spark, folder) == ["one", "two"]
    add_bodies(spark, f"{folder}/in", [body(1, "late"), body(2, "two")])
    assert run_ingest(spark, folder) == ["late", "one", "two", "two"]
    assert [tuple(r) for r in read_quarantine(spark, f"{folder}/logs").select("body", "reason").collect()] == [("junk", "bad_json")]


def test_ingest_policies_and_batch_files(spark, folder):
    add_bodies(spark, f"{folder}/in", ["junk"] * 250)
    found = run_ingest(spark, folder, on_bad_json="empty", on_bad_ts="zero", max_rows_per_file=100)
    assert found == [""] * 250
    stored = glob.glob(f"{folder}/logs/status=ok/log_date=*/*/*.parquet")
    assert all(pq.ParquetFile(f).schema.column(0).physical_type == "INT64" for f in stored) and stored
    files = read_logs(spark, f"{folder}/logs").select(F.input_file_name().alias("f")).groupBy("f").count()
    assert max(r["count"] for r in files.collect()) <= 100


def test_ingest_gathers_days_and_splits_a_hot_one(spark, folder):
    """Bodies of ten days in 16 files, half of them of one day."""
    day = "date_add(date'2024-01-01', if(id % 2 = 0, 0, cast(id % 20 / 2 as int)))"
    bodies = spark.range(0, 40_000, 1, 16).selectExpr(
        f"""concat('{{"timestamp":"', {day}, 'T00:00:00Z","message":"', uuid(), '"}}') value""")
    bodies.write.text(f"{folder}/in")
    keys = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "200k", "spark.sql.shuffle.partitions": "64"}
    with settings(spark, keys):
        assert len(run_ingest(spark, folder)) == 40_000
    files = {d: len(glob.glob(f"{folder}/logs/status=ok/log_date=2024-01-{d:02d}/*/*.parquet")) for d in range(1, 11)}
    assert files[1] > 2 and sorted(files.values())[5] <= 2, files


def test_stream_and_batch_share_a_table(spark, make_logs, folder):
    add_bodies(spark, f"{folder}/in", [body(1, "stream")])
    run_ingest(spark, folder)
    write_logs(make_logs([log(1, "batch")]), f"{folder}/logs")
    add_bodies(spark, f"{folder}/in", [body(1, "again")])
    assert run_ingest(spark, folder) == ["again", "batch", "stream"]


def test_bodies_of_any_age_are_taken(spark, folder):
    add_bodies(spark, f"{folder}/in", [body(1, "new")])
    assert run_ingest(spark, folder) == ["new"]
    add_bodies(spark, f"{folder}/in", [body(2, "old")])
    for file in glob.glob(f"{folder}/in/*.txt"):
        if "old" in open(file).read():
            os.utime(file, (time.time() - 30 * 86400,) * 2)
    assert run_ingest(spark, folder) == ["new", "old"]


def test_taken_bodies_may_be_archived(spark, folder):
    for k in range(4):
        add_bodies(spark, f"{folder}/in", [body(k, str(k))])
        run_ingest(spark, folder, archive=f"{folder}/taken")
    assert run_ingest(spark, folder, archive=f"{folder}/taken") == ["0", "1", "2", "3"]
    assert len(glob.glob(f"{folder}/taken/**/*.txt", recursive=True)) >= 2


def broken_off(spark, rows, name, table):
    """The batch as a write leaves it that was killed while its partitions came into
    place: some days are there, the rest is in the write's own hidden folder."""
    replace_batch(rows.where("log_date < date'2024-01-05'"), name, table, ("status", "log_date"))
    rows.where("log_date >= date'2024-01-05'").write.parquet(f"{table}/.spark-staging-x/status=ok")


def test_a_batch_that_comes_again_replaces_itself(spark, make_logs, folder):
    """After a failure before, amid and after its files came into place, beside other
    batches of the same days."""
    rows = stored_rows(make_logs([(f"2024-01-{d:02d} 00:00:00", "", str(d), "") for d in range(1, 9)]))
    other = stored_rows(make_logs([("2024-01-02 00:00:00", "", "20", ""), ("2024-01-07 00:00:00", "", "70", "")]))
    table = f"{folder}/logs"
    messages = lambda: sorted(int(r.Message) for r in read_logs(spark, table).collect())
    replace_batch(other, "x-1", table, ("status", "log_date"))
    broken_off(spark, rows, "x-2", table)
    assert messages() == [1, 2, 3, 4, 20, 70]
    for _ in range(2):
        replace_batch(rows, "x-2", table, ("status", "log_date"))
        assert messages() == [*range(1, 9), 20, 70]


def test_an_ingest_killed_half_way_stores_each_row_once(spark, folder):
    """The stream stops between the write of a batch and its commit, in some days only."""
    days = [f'{{"timestamp":"2024-01-{d:02d}T00:00:00Z","message":"{d}"}}' for d in range(1, 9)]
    add_bodies(spark, f"{folder}/in", days)
    write = dedup_module.replace_batch

    class Killed(Exception):
        pass

    def kill(rows, name, path, parts, most=None):
        write(rows.where("log_date < date'2024-01-05'"), name, path, parts, most)
        raise Killed()

    from tidelog.streaming import ingest_stream

    ingest_stream.replace_batch = kill
    try:
        with pytest.raises(Exception):
            run_ingest(spark, folder)
    finally:
        ingest_stream.replace_batch = write
    assert sorted(r.Message for r in read_logs(spark, f"{folder}/logs").collect()) == ["1", "2", "3", "4"]
    assert run_ingest(spark, folder) == [str(d) for d in range(1, 9)]
    add_bodies(spark, f"{folder}/in", days[:2])
    assert run_ingest(spark, folder) == sorted([*[str(d) for d in range(1, 9)], "1", "2"])


def test_a_new_checkpoint_replaces_nothing(spark, folder):
    """Its micro-batches are numbered from 0 again."""
    add_bodies(spark, f"{folder}/in", [body(1, "one")])
    assert run_ingest(spark, folder) == ["one"]
    os.rename(f"{folder}/progress", f"{folder}/old-progress")
    assert run_ingest(spark, folder) == ["one", "one"]


def test_a_named_load_may_be_run_again(spark, make_logs, folder):
    rows = make_logs([log(1, "1"), log(2, "2")])
    write_logs(rows, folder)
    for _ in range(2):
        write_logs(rows, folder, batch="monday")
    assert sorted(r.Message for r in read_logs(spark, folder).collect()) == ["1", "1", "2", "2"]


def test_finished_days_are_compacted(spark, make_logs, folder):
    rows = [(f"2024-01-0{1 + i % 3} 00:00:{i:02d}", "", str(i), "") for i in range(30)]
    for i in range(0, 30, 10):
        write_logs(make_logs(rows[i : i + 10]), folder)
    done = compact_days(spark, folder, dt.date(2024, 1, 3))
    assert done == [dt.date(2024, 1, 1), dt.date(2024, 1, 2)]
    files = [len(glob.glob(f"{folder}/status=ok/log_date=2024-01-0{d}/*/*.parquet")) for d in (1, 2, 3)]
    assert files == [1, 1, 3]
    assert sorted(int(r.Message) for r in read_logs(spark, folder).collect()) == list(range(30))
    assert compact_days(spark, folder, dt.date(2024, 1, 3)) == []


def test_compaction_that_broke_off_is_finished(spark, make_logs, folder):
    """The day's own table is written, the day itself half overwritten."""
    for i in range(2):
        write_logs(make_logs([log(i, str(i))]), folder)
    day = f"{folder}/status=ok/log_date=2024-01-01"
    whole = read_logs(spark, folder).drop("log_date").selectExpr("*", "string(null) reason", "string(null) body", "string(null) event_key")
    whole.coalesce(1).write.parquet(f"{folder}/_compacting/day=2024-01-01")
    whole = spark.read.parquet(f"{folder}/_compacting/day=2024-01-01")
    whole.where("Message = '0'").selectExpr("*", "'compacted' batch").write.partitionBy("batch").mode("overwrite").parquet(day)
    assert compact_days(spark, folder, dt.date(2024, 1, 2)) == [dt.date(2024, 1, 1)]
    assert sorted(r.Message for r in read_logs(spark, folder).collect()) == ["0", "1"]
    assert len(glob.glob(f"{day}/*/*.parquet")) == 1 and glob.glob(f"{folder}/_compacting/*") == []


def test_tail_gives_every_row_once(spark, make_logs, folder):
    """New rows, a late one, and equal rows at the newest instant."""
    write_logs(make_logs([log(1, "1"), log(2, "2")]), f"{folder}/logs")
    assert run_tail(spark, folder) == ["1", "2"]
    write_logs(make_logs([log(3, "3")]), f"{folder}/logs")
    assert run_tail(spark, folder) == ["1", "2", "3"]
    write_logs(make_logs([log(5, "5"), log(5, "5"), log(4, "4")]), f"{folder}/logs")
    assert run_tail(spark, folder) == ["1", "2", "3", "4", "5", "5"]
    write_logs(make_logs([log(3, "late"), log(5, "5")]), f"{folder}/logs")
    assert run_tail(spark, folder) == ["1", "2", "3", "4", "5", "5", "5", "late"]
    assert run_tail(spark, folder) == ["1", "2", "3", "4", "5", "5", "5", "late"]


def test_late_rows_are_flagged_and_kept(spark, make_logs, folder):
    """Late by the newest row before, also when that one is from the future."""
    def run():
        rows = tail_logs(spark, f"{folder}/logs", START)
        start_tail(rows, f"{folder}/tail", path=f"{folder}/seen", available_now=True, late_column="late").awaitTermination()
        return sorted((r.Message, r.late) for r in spark.read.parquet(f"{folder}/seen").collect())

    write_logs(make_logs([log(1, "1"), log(5, "5")]), f"{folder}/logs")
    assert run() == [("1", False), ("5", False)]
    write_logs(make_logs([log(3, "3"), log(5, "5b"), ("2099-01-01 00:00:00", "", "future", "")]), f"{folder}/logs")
    write_logs(make_logs([log(6, "6")]), f"{folder}/logs")
    assert run()[2:] == [("5", False), ("5b", False), ("6", False), ("future", False)]
    write_logs(make_logs([log(7, "7")]), f"{folder}/logs")
    assert ("7", True) in run() and ("3", True) in run()


def test_polls_cost_the_same_however_many_there_were(spark, make_logs, folder):
    """The newest time lies in two places, and a poll that comes again flags the same."""
    for i in range(5):
        write_logs(make_logs([log(10 * i, str(i)), log(10 * i + 9, f"{i}+"), log(5, f"late {i}")]), f"{folder}/logs")
        rows = tail_logs(spark, f"{folder}/logs", START)
        start_tail(rows, f"{folder}/tail", path=f"{folder}/seen", available_now=True, late_column="late").awaitTermination()
    assert len(glob.glob(f"{folder}/tail/newest/*/*.parquet")) == 2
    forget_commit(f"{folder}/tail", 4)
    rows = tail_logs(spark, f"{folder}/logs", START)
    start_tail(rows, f"{folder}/tail", path=f"{folder}/seen", available_now=True, late_column="late").awaitTermination()
    found = spark.read.parquet(f"{folder}/seen").collect()
    assert len(found) == 15 and sorted(r.Message for r in found if r.late) == [f"late {i}" for i in range(1, 5)]


def test_tail_of_other_parquet_files(spark, make_logs, folder):
    make_logs([log(1, "1"), log(2, "2")]).write.parquet(f"{folder}/logs")
    assert run_tail(spark, folder, plain=True) == ["1", "2"]


def test_tail_lists_only_days_from_its_start(spark):
    for day in (dt.date(2024, 1, 10), dt.date(1999, 12, 31), dt.date(2000, 2, 29)):
        glob_ = days_from(day)[1:-1].split(",")
        for other in [day + dt.timedelta(n) for n in (-400, -31, -1, 0, 1, 22, 31, 366, 40_000)]:
            assert any(fnmatch.fnmatch(f"log_date={other}", g) for g in glob_) == (other >= day), (day, other)


def test_ingest_of_bodies_with_several_lines(spark, folder):
    spark.createDataFrame([(body(1).replace(",", ",\n"),)], "value string").coalesce(1).write.text(f"{folder}/in")
    assert run_ingest(spark, folder, source_options={"wholetext": True}) == ["m"]


@pytest.mark.parametrize("there", ["absent", "empty", "old"])
def test_tail_waits_for_the_first_rows(spark, make_logs, folder, there):
    if there == "empty":
        os.makedirs(f"{folder}/logs")
    if there == "old":
        write_logs(make_logs([("2023-12-31 00:00:00", "", "before the start", "")]), f"{folder}/logs")
    rows = tail_logs(spark, f"{folder}/logs", START)
    start_tail(rows, f"{folder}/tail", path=f"{folder}/seen", available_now=True).awaitTermination()
    write_logs(make_logs([log(1, "1")]), f"{folder}/logs")
    assert run_tail(spark, folder) == ["1"]


def test_running_tail_started_before_the_table(spark, make_logs, folder):
    query = start_tail(tail_logs(spark, f"{folder}/logs", START), f"{folder}/tail", path=f"{folder}/seen")
    try:
        query.processAllAvailable()
        write_logs(make_logs([log(1, "1")]), f"{folder}/logs")
        query.processAllAvailable()
    finally:
        query.stop()
    assert [r.Message for r in spark.read.parquet(f"{folder}/seen").collect()] == ["1"]


def test_default_start_is_an_hour_ago(spark, make_logs, folder):
    now = spark.sql("SELECT cast(now() as string), cast(now() - interval 2 hours as string)").first()
    write_logs(make_logs([(now[0], "", "new", ""), (now[1], "", "old", "")]), f"{folder}/logs")
    start_tail(tail_logs(spark, f"{folder}/logs"), f"{folder}/tail", path=f"{folder}/seen", available_now=True).awaitTermination()
    assert [r.Message for r in spark.read.parquet(f"{folder}/seen").collect()] == ["new"]


def test_tail_of_an_ingest_to_a_function(spark, folder):
    add_bodies(spark, f"{folder}/in", [body(i, str(i)) for i in range(20)])
    run_ingest(spark, folder)
    seen = []
    rows = tail_logs(spark, f"{folder}/logs", START, maxFilesPerTrigger=1)
    start_tail(rows, f"{folder}/tail", on_batch=lambda df, n: seen.extend(r.Message for r in df.collect()),
               available_now=True).awaitTermination()
    assert sorted(seen, key=int) == [str(i) for i in range(20)]


def test_running_tail_sees_new_rows_and_stops(spark, make_logs, folder):
    write_logs(make_logs([log(1, "1")]), f"{folder}/logs")
    query = start_tail(tail_logs(spark, f"{folder}/logs", START), f"{folder}/tail", path=f"{folder}/seen")
    try:
        query.processAllAvailable()
        write_logs(make_logs([log(2, "2")]), f"{folder}/logs")
        query.processAllAvailable()
    finally:
        query.stop()
    assert not query.isActive
    assert sorted(r.Message for r in spark.read.parquet(f"{folder}/seen").collect()) == ["1", "2"]


def test_options_are_checked(spark, make_logs, folder):
    write_logs(make_logs([log(1, "1")]), folder)
    with pytest.raises(ValueError):
        start_tail(tail_logs(spark, folder, START), f"{folder}-p")


def run_dedup(spark, folder):
    rows = tail_logs(spark, f"{folder}/in", START, maxFilesPerTrigger=2)
    start_dedup(rows, f"{folder}/logs", f"{folder}/progress", available_now=True).awaitTermination()
    return sorted(r.Message for r in read_logs(spark, f"{folder}/logs").collect())


def test_dedup_of_hot_copies_across_batches(spark, make_logs, folder):
    """A third of all rows are copies of one; copies also come in a later batch."""
    rows = spark.range(0, 3000, 1, 6).selectExpr(
        "timestamp '2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0, if(id % 3 = 0, 0, id % 60)) Timestamp",
        "'info' Level", "cast(if(id % 3 = 0, 0, id) as string) Message", "'r' ResourceID")
    expected = sorted({"0" if i % 3 == 0 else str(i) for i in range(3000)})
    for _ in range(2):
        write_logs(rows, f"{folder}/in")
        assert run_dedup(spark, folder) == expected


def test_dedup_loses_nothing_when_clocks_differ(spark, make_logs, folder):
    write_logs(make_logs([("2099-01-01 00:00:00", "", "future", ""), log(12, "12")]), f"{folder}/in")
    assert run_dedup(spark, folder) == ["12", "future"]
    write_logs(make_logs([log(11, "11"), log(12, "12"), (None, None, "no time", None)]), f"{folder}/in")
    assert run_dedup(spark, folder) == ["11", "12", "future"]
    write_logs(make_logs([log(1, "1"), log(1, "1"), ("2099-01-01 00:00:00", "", "future", "")]), f"{folder}/in")
    assert run_dedup(spark, folder) == ["1", "11", "12", "future"]


def test_unseen_rows_compare_nulls(spark, make_logs, folder):
    rows = make_logs([(None, None, "no time", None), log(1, "1")])
    write_logs(rows, folder)
    assert unseen_rows(rows.union(rows), folder).count() == 0
    assert unseen_rows(rows, f"{folder}-absent").count() == 2


def test_streams_use_no_python_function(spark, make_logs, folder):
    write_logs(make_logs([log(1, "1")]), f"{folder}/logs")
    plan = plan_of(unseen_rows(make_logs([log(1, "1")]), f"{folder}/logs"))
    assert "Python" not in plan and "LeftAnti" in plan


def test_stored_rows_survive_the_round_trip(spark, folder):
    add_bodies(spark, f"{folder}/in", [body(7, "x")])
    run_ingest(spark, folder)
    assert project_logs(read_logs(spark, f"{folder}/logs")).columns == ["Timestamp", "Level", "Message", "ResourceID"]


def keyed_rows(spark, folder, extra="id long"):
    return tail_logs(spark, f"{folder}/in", START, plain=True, extra=extra)


def add_keyed(spark, folder, sql):
    spark.sql(sql).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def run_keyed(spark, folder, **options):
    start_dedup(keyed_rows(spark, folder), f"{folder}/logs", f"{folder}/progress", available_now=True, keys=["id"], **options).awaitTermination()
    return sorted(r.Message for r in read_logs(spark, f"{folder}/logs").collect())


LIVE = "SELECT current_timestamp() - INTERVAL {} AS Timestamp, 'i' AS Level, '{}' AS Message, 'r' AS ResourceID, CAST({} AS BIGINT) AS id"


def test_dedup_by_key_of_live_rows_needs_no_table(spark, folder, monkeypatch):
    """Copies of young rows meet the state, in the same batch and across a restart; only
    old rows, those from the future and those without a time are looked up."""
    compared = []
    unseen = dedup_module.unseen_rows
    monkeypatch.setattr(dedup_module, "unseen_rows", lambda b, *a: compared.append(b.count()) or unseen(b, *a))
    add_keyed(spark, folder, f"{LIVE.format('1 SECOND', 'a', 1)} UNION ALL {LIVE.format('1 SECOND', 'a', 1)}")
    assert run_keyed(spark, folder) == ["a"]
    add_keyed(spark, folder, f"{LIVE.format('2 SECONDS', 'a again', 1)} UNION ALL {LIVE.format('1 SECOND', 'b', 2)}")
    assert run_keyed(spark, folder) == ["a", "b"]
    assert sum(compared) == 0
    add_keyed(spark, folder, f"{LIVE.format('3 DAYS', 'old', 3)} UNION ALL {LIVE.format('-3 DAYS', 'future', 4)}")
    assert run_keyed(spark, folder) == ["a", "b", "future", "old"]
    assert sum(compared) == 2


def test_dedup_by_key_after_the_state_is_gone(spark, folder):
    """A new checkpoint has no state: old rows are still recognised, by their key in the
    table; NULL keys are a key too."""
    rows = "SELECT timestamp '2024-01-02 00:00:00' + make_interval(0,0,0,0,0,0,id % 50) AS Timestamp, 'i' AS Level, concat('m', {}) AS Message, 'r' AS ResourceID, id FROM range(200)"
    add_keyed(spark, folder, rows.format("id") + " UNION ALL SELECT timestamp '2024-01-02', 'i', 'no key', 'r', NULL")
    first = run_keyed(spark, folder)
    assert len(first) == 201
    os.rename(f"{folder}/progress", f"{folder}/old-progress")
    add_keyed(spark, folder, rows.format("'again'"))
    assert run_keyed(spark, folder) == first


def test_dedup_batch_that_comes_again_loses_nothing(spark, folder):
    """It is not compared with its own rows, and replaces them."""
    add_keyed(spark, folder, f"{LIVE.format('1 SECOND', 'young', 1)} UNION ALL {LIVE.format('1 HOUR', 'older', 2)}")
    assert run_keyed(spark, folder) == ["older", "young"]
    forget_commit(f"{folder}/progress", 0)
    assert run_keyed(spark, folder) == ["older", "young"]


def test_unseen_rows_read_only_the_days_and_times_of_the_batch(spark, make_logs, folder):
    write_logs(make_logs([(f"2024-01-{d:02d} 00:00:00", "", str(d), "") for d in range(1, 29)]), folder)
    plan = plan_of(unseen_rows(make_logs([("2024-01-05 00:00:00", "", "5", "")]), folder))
    assert "PartitionFilters" in plan and "2024-01-05" in plan and "GreaterThanOrEqual(Timestamp" in plan
    many = make_logs([(f"2024-{m:02d}-{d:02d} 00:00:00", "", "x", "") for m in range(1, 5) for d in range(1, 29)])
    assert unseen_rows(many, folder).count() == 112


def test_dedup_state_keeps_recent_arrivals_only(spark, folder):
    add_keyed(spark, folder, LIVE.format("1 SECOND", "a", 1))
    rows = dedup_stream(keyed_rows(spark, folder), ["id"], "1 minute")
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert "DeduplicateWithinWatermark [event_key" in plan and re.search("EventTimeWatermark [^,]*, arrived_at", plan)


def test_dedup_keeps_its_state_once_per_batch(spark, folder):
    """Looking for copies goes through the batch more than once, but not through the state."""
    add_keyed(spark, folder, LIVE.format("1 HOUR", "a", 1))
    run_keyed(spark, folder)
    add_keyed(spark, folder, f"{LIVE.format('1 HOUR', 'a', 1)} UNION ALL {LIVE.format('1 SECOND', 'b', 2)}")
    plans, write = [], dedup_module.replace_batch
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(dedup_module, "replace_batch", lambda batch, *rest: (plans.append(plan_of(batch)), write(batch, *rest)))
        assert run_keyed(spark, folder) == ["a", "b"]
    kept = plans[0].count("InMemoryRelation")
    assert kept >= 2 and plans[0].count("Scan ExistingRDD") == kept


def run_volume(spark, folder, delay):
    rows = tail_logs(spark, f"{folder}/logs", START)
    start_volume(rows, f"{folder}/chart", f"{folder}/chart-progress", delay=delay, available_now=True).awaitTermination()
    return sorted(map(tuple, read_volume(spark, f"{folder}/chart").collect()))


def test_volume_stream_equals_the_batch(spark, make_logs, folder):
    """Without a delay late rows count, also those of a batch that comes again."""
    for hours in ([1, 2, 2, 30], [2, 3, 31], [1]):
        write_logs(make_logs([(f"2024-01-{1 + h // 24:02d} {h % 24:02d}:10:00", "ae"[h % 2], "m", "r") for h in hours]), f"{folder}/logs")
        found = run_volume(spark, folder, None)
    assert found == sorted(map(tuple, log_volume(read_logs(spark, f"{folder}/logs")).collect()))
    forget_commit(f"{folder}/chart-progress", 2)
    assert run_volume(spark, folder, None) == found


def test_volume_state_is_bounded_by_the_delay(spark, make_logs, folder):
    write_logs(make_logs([("2024-01-01 00:10:00", "a", "m", "r"), ("2024-01-03 00:10:00", "a", "m", "r")]), f"{folder}/logs")
    run_volume(spark, folder, "1 hour")
    write_logs(make_logs([("2024-01-01 00:20:00", "a", "too late", "r"), ("2024-01-03 00:20:00", "a", "m", "r")]), f"{folder}/logs")
    assert [r[2] for r in run_volume(spark, folder, "1 hour")] == [1, 2]


def test_routes_are_log_tables_and_a_batch_replaces_itself_in_all(spark, make_logs, folder):
    rules = [("alerts", F.col("Level") == "error"), ("vip", F.col("ResourceID") == "v")]
    stores = f"{folder}/stores"

    def run():
        rows = tail_logs(spark, f"{folder}/logs", START)
        start_routing(rows, rules, stores, f"{folder}/routing", "rest", available_now=True).awaitTermination()
        return {r: sorted(x.Message for x in read_logs(spark, route_store(stores, r)).collect()) for r in ("alerts", "vip", "rest")}

    levels = [("error", "v"), ("info", "v"), ("info", "x"), (None, None)]
    write_logs(make_logs([(f"2024-01-0{1 + k % 3} 00:00:00", *[levels[k % 4][0]], str(k), levels[k % 4][1]) for k in range(8)]), f"{folder}/logs")
    expected = {"alerts": ["0", "4"], "vip": ["1", "5"], "rest": ["2", "3", "6", "7"]}
    assert run() == expected
    forget_commit(f"{folder}/routing", 0)
    assert run() == expected
    write_logs(make_logs([("2024-01-09 00:00:00", "error", "8", "v")]), f"{folder}/logs")
    assert run()["alerts"] == ["0", "4", "8"]
