"""Time the main steps over many made-up rows, a third of them copies of one.

    python bench_rows.py [rows] [threads]
"""

from __future__ import annotations

import sys
import tempfile
import time

from tidelog import (
    assign_batches, batch_sizes, compact_days, filter_logs, read_logs, start_dedup, summarize_logs, tail_logs,
    top_messages, write_logs,
)
from tidelog.session import get_session
from pyspark.sql import functions as F


def main() -> None:
    rows, threads = (int(x) for x in (sys.argv[1:] + ["20000000", "8"][len(sys.argv) - 1 :]))
    spark = get_session("rows", f"local[{threads}]", {"spark.sql.shuffle.partitions": "64", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    folder = tempfile.mkdtemp(prefix="bench-rows-")
    made = spark.range(0, rows, 1, 64).selectExpr(
        "timestamp_micros(1704067200000000 + if(id % 3 = 0, 0, pmod(xxhash64(id), 604800000000))) Timestamp",
        "if(id % 3 = 0, 'error', if(id % 5 = 0, 'warn', 'info')) Level",
        "if(id % 3 = 0, 'one message', concat('message ', id)) Message",
        "if(id % 3 = 0, 'server-0', concat('server-', id % 100000)) ResourceID",
    )

    def timed(name: str, step) -> None:
        started = time.perf_counter()
        result = step()
        if result is not None:
            result.write.format("noop").mode("overwrite").save()
        print(f"{name}: {time.perf_counter() - started:.1f} s", flush=True)

    timed("write_logs, rows made too", lambda: write_logs(made, f"{folder}/logs"))
    logs = read_logs(spark, f"{folder}/logs")
    arrivals = logs.select(((F.unix_micros("Timestamp") - 1704067200000000) / 3600).cast("long").alias("us"), F.xxhash64("Message").alias("id"))
    timed("level and time filter", lambda: filter_logs(logs, "2024-01-03 00:00:00", "2024-01-03 06:00:00", level="info"))
    timed("summarize_logs", lambda: summarize_logs(logs))
    timed("top_messages", lambda: top_messages(logs))
    timed("batch_sizes", lambda: batch_sizes(arrivals, "us"))
    timed("assign_batches", lambda: assign_batches(arrivals, "us", ["id"]))

    def dedup() -> None:
        rows_ = tail_logs(spark, f"{folder}/logs", "2024-01-01 00:00:00")
        start_dedup(rows_, f"{folder}/once", f"{folder}/progress", available_now=True).awaitTermination()

    timed("start_dedup", dedup)
    print("rows left:", read_logs(spark, f"{folder}/once").count())
    timed("compact_days", lambda: compact_days(spark, f"{folder}/logs", logs.agg(F.max("log_date")).first()[0]) and None)


if __name__ == "__main__":
    main()
