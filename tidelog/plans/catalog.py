"""Registered queries over the given tables, each beside its SQL for the oracle.

``events`` serves as the log table; bodies, plain lines, statements and bounds are
derived from whole tables by expressions. Timestamps leave as text with microseconds.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidelog.functions.readonly import is_read_only
from tidelog.functions.timestamps import micros_text
from tidelog.operators.batching import arrival_micros, assign_batches, batch_sizes
from tidelog.operators.filters import between, filter_logs, from_date, latest, normalize_bound, since
from tidelog.operators.ingest import (
    ingest, normalize_timestamp, route_logs, split_rows, validate,
)
from tidelog.operators.joins import asof_join, range_counts
from tidelog.operators.output import expanded_rows, export_logs, summary_rows, to_json_rows, write_logs, write_routed
from tidelog.operators.summaries import merged_summary, merged_top_messages, write_summaries
from tidelog.operators.summary import log_volume, summarize_logs, top_messages
from tidelog.operators.text_index import index_text, search_text
from tidelog.operators.tailing import next_cursor, tail_step
from tidelog.plans.search import register_logs, search, search_sql
from tidelog.session import fresh_folder
from tidelog.sources.bodies import extract_plaintext
from tidelog.sources.table import conform, events_as_logs, project_logs, read_logs, schema_from_config, TABLE_CONFIG
from tidelog.streaming.dedup_stream import start_dedup
from tidelog.streaming.derived import read_volume, route_store, start_routing, start_volume
from tidelog.streaming.ingest_stream import start_ingest
from tidelog.streaming.sink import compact_days
from tidelog.streaming.tail_stream import read_tail, start_tail, tail_logs

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
_START = "2024-01-01 00:00:00"


def _register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return add


# --- inputs -----------------------------------------------------------------

def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _logs(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    return events_as_logs(_table(spark, sf_dir, "events"), *extra)


def _body(timestamp: Column) -> Column:
    """JSON body of a log row whose timestamp text is ``timestamp``."""
    return F.to_json(
        F.struct(
            timestamp.alias("timestamp"),
            F.col("Level").alias("level"),
            F.col("Message").alias("message"),
            F.col("ResourceID").alias("resourceID"),
        )
    )


def _bodies(logs: DataFrame, *keep: str) -> DataFrame:
    iso = F.concat(F.date_format("Timestamp", _ISO), F.lit("Z"))
    return logs.select(*keep, _body(iso).alias("value"))


def _shown(df: DataFrame) -> DataFrame:
    """Timestamps as text, other columns as they are."""
    zoned = {"timestamp", "timestamp_ntz"}
    return df.select(
        *[(micros_text(F.col(c)).alias(c) if t in zoned else F.col(c)) for c, t in df.dtypes]
    )


# SQL of the log table, and of the text of a timestamp.
def _text(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


_LOGS = (
    'SELECT ts AS "Timestamp", event_type AS "Level", props AS "Message", '
    "'user-' || user_id AS \"ResourceID\", event_id, user_id FROM events"
)
_ROWS = f'SELECT {_text(chr(34) + "Timestamp" + chr(34))} AS "Timestamp", "Level", "Message", "ResourceID" FROM ({_LOGS})'


def _rows_where(condition: str) -> str:
    return f"{_ROWS} WHERE {condition}"


# --- scans and ingest ---------------------------------------------------------

@_register("scan_logs", _ROWS)
def scan_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(project_logs(_logs(spark, sf_dir)))


@_register("conform_schema", _ROWS)
def conform_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    shuffled_columns = _logs(spark, sf_dir, "value").select("ResourceID", "value", "Message", "Timestamp", "Level")
    return _shown(conform(shuffled_columns, schema_from_config(TABLE_CONFIG)))


@_register("ingest_json", _ROWS)
def ingest_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted, _ = ingest(_bodies(_logs(spark, sf_dir)))
    return _shown(accepted)


_CENTS = "CAST(floor(value * 100 + 0.5) AS BIGINT)"


@_register(
    "ingest_numbers",
    f"""
    SELECT event_id,
           CASE WHEN c % 100 = 0 THEN (c // 100)::VARCHAR
                WHEN c % 10 = 0 THEN (c // 100)::VARCHAR || '.' || (c % 100 // 10)::VARCHAR
                ELSE (c // 100)::VARCHAR || '.' || lpad((c % 100)::VARCHAR, 2, '0') END AS "Level",
           c::VARCHAR || 'e-2' AS "Message", c::VARCHAR || repeat('0', 20) AS "ResourceID"
    FROM (SELECT event_id, {_CENTS} AS c FROM events)
    """,
)
def ingest_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number with an exponent, the same characters as text beside it, and a number
    beyond 64 bits."""
    cents = _table(spark, sf_dir, "events").select("event_id", F.expr(_CENTS).cast("string").alias("c"))
    body = F.format_string(
        '{"timestamp":"2024-01-01T00:00:00Z","level":%se-2,"message":"%se-2","resourceID":%se20}', "c", "c", "c"
    )
    accepted, _ = ingest(cents.select("event_id", body.alias("value")))
    return accepted.select("event_id", "Level", "Message", "ResourceID")


@_register(
    "ingest_long_messages",
    "SELECT doc_id, lang AS \"Level\", text AS \"Message\", source AS \"ResourceID\" FROM documents",
)
def ingest_long_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long, non-ASCII and multi-line messages survive the body round trip."""
    documents = _table(spark, sf_dir, "documents").select(
        "doc_id", F.col("lang").alias("Level"), F.col("text").alias("Message"), F.col("source").alias("ResourceID")
    )
    body = _body(F.lit("2024-01-01T00:00:00Z"))
    accepted, _ = ingest(documents.select("doc_id", body.alias("value")))
    return accepted.drop("Timestamp")


@_register(
    "quarantine_bodies",
    """
    SELECT doc_id,
           CASE WHEN lang = 'en' THEN 'bad_timestamp' ELSE 'bad_json' END AS reason,
           CASE WHEN lang = 'en' THEN NULL ELSE text END AS raw_text
    FROM documents WHERE lang IN ('en', 'fr')
    """,
)
def quarantine_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English texts come as bodies without a time, French ones as no JSON at all, the
    others as good bodies; the quarantine holds the first two."""
    text = F.struct(F.col("text").alias("message"))
    timed = F.struct(F.lit("2024-01-01T00:00:00Z").alias("timestamp"), F.col("text").alias("message"))
    value = (
        F.when(F.col("lang") == "en", F.to_json(text))
        .when(F.col("lang") == "fr", F.col("text"))
        .otherwise(F.to_json(timed))
    )
    _, rejected = ingest(_table(spark, sf_dir, "documents").select("doc_id", value.alias("value")))
    raw = F.when(F.col("reason") == "bad_json", F.col("body"))
    return rejected.select("doc_id", "reason", raw.alias("raw_text"))


@_register(
    "ingest_empty_policy",
    """
    SELECT doc_id, CASE WHEN lang = 'fr' THEN '' ELSE text END AS "Message",
           '0001-01-01 00:00:00.000000' AS "Timestamp"
    FROM documents
    """,
)
def ingest_empty_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store's own policy: unreadable bodies and times are kept, empty and zero."""
    text = F.to_json(F.struct(F.col("text").alias("message")))
    value = F.when(F.col("lang") == "fr", F.col("text")).otherwise(text)
    documents = _table(spark, sf_dir, "documents").select("doc_id", value.alias("value"))
    accepted, _ = ingest(documents, on_bad_json="empty", on_bad_ts="zero")
    return _shown(accepted.select("doc_id", "Message", "Timestamp"))


@_register("normalize_offsets", f"SELECT event_id, {_text('ts')} AS \"Timestamp\" FROM events")
def normalize_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each level is logged in a zone of its own; all come back as the same UTC."""
    minutes = (
        F.when(F.col("event_type") == "click", 330)
        .when(F.col("event_type") == "view", -210)
        .when(F.col("event_type") == "error", 1140)
        .otherwise(0)
    )
    zone = (
        F.when(F.col("event_type") == "click", "+05:30")
        .when(F.col("event_type") == "view", "-03:30")
        .when(F.col("event_type") == "error", "+19:00")
        .otherwise("Z")
    )
    local = F.date_format(F.timestamp_add("MINUTE", minutes, F.col("ts").cast("timestamp")), _ISO)
    events = _table(spark, sf_dir, "events").select("event_id", F.concat(local, zone).alias("logged_at"))
    return _shown(normalize_timestamp(events, "logged_at").select("event_id", "Timestamp"))


@_register(
    "bad_timestamps",
    f"""
    SELECT event_id, CASE event_type
        WHEN 'click' THEN {_text('ts')}
        WHEN 'purchase' THEN {_text('ts')}
        ELSE '0001-01-01 00:00:00.000000' END AS "Timestamp"
    FROM events
    """,
)
def bad_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per level another spelling: two are legal, three are not and become year one."""
    ts = F.col("ts")
    text = (
        F.when(F.col("event_type") == "click", F.date_format(ts, _ISO + "'Z'"))
        .when(F.col("event_type") == "purchase", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss,SSSSSS'Z'"))
        .when(F.col("event_type") == "view", F.date_format(ts, "yyyy-MM-dd"))
        .when(F.col("event_type") == "error", F.date_format(ts, _ISO))
        .otherwise(F.date_format(ts, _ISO + "'+0530'"))
    )
    events = _table(spark, sf_dir, "events").select("event_id", text.alias("logged_at"))
    return _shown(normalize_timestamp(events, "logged_at", on_bad_ts="zero").select("event_id", "Timestamp"))


@_register("ingest_plaintext", _ROWS)
def ingest_plaintext(spark: SparkSession, sf_dir: str) -> DataFrame:
    iso = F.date_format("Timestamp", _ISO + "'Z'")
    line = F.concat_ws(" ", iso, F.upper("Level"), F.concat(F.lit("["), "ResourceID", F.lit("]")), "Message")
    lines = _logs(spark, sf_dir).select(line.alias("value"))
    pattern = r"^(\S+) (\S+) \[([^\]]*)\] (.*)$"
    fields = extract_plaintext(lines, pattern, {"timestamp": 1, "level": 2, "resourceID": 3, "message": 4})
    accepted, _ = split_rows(normalize_timestamp(fields))
    return _shown(project_logs(accepted.withColumn("Level", F.lower("Level"))))


@_register(
    "validate_logs",
    """
    SELECT event_id, CASE
        WHEN event_type NOT IN ('error', 'view', 'click') THEN 'known_level'
        WHEN NOT contains(props, '7') THEN 'has_seven' END AS reason
    FROM events
    """,
)
def validate_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {
        "known_level": F.col("Level").isin("error", "view", "click"),
        "has_seven": F.col("Message").contains("7"),
    }
    return validate(_logs(spark, sf_dir, "event_id"), rules).select("event_id", "reason")


@_register(
    "route_logs",
    """
    SELECT event_id, CASE WHEN event_type = 'error' THEN 'alerts'
        WHEN user_id < 50 THEN 'internal' ELSE 'archive' END AS route
    FROM events
    """,
)
def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("alerts", F.col("Level") == "error"), ("internal", F.col("user_id") < 50)]
    return route_logs(_logs(spark, sf_dir, "event_id", "user_id"), rules, "archive").select("event_id", "route")


@_register(
    "routed_files",
    """
    SELECT CASE WHEN event_type = 'error' THEN 'alerts' WHEN user_id < 50 THEN 'internal' ELSE 'archive' END AS route, event_id
    FROM events
    """,
)
def routed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every route is written to a folder of its own and read back."""
    path = fresh_folder(spark, "routes")
    rules = [("alerts", F.col("Level") == "error"), ("internal", F.col("user_id") < 50)]
    write_routed(route_logs(_logs(spark, sf_dir, "event_id", "user_id"), rules, "archive"), path)
    return spark.read.parquet(path).select("route", "event_id")


# Arrival time for batching: an hour of events passes in one second, so that both
# count flushes and clock flushes occur.
_ARRIVAL = "(epoch_us(ts) - 1704067200000000) // 3600"
_TICKS = f"""
    SELECT event_id, us, CASE WHEN us < 15000000 THEN 0 ELSE (us - 15000000) // 5000000 + 1 END AS tick
    FROM (SELECT event_id, {_ARRIVAL} AS us FROM events)
"""
_CHUNKS = f"SELECT event_id, tick, (row_number() OVER (PARTITION BY tick ORDER BY us, event_id) - 1) // 100 AS chunk FROM ({_TICKS})"


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    since_start = arrival_micros(F.col("ts"), F.lit(_START).cast("timestamp_ntz"))
    return _table(spark, sf_dir, "events").select("event_id", F.call_function("div", since_start, F.lit(3600)).alias("us"))


@_register("batch_assign", _CHUNKS)
def batch_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_batches(_arrivals(spark, sf_dir), "us", ["event_id"]).select("event_id", "tick", "chunk")


@_register("batch_sizes", f"SELECT tick, chunk, count(*) AS n_rows FROM ({_CHUNKS}) GROUP BY tick, chunk")
def batch_sizes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_sizes(_arrivals(spark, sf_dir), "us")


# --- sinks and output forms -----------------------------------------------------

def _stored(spark: SparkSession, logs: DataFrame, label: str) -> str:
    path = fresh_folder(spark, label)
    write_logs(logs, path)
    return path


@_register("sink_roundtrip", _ROWS)
def sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _stored(spark, _logs(spark, sf_dir), "logs")
    return _shown(project_logs(read_logs(spark, path)))


@_register(
    "stored_range",
    _rows_where(
        "\"Timestamp\" BETWEEN TIMESTAMP '2024-01-10 06:00:00' AND TIMESTAMP '2024-01-12 18:30:00' AND \"Level\" = 'error'"
    ),
)
def stored_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter over the stored table, which reads three of its days."""
    logs = read_logs(spark, _stored(spark, _logs(spark, sf_dir), "logs"))
    return _shown(project_logs(filter_logs(logs, "2024-01-10 06:00:00", "2024-01-12 18:30:00", level="error")))


@_register(
    "json_rows",
    f"""
    SELECT to_json({{'Timestamp': "Timestamp", 'Level': "Level", 'Message': "Message",
                     'ResourceID': "ResourceID"}})::VARCHAR AS value
    FROM ({_ROWS})
    """,
)
def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_json_rows(project_logs(_logs(spark, sf_dir)))


@_register("export_json", ORACLES["json_rows"])
def export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_folder(spark, "export")
    export_logs(project_logs(_logs(spark, sf_dir)), path, "json")
    return spark.read.text(path)


@_register("export_csv", _ROWS)
def export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_folder(spark, "export")
    export_logs(project_logs(_logs(spark, sf_dir)), path, "csv")
    return spark.read.options(header=True, escape='"', multiLine=True).csv(path)


_DISPLAY = "strftime({}, '%-m/%-d/%Y, %-I:%M:%S %p')"


@_register(
    "summary_rows",
    f"""
    SELECT {_DISPLAY.format('ts')} AS shown_at,
           to_json({{'Timestamp': {_text('ts')}, 'Level': event_type, 'Message': props,
                     'ResourceID': 'user-' || user_id}})::VARCHAR AS summary
    FROM events
    """,
)
def summary_rows_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary_rows(_logs(spark, sf_dir))


@_register(
    "expanded_rows",
    f"""
    SELECT event_id, 'Timestamp' AS field, {_DISPLAY.format('ts')} AS value FROM events
    UNION ALL SELECT event_id, 'Level', event_type FROM events
    UNION ALL SELECT event_id, 'Message', props FROM events
    UNION ALL SELECT event_id, 'ResourceId', 'user-' || user_id FROM events
    """,
)
def expanded_rows_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expanded_rows(_logs(spark, sf_dir, "event_id"), ("event_id",))


# --- filters ----------------------------------------------------------------------

@_register("latest_hour", _rows_where('"Timestamp" >= (SELECT date_trunc(\'second\', max(ts) - INTERVAL 1 HOUR) FROM events)'))
def latest_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recent window, as if asked at the moment of the newest event."""
    logs = _logs(spark, sf_dir)
    newest = logs.agg(F.max("Timestamp").cast("timestamp_ntz")).first()[0]
    return _shown(latest(logs, now=newest))


@_register("since_cursor", _rows_where("\"Timestamp\" >= TIMESTAMP '2024-01-20 12:34:56.789'"))
def since_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(since(_logs(spark, sf_dir), "2024-01-20 12:34:56.789"))


@_register(
    "date_range",
    _rows_where("\"Timestamp\" >= TIMESTAMP '2024-01-05 00:00:00' AND \"Timestamp\" <= TIMESTAMP '2024-01-09 23:59:59'"),
)
def date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(between(_logs(spark, sf_dir), _START.replace("-01 ", "-05 "), "2024-01-09 23:59:59"))


@_register("from_date", _rows_where("\"Timestamp\" >= TIMESTAMP '2024-01-25 00:00:00'"))
def from_date_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(from_date(_logs(spark, sf_dir), "2024-01-25"))


@_register("filter_level", _rows_where("\"Level\" = 'error'"))
def filter_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(filter_logs(_logs(spark, sf_dir), level="error"))


@_register("filter_text", _rows_where("\"Message\" LIKE '%: 7_}%'"))
def filter_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(filter_logs(_logs(spark, sf_dir), contains_text=": 7_}"))


@_register("filter_text_literal", _rows_where("contains(\"Message\", '\"k\": 4')"))
def filter_text_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(filter_logs(_logs(spark, sf_dir), contains_text='"k": 4', text_mode="literal"))


@_register("filter_long_text", "SELECT doc_id, lang FROM documents WHERE text LIKE '%on%the_re%'")
def filter_long_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text filter over whole long messages."""
    messages = _table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("text").alias("Message"), F.lit(_START).cast("timestamp").alias("Timestamp"))
    return filter_logs(messages, contains_text="on%the_re").select("doc_id", "lang")


@_register("indexed_text", "SELECT doc_id::VARCHAR AS \"ResourceID\", lang AS \"Level\" FROM documents WHERE text LIKE '%on%the_re%'")
def indexed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text filter over whole long messages in a stored table of forty days, half of
    which the text index knows."""
    day = F.timestamp_add("DAY", (F.col("doc_id") % 40).cast("int"), F.lit(_START).cast("timestamp"))
    logs = _table(spark, sf_dir, "documents").select(
        day.alias("Timestamp"), F.col("lang").alias("Level"), F.col("text").alias("Message"), F.col("doc_id").cast("string").alias("ResourceID"))
    folder = fresh_folder(spark, "indexed")
    write_logs(logs.where("ResourceID % 2 = 0"), f"{folder}/logs")
    index_text(spark, f"{folder}/logs", f"{folder}/index")
    write_logs(logs.where("ResourceID % 2 = 1"), f"{folder}/logs")
    return search_text(spark, f"{folder}/logs", f"{folder}/index", "on%the_re").select("ResourceID", "Level")


@_register("filter_resource", _rows_where("\"ResourceID\" = 'user-6'"))
def filter_resource(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(filter_logs(_logs(spark, sf_dir), resource_id="user-6"))


_ALL_FILTERS = dict(start="2024-01-03 00:00:00", end="2024-01-28 12:00:00", level="error", contains_text="7")


@_register(
    "filter_all",
    _rows_where(
        "\"Timestamp\" BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-28 12:00:00' "
        "AND \"Level\" = 'error' AND \"Message\" LIKE '%7%' AND \"ResourceID\" = 'user-6'"
    ),
)
def filter_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(filter_logs(_logs(spark, sf_dir), **_ALL_FILTERS, resource_id="user-6"))


@_register("filter_none", _ROWS)
def filter_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(filter_logs(_logs(spark, sf_dir), start="", end=None, level="", contains_text="", resource_id=None))


@_register(
    "bound_normalize",
    """
    SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS same_zone,
           strftime(date_trunc('second', ts + INTERVAL 5 HOUR), '%Y-%m-%d %H:%M:%S') AS from_new_york
    FROM events
    """,
)
def bound_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event time typed into a form, in UTC and in New York (winter: UTC-5)."""
    typed = _table(spark, sf_dir, "events").select("event_id", F.date_format("ts", _ISO).alias("typed"))
    return typed.select(
        "event_id",
        normalize_bound("typed").alias("same_zone"),
        normalize_bound("typed", "America/New_York").alias("from_new_york"),
    )


# --- streams ------------------------------------------------------------------------

def _run_tail(spark: SparkSession, rows: DataFrame, checkpoint: str, path: str) -> None:
    start_tail(rows, checkpoint, path=path, available_now=True).awaitTermination()


def _first_time(logs: DataFrame):
    """The oldest time of the logs, where a tail over all of them starts."""
    return logs.agg(F.min(F.col("Timestamp").cast("timestamp_ntz"))).first()[0]


def _from_the_future(logs: DataFrame) -> DataFrame:
    """The newest log once more, dated 75 years later, as a bad clock would send it."""
    newest = logs.orderBy(F.col("event_id").desc()).limit(1)
    return newest.withColumn("Timestamp", F.col("Timestamp") + F.expr("INTERVAL 75 YEARS"))


_FUTURE = f"""
    SELECT {_text("ts + INTERVAL 75 YEAR")} AS "Timestamp", event_type AS "Level", props AS "Message",
           'user-' || user_id AS "ResourceID"
    FROM events WHERE event_id = (SELECT max(event_id) FROM events)
"""


@_register("ingest_stream", _ROWS)
def ingest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies come in two loads of several files; the ingest takes one file per
    micro-batch, ends after the first load and goes on after a restart."""
    folder = fresh_folder(spark, "ingest")
    bodies = _bodies(_logs(spark, sf_dir, "user_id"), "user_id")
    odd = F.col("user_id") % 2 == 1
    for part in (odd, ~odd):
        bodies.where(part).select("value").repartition(3).write.mode("append").text(f"{folder}/bodies")
        start_ingest(
            spark, f"{folder}/bodies", f"{folder}/logs", f"{folder}/progress", available_now=True,
            source_options={"maxFilesPerTrigger": 1},
        ).awaitTermination()
    return _shown(project_logs(read_logs(spark, f"{folder}/logs")))


@_register("compact_days", _ROWS)
def compact_days_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day is stored in pieces; the days of the first half are compacted."""
    logs, folder = _logs(spark, sf_dir, "event_id"), fresh_folder(spark, "compact")
    for k in range(3):
        write_logs(logs.where(F.col("event_id") % 3 == k), folder)
    first, last = logs.agg(F.min("Timestamp").cast("date"), F.max("Timestamp").cast("date")).first()
    compact_days(spark, folder, first + (last - first) / 2)
    return _shown(project_logs(read_logs(spark, folder)))


@_register("tail_all", _ROWS)
def tail_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tail starts before there is a table; then half of the levels are stored and
    tailed, then the rest arrives and the tail resumes: every row comes once."""
    logs, folder = _logs(spark, sf_dir), fresh_folder(spark, "tail")
    start, first = _first_time(logs), F.col("Level").isin("click", "view", "error")
    for part in (None, first, ~first):
        if part is not None:
            write_logs(logs.where(part), f"{folder}/logs")
        _run_tail(spark, tail_logs(spark, f"{folder}/logs", start), f"{folder}/progress", f"{folder}/seen")
    return _shown(read_tail(spark, f"{folder}/seen"))


@_register(
    "tail_late",
    f"""
    SELECT *, "Level" NOT IN ('click', 'view') AS late FROM ({_ROWS})
    UNION ALL SELECT *, false FROM ({_FUTURE})
    """,
)
def tail_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and views come first, then one row from the future, then all others, which
    are late. Every row is shown, late ones with a flag."""
    logs, folder = _logs(spark, sf_dir, "event_id"), fresh_folder(spark, "tail")
    start, first = _first_time(logs), F.col("Level").isin("click", "view")
    for rows in (logs.where(first), _from_the_future(logs), logs.where(~first)):
        write_logs(rows, f"{folder}/logs")
        tail = tail_logs(spark, f"{folder}/logs", start)
        start_tail(tail, f"{folder}/progress", f"{folder}/seen", available_now=True, late_column="late").awaitTermination()
    return _shown(read_tail(spark, f"{folder}/seen", "late"))


@_register("dedup_events", f"{_ROWS} UNION ALL {_FUTURE}")
def dedup_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source that delivers the whole table twice, a row from the future among it, in
    several micro-batches whose days are out of order."""
    logs, folder = _logs(spark, sf_dir, "event_id"), fresh_folder(spark, "dedup")
    everything = logs.union(_from_the_future(logs))
    write_logs(everything, f"{folder}/in")
    write_logs(everything.where(F.col("event_id") % 2 == 0), f"{folder}/in")
    write_logs(everything.where(F.col("event_id") % 2 == 1), f"{folder}/in")
    rows = tail_logs(spark, f"{folder}/in", _first_time(logs), maxFilesPerTrigger=32)
    start_dedup(rows, f"{folder}/logs", f"{folder}/progress", available_now=True).awaitTermination()
    return _shown(project_logs(read_logs(spark, f"{folder}/logs")))


@_register("dedup_by_key", _ROWS)
def dedup_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sender that repeats its messages with a note, under the same event id: the first
    copy stays. Every third message comes again in the same load, all in a second one."""
    events = events_as_logs(_table(spark, sf_dir, "events"), "event_id")
    events = events.withColumn("Timestamp", F.col("Timestamp").cast("timestamp"))
    folder, first = fresh_folder(spark, "keyed"), _first_time(events)
    again = events.withColumn("Message", F.concat("Message", F.lit(" (sent again)")))
    for load in (events, again.where(F.col("event_id") % 3 == 0), again):
        load.write.mode("append").parquet(f"{folder}/in")
        rows = tail_logs(spark, f"{folder}/in", first, plain=True, extra="event_id long")
        start_dedup(rows, f"{folder}/logs", f"{folder}/progress", available_now=True, keys=["event_id"]).awaitTermination()
    return _shown(project_logs(read_logs(spark, f"{folder}/logs")))


_CURSOR_BOUND = "2024-01-15 00:00:00"


@_register(
    "next_cursor",
    f"SELECT event_id, {_text('ts')} AS \"Timestamp\", event_type AS \"Level\", props AS \"Message\", "
    "'user-' || user_id AS \"ResourceID\" FROM events ORDER BY ts DESC, event_id DESC LIMIT 1",
)
def next_cursor_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(next_cursor(_logs(spark, sf_dir, "event_id"), ["event_id"]))


@_register("tail_step", _rows_where(f"\"Timestamp\" > (SELECT max(ts) FROM events WHERE ts <= TIMESTAMP '{_CURSOR_BOUND}')"))
def tail_step_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One poll after the cursor stood at the newest row before mid-month."""
    logs = _logs(spark, sf_dir, "event_id")
    cursor = next_cursor(between(logs, _START, _CURSOR_BOUND), ["event_id"]).first()
    return _shown(project_logs(tail_step(logs, cursor, ["event_id"])))


# --- joins by time ------------------------------------------------------------------------

@_register(
    "asof_last_error",
    f"""
    SELECT p.event_id, p."ResourceID", {_text('e."Timestamp"')} AS last_error_at, e.event_id AS last_error
    FROM (SELECT * FROM ({_LOGS}) WHERE "Level" = 'purchase') p
    ASOF LEFT JOIN (SELECT * FROM ({_LOGS}) WHERE "Level" = 'error') e
    ON p."ResourceID" = e."ResourceID" AND p."Timestamp" >= e."Timestamp"
    """,
)
def asof_last_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last error before each purchase, per resource."""
    logs = _logs(spark, sf_dir, "event_id")
    errors = logs.where(F.col("Level") == "error").select("ResourceID", "Timestamp", "event_id")
    found = asof_join(logs.where(F.col("Level") == "purchase"), errors, ["ResourceID"], columns=["Timestamp", "event_id"])
    return _shown(found.select(
        "event_id", "ResourceID", F.col("last_Timestamp").alias("last_error_at"), F.col("last_event_id").alias("last_error")))


@_register(
    "range_clicks_after_error",
    f"""
    SELECT e.event_id AS error_id, count(*) AS clicks, count(DISTINCT c."ResourceID") AS resources
    FROM (SELECT * FROM ({_LOGS}) WHERE "Level" = 'error') e
    JOIN (SELECT * FROM ({_LOGS}) WHERE "Level" = 'click') c
    ON c."Timestamp" BETWEEN e."Timestamp" AND e."Timestamp" + INTERVAL 1 MINUTE * (1 + e.event_id % 40)
    GROUP BY 1
    """,
)
def range_clicks_after_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks of anybody in the minutes after each error, between one and forty of them."""
    logs = _logs(spark, sf_dir, "event_id")
    minutes = F.make_dt_interval(mins=(1 + F.col("event_id") % 40).cast("int"))
    errors = logs.where(F.col("Level") == "error").select(
        F.col("event_id").alias("error_id"), F.col("Timestamp").alias("begin"), (F.col("Timestamp") + minutes).alias("end"))
    clicks = logs.where(F.col("Level") == "click").select("Timestamp", "ResourceID")
    found = range_counts(clicks, errors, "Timestamp", "begin", "end", by="error_id", value="ResourceID")
    return found.select("error_id", F.col("n_pairs").alias("clicks"), F.col("n_values").alias("resources"))


# --- search -----------------------------------------------------------------------------

_STATEMENT = """
    CASE right(source, 1)
        WHEN '0' THEN 'SELECT * FROM logs WHERE Message LIKE ''%' || text || '%'''
        WHEN '1' THEN chr(10) || chr(9) || ' select 1 -- ' || text
        WHEN '2' THEN 'with a as (select 1) select * from a -- ' || text
        WHEN '3' THEN 'select 1; DROP table logs -- ' || text
        WHEN '4' THEN 'describe updated_at -- ' || text || ' dropped'
        ELSE 'select replace(Message, ''a'', ''b'') from logs -- ' || text
    END
"""


@_register(
    "readonly_gate",
    f"""
    SELECT doc_id,
           regexp_matches(q, '^(select|show|describe|explain)') AND NOT regexp_matches(q,
             '\\b(insert|update|delete|drop|create|alter|truncate|rename|replace|merge)\\b') AS accepted
    FROM (SELECT doc_id, lower(regexp_replace({_STATEMENT}, '^\\s+', '')) AS q FROM documents)
    """,
)
def readonly_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit of one statement per document, the whole text inside; the kind of
    statement goes with the document's source."""
    statements = _table(spark, sf_dir, "documents").select("doc_id", F.expr(_STATEMENT_SPARK).alias("sql"))
    return statements.select("doc_id", is_read_only(F.col("sql")).alias("accepted"))


_STATEMENT_SPARK = _STATEMENT.replace("''%'", "\\'%'").replace("'%'''", "'%\\''").replace("''a'', ''b''", "\\'a\\', \\'b\\'")


@_register(
    "small_result",
    f"""
    SELECT "Level", "ResourceID", count(*) AS n_logs, count(*) / sum(count(*)) OVER () AS share,
           {_text('min(ts)')} AS first_seen, {_text('max(ts)')} AS last_seen,
           count(DISTINCT "Message") AS n_messages
    FROM (SELECT "Timestamp" AS ts, "Level", "Message", "ResourceID" FROM ({_LOGS}) WHERE "Level" = 'error')
    GROUP BY "Level", "ResourceID"
    """,
)
def small_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary that comes with a statement, here with all errors."""
    register_logs(_logs(spark, sf_dir))
    return _shown(search(spark, "SELECT * FROM logs WHERE Level = :level", {"level": "error"}).summary)


@_register("large_result", _rows_where("\"Level\" <> 'error'"))
def large_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the same kind of statement."""
    register_logs(_logs(spark, sf_dir))
    return _shown(search(spark, "SELECT * FROM logs WHERE Level <> :level", {"level": "error"}).logs)


@_register(
    "sql_metadata",
    """
    SELECT * FROM (VALUES ('Timestamp', 'timestamp_ntz', NULL::VARCHAR), ('Level', 'string', NULL), ('Message', 'string', NULL),
                          ('ResourceID', 'string', NULL)) AS t(col_name, data_type, comment)
    """,
)
def sql_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_logs(_logs(spark, sf_dir))
    return search_sql(spark, "DESCRIBE logs")


@_register(
    "summary_level",
    f"""
    SELECT event_type AS "Level", count(*) AS n_logs,
           count(*) / (SELECT count(*) FROM events)::DOUBLE AS share,
           {_text('min(ts)')} AS first_seen, {_text('max(ts)')} AS last_seen,
           count(DISTINCT props) AS n_messages
    FROM events GROUP BY event_type
    """,
)
def summary_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(summarize_logs(_logs(spark, sf_dir), ["Level"]))


@_register(
    "summary_resource",
    f"""
    SELECT event_type AS "Level", 'user-' || user_id AS "ResourceID", count(*) AS n_logs,
           count(*) / (SELECT count(*) FROM events)::DOUBLE AS share,
           {_text('min(ts)')} AS first_seen, {_text('max(ts)')} AS last_seen,
           count(DISTINCT props) AS n_messages
    FROM events GROUP BY event_type, user_id
    """,
)
def summary_resource(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(summarize_logs(_logs(spark, sf_dir)))


@_register(
    "top_messages",
    """
    SELECT * FROM (
        SELECT event_type AS "Level", props AS "Message", count(*) AS n_logs,
               row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, props) AS rank
        FROM events GROUP BY event_type, props)
    WHERE rank <= 5
    """,
)
def top_messages_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_messages(_logs(spark, sf_dir), 5)


def _summaries(spark: SparkSession, sf_dir: str) -> str:
    """Kept summaries of all days, those of the second half written later."""
    logs, path = _logs(spark, sf_dir), fresh_folder(spark, "summaries")
    early = F.col("Timestamp") < F.lit("2024-01-16").cast("timestamp_ntz")
    for part in (early, ~early):
        write_summaries(logs.where(part), path)
    return path


@_register("summary_merged", ORACLES["summary_level"])
def summary_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept per day, level and resource, merged per level. There are so few messages that
    the sketches count them exactly."""
    return _shown(merged_summary(spark, _summaries(spark, sf_dir), ["Level"]))


@_register("top_messages_merged", ORACLES["top_messages"])
def top_messages_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged_top_messages(spark, _summaries(spark, sf_dir), 5)


@_register(
    "summary_approx",
    """
    SELECT event_type AS "Level", count(*) AS n_logs, count(DISTINCT event_id::VARCHAR || props) AS exact, true AS within_bound
    FROM events GROUP BY event_type
    """,
)
def summary_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sketch of distinct messages against their exact number, with a message of its
    own for every event: within 10 %, six times the sketch's relative standard error."""
    logs = _logs(spark, sf_dir, "event_id")
    unique = logs.withColumn("Message", F.concat(F.col("event_id").cast("string"), "Message"))
    exact = summarize_logs(unique, ["Level"]).select("Level", "n_logs", F.col("n_messages").alias("exact"))
    sketch = summarize_logs(unique, ["Level"], approx=True).select("Level", F.col("n_messages").alias("estimate"))
    within = F.abs(F.col("estimate") - F.col("exact")) <= 0.1 * F.col("exact")
    return exact.join(sketch, "Level").select("Level", "n_logs", "exact", within.alias("within_bound"))


@_register(
    "log_volume",
    f"""
    SELECT {_text("date_trunc('hour', ts)")} AS window_start, event_type AS "Level", count(*) AS n_logs
    FROM events GROUP BY date_trunc('hour', ts), event_type
    """,
)
def log_volume_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(log_volume(_logs(spark, sf_dir)))


@_register("volume_stream", ORACLES["log_volume"])
def volume_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chart follows the table: the first days are stored and charted, then the rest;
    windows leave the state a day after their end."""
    logs, folder = _logs(spark, sf_dir), fresh_folder(spark, "volume")
    start, end = logs.agg(F.min("Timestamp").cast("timestamp_ntz"), F.max("Timestamp").cast("timestamp_ntz")).first()
    early = F.col("Timestamp") < F.lit(start + (end - start) / 2)
    for part in (early, ~early):
        write_logs(logs.where(part), f"{folder}/logs")
        rows = tail_logs(spark, f"{folder}/logs", start)
        start_volume(rows, f"{folder}/chart", f"{folder}/progress", delay="1 day", available_now=True).awaitTermination()
    return _shown(read_volume(spark, f"{folder}/chart"))


@_register(
    "routing_stream",
    f"""
    SELECT CASE WHEN "Level" = 'error' THEN 'alerts' WHEN "ResourceID" LIKE '%7' THEN 'sevens' ELSE 'rest' END AS route, *
    FROM ({_ROWS})
    """,
)
def routing_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads are fanned out to three stores, each a log table of its own."""
    logs, folder = _logs(spark, sf_dir), fresh_folder(spark, "routing")
    rules = [("alerts", F.col("Level") == "error"), ("sevens", F.col("ResourceID").endswith("7"))]
    start, early = _first_time(logs), F.col("Timestamp") < F.lit("2024-01-12").cast("timestamp_ntz")
    for part in (early, ~early):
        write_logs(logs.where(part), f"{folder}/logs")
        rows = tail_logs(spark, f"{folder}/logs", start)
        start_routing(rows, rules, f"{folder}/stores", f"{folder}/progress", "rest", available_now=True).awaitTermination()
    stores = [
        project_logs(read_logs(spark, route_store(f"{folder}/stores", route))).select(F.lit(route).alias("route"), "*")
        for route in ("alerts", "sevens", "rest")
    ]
    return _shown(reduce(DataFrame.unionAll, stores))


# One statement per kind of SQL, the same text for both engines but for the quotes
# around "Timestamp", which is a type name in one of them.
_STATEMENTS = {
    "sql_agg": """
        SELECT Level, count(*) AS n, count(DISTINCT ResourceID) AS resources,
               min(length(Message)) AS shortest, max(length(Message)) AS longest
        FROM logs GROUP BY Level""",
    "sql_rollup": """
        SELECT Level, ResourceID, count(*) AS n FROM logs GROUP BY ROLLUP (Level, ResourceID)""",
    "sql_cube": """
        SELECT Level, Message, count(*) AS n FROM logs GROUP BY CUBE (Level, Message)""",
    "sql_window": """
        SELECT ResourceID, Level, Message, newest FROM (
            SELECT ResourceID, Level, Message,
                   row_number() OVER (PARTITION BY ResourceID ORDER BY "Timestamp" DESC) AS newest
            FROM logs) ranked
        WHERE newest <= 2""",
    "sql_topk": """
        SELECT Message, count(*) AS n FROM logs GROUP BY Message ORDER BY n DESC, Message LIMIT 5""",
    "sql_join": """
        SELECT c.c_mktsegment AS segment, sum(l.n) AS n, count(*) AS resources
        FROM (SELECT ResourceID, count(*) AS n FROM logs WHERE Level = 'error' GROUP BY ResourceID) l
        JOIN customer c ON l.ResourceID = concat('user-', c.c_custkey)
        GROUP BY c.c_mktsegment""",
    "sql_semi_anti": """
        SELECT sum(l.n) AS n, count(*) AS resources
        FROM (SELECT ResourceID, count(*) AS n FROM logs GROUP BY ResourceID) l
        WHERE NOT EXISTS (
            SELECT 1 FROM customer
            WHERE concat('user-', c_custkey) = l.ResourceID AND c_mktsegment = 'FURNITURE')""",
    "sql_setops": """
        SELECT DISTINCT ResourceID FROM logs WHERE Level = 'error'
        EXCEPT
        SELECT DISTINCT ResourceID FROM logs WHERE Level = 'purchase' AND Message LIKE '%88%'""",
    "sql_scalar": """
        SELECT upper(Level) AS shouted, length(Message) AS size, substring(ResourceID, 6) AS suffix,
               extract(day FROM "Timestamp") AS day, count(*) AS n
        FROM logs GROUP BY 1, 2, 3, 4""",
    "sql_subquery": """
        SELECT Level, n FROM (SELECT Level, count(*) AS n FROM logs GROUP BY Level) counted
        WHERE n * 5 >= (SELECT count(*) FROM logs)""",
}


def _wide_integers(df: DataFrame) -> DataFrame:
    """Whole numbers in the width the SQL side gives them."""
    return df.select(*[(F.col(c).cast("bigint").alias(c) if t in ("int", "bigint") else F.col(c)) for c, t in df.dtypes])


def _statement_query(sql: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        register_logs(_logs(spark, sf_dir))
        _table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
        return _wide_integers(search_sql(spark, sql.strip().replace('"Timestamp"', "`Timestamp`")))

    return query


for _name, _sql in _STATEMENTS.items():
    _oracle = _sql.replace("FROM logs", f"FROM ({_LOGS}) logs").replace("sum(l.n)", "sum(l.n)::BIGINT")
    _register(_name, _oracle)(_statement_query(_sql))


@_register(
    "sql_json",
    f"""
    SELECT "Level", json_extract_string("Message", '$.k') AS k, count(*) AS n FROM ({_LOGS}) GROUP BY 1, 2
    """,
)
def sql_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_logs(_logs(spark, sf_dir))
    sql = "SELECT Level, get_json_object(Message, '$.k') AS k, count(*) AS n FROM logs GROUP BY 1, 2"
    return search_sql(spark, sql)


_FOUR_DAYS = """
    SELECT late.Level, late.ResourceID, count(*) AS n, min(late.Message) AS smallest
    FROM logs late JOIN (
        SELECT DISTINCT ResourceID FROM logs
        WHERE Level = 'error' AND "Timestamp" BETWEEN TIMESTAMP '2024-01-10 06:00:00' AND TIMESTAMP '2024-01-11 18:00:00') failed
    ON late.ResourceID = failed.ResourceID
    WHERE late."Timestamp" > TIMESTAMP '2024-01-11 18:00:00' AND CAST(late."Timestamp" AS DATE) <= DATE '2024-01-13'
    GROUP BY 1, 2"""


@_register("sql_stored_days", _FOUR_DAYS.replace("FROM logs", f"FROM ({_LOGS})"))
def sql_stored_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement over the stored table whose own conditions leave four of its days."""
    register_logs(read_logs(spark, _stored(spark, _logs(spark, sf_dir), "logs")))
    return search_sql(spark, _FOUR_DAYS.strip().replace('"Timestamp"', "`Timestamp`"))


# --- flagship ------------------------------------------------------------------------------

def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of a date range that mention a text, as JSON rows."""
    return to_json_rows(project_logs(filter_logs(_logs(spark, sf_dir), **_ALL_FILTERS)))
