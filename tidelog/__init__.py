"""Log ingestion, tailing and search on Spark."""

from tidelog.functions.readonly import NotReadOnlyError, assert_read_only, is_read_only, statement_is_read_only
from tidelog.operators.batching import arrival_micros, assign_batches, batch_sizes
from tidelog.operators.filters import between, filter_logs, from_date, latest, normalize_bound, since
from tidelog.operators.ingest import (
    extract_fields, ingest, normalize_timestamp, route_logs, split_rows, to_log_rows, validate,
)
from tidelog.operators.joins import asof_join, range_counts, range_join
from tidelog.operators.output import expanded_rows, export_logs, summary_rows, to_json_rows, write_logs, write_routed
from tidelog.operators.summaries import merged_summary, merged_top_messages, write_summaries
from tidelog.operators.summary import log_volume, summarize_logs, top_messages
from tidelog.operators.text_index import files_with, index_text, search_text
from tidelog.operators.tailing import next_cursor, tail_step
from tidelog.plans.search import SearchResult, register_logs, search, search_sql
from tidelog.session import get_session
from tidelog.sources.bodies import extract_plaintext, read_kafka_bodies, read_log_bodies
from tidelog.sources.table import (
    LOG_COLUMNS, LOG_SCHEMA, TABLE_CONFIG, conform, events_as_logs, project_logs, read_logs,
    read_quarantine, schema_from_config,
)
from tidelog.streaming.ingest_stream import start_ingest, start_stream_write
from tidelog.streaming.dedup_stream import dedup_stream, start_dedup, unseen_rows
from tidelog.streaming.derived import read_volume, route_store, start_routing, start_volume
from tidelog.streaming.sink import compact_days, replace_batch
from tidelog.streaming.tail_stream import days_from, flag_late, read_tail, start_tail, tail_logs
