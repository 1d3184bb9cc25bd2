"""From raw bodies to rows of the log table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from tidelog.functions.json_fields import (
    FIELD_COLUMNS, TIME_TEXT, body_field, looks_fractional, parse_body, parse_tokens, plain_number,
)
from tidelog.functions.timestamps import rfc3339_to_timestamp, zero_time
from tidelog.sources.table import LOG_COLUMNS

REASON = "reason"


def _check(name: str, value: str, allowed: Sequence[str]) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}, not {value!r}")


def _with_step(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed in a step of its own. A plain column would be
    computed again by every filter on it, as filters are pushed below projections but
    not below a generator."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def extract_fields(df: DataFrame, body: str = "value", on_bad_json: str = "quarantine") -> DataFrame:
    """Adds the four text fields (the time as ``time_text``) and ``reason``. A body that
    is no JSON object has empty fields; ``on_bad_json='empty'`` keeps it as such a row, as
    the log store always did, ``'quarantine'`` gives it a reason."""
    _check("on_bad_json", on_bad_json, ("quarantine", "empty"))
    staged = _with_step(df, "_parsed", parse_body(F.col(body)))
    parsed = F.col("_parsed")
    fields = [body_field(parsed, key).alias(column) for key, column in FIELD_COLUMNS.items()]
    bad = F.when(parsed.isNull(), F.lit("bad_json")) if on_bad_json == "quarantine" else F.lit(None)
    rows = staged.select(*[F.col(c) for c in df.columns], *fields, bad.cast("string").alias(REASON))
    texts = {key: column for key, column in FIELD_COLUMNS.items() if column != TIME_TEXT}
    # few bodies hold such a number; only those are parsed again for their tokens
    numbers = reduce(or_, [looks_fractional(F.col(column)) for column in texts.values()])
    rows = _with_step(rows, "_tokens", F.when(numbers, parse_tokens(F.col(body))))
    plain = {column: plain_number(F.col(column), F.col("_tokens")[key]) for key, column in texts.items()}
    return rows.withColumns(plain).drop("_tokens")


def normalize_timestamp(df: DataFrame, col: str = TIME_TEXT, on_bad_ts: str = "quarantine") -> DataFrame:
    """Adds ``Timestamp``, the UTC instant of the text column ``col``. What an
    unreadable text gives: a reason (``'quarantine'``), year one (``'zero'``, as the
    log store always did) or NULL (``'null'``)."""
    _check("on_bad_ts", on_bad_ts, ("quarantine", "zero", "null"))
    if REASON not in df.columns:
        df = df.withColumn(REASON, F.lit(None).cast("string"))
    timed = _with_step(df, "Timestamp", rfc3339_to_timestamp(F.col(col)))
    if on_bad_ts == "quarantine":
        unreadable = F.when(F.col("Timestamp").isNull(), F.lit("bad_timestamp"))
        return timed.withColumn(REASON, F.coalesce(F.col(REASON), unreadable))
    if on_bad_ts == "zero":
        return timed.withColumn("Timestamp", F.coalesce(F.col("Timestamp"), zero_time()))
    return timed


def validate(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Gives every row that breaks a rule the name of the first one it breaks. A rule
    is a condition that valid rows fulfil; NULL counts as broken."""
    broken = [F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]
    reason = [F.col(REASON)] if REASON in df.columns else []
    return df.withColumn(REASON, F.coalesce(*reason, *broken, F.lit(None).cast("string")))


def to_log_rows(
    df: DataFrame,
    body: str = "value",
    on_bad_json: str = "quarantine",
    on_bad_ts: str = "quarantine",
) -> DataFrame:
    """Bodies to log columns plus ``reason`` and, where there is a reason, ``body``."""
    extra = [c for c in df.columns if c != body]
    rows = normalize_timestamp(extract_fields(df, body, on_bad_json), TIME_TEXT, on_bad_ts)
    return rows.select(
        *extra,
        *LOG_COLUMNS,
        REASON,
        F.when(F.col(REASON).isNotNull(), F.col(body)).alias("body"),
    )


def split_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows without the reason, and the others with it."""
    accepted = rows.where(F.col(REASON).isNull()).drop(REASON, "body")
    return accepted, rows.where(F.col(REASON).isNotNull())


def ingest(df: DataFrame, body: str = "value", on_bad_json: str = "quarantine", on_bad_ts: str = "quarantine"):
    """Batch ingest: ``(log rows, quarantined bodies with their reason)``."""
    accepted, rejected = split_rows(to_log_rows(df, body, on_bad_json, on_bad_ts))
    return accepted, rejected.drop(*LOG_COLUMNS)


def route_logs(df: DataFrame, rules: Sequence[tuple[str, Column]], default: str = "default") -> DataFrame:
    """Adds ``route``: the name of the first rule a row fulfils."""
    route = F.lit(default)
    for name, rule in reversed(list(rules)):
        route = F.when(F.coalesce(rule, F.lit(False)), F.lit(name)).otherwise(route)
    return df.withColumn("route", route)
