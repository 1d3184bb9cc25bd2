"""The log table: declared schema, reading, and the adapter for event tables."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import (
    BooleanType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegerType,
    LongType, StringType, StructField, StructType, TimestampType,
)

from tidelog.session import path_exists, require_utc

# The declared log table.
TABLE_CONFIG = {
    "tableName": "logs",
    "columns": [
        {"name": "Timestamp", "type": "DateTime64(6)"},
        {"name": "Level", "type": "String"},
        {"name": "Message", "type": "String"},
        {"name": "ResourceID", "type": "String"},
    ],
}
LOG_COLUMNS = tuple(column["name"] for column in TABLE_CONFIG["columns"])

_TYPES: dict[str, DataType] = {
    "String": StringType(),
    "DateTime": TimestampType(),
    "DateTime64": TimestampType(),
    "Date": DateType(),
    "Bool": BooleanType(),
    "Int32": IntegerType(),
    "Int64": LongType(),
    "Float32": FloatType(),
    "Float64": DoubleType(),
}


def _column_type(declared: str) -> tuple[DataType, bool]:
    nullable = re.fullmatch(r"Nullable\((.+)\)", declared.strip())
    name = (nullable.group(1) if nullable else declared).strip()
    decimal = re.fullmatch(r"Decimal\((\d+)\s*,\s*(\d+)\)", name)
    if decimal:
        return DecimalType(int(decimal.group(1)), int(decimal.group(2))), bool(nullable)
    base = name.split("(")[0]
    if base not in _TYPES:
        raise ValueError(f"unknown column type {declared!r}")
    return _TYPES[base], bool(nullable)


def schema_from_config(config: str | dict) -> StructType:
    """Table schema of a JSON document with ``columns: [{name, type}]``."""
    document = json.loads(config) if isinstance(config, str) else config
    fields = []
    for column in document["columns"]:
        type_, nullable = _column_type(column["type"])
        fields.append(StructField(column["name"], type_, nullable))
    return StructType(fields)


LOG_SCHEMA = schema_from_config(TABLE_CONFIG)


def conform(df: DataFrame, schema: StructType = LOG_SCHEMA) -> DataFrame:
    """Columns of ``schema`` by name, in its order and types. A missing or null text
    column that is not nullable becomes '', as the table stores it."""
    columns = []
    for field in schema.fields:
        value = F.col(field.name) if field.name in df.columns else F.lit(None)
        value = value.try_cast(field.dataType)
        if isinstance(field.dataType, StringType) and not field.nullable:
            value = F.coalesce(value, F.lit(""))
        columns.append(value.alias(field.name))
    return df.select(*columns)


# Storage layout: rows lie below status=ok/log_date=YYYY-MM-DD, quarantined bodies
# below status=quarantine, written in one commit by the same job; below both lie the
# batches that wrote them, so that a batch that comes again replaces itself.
STATUS, DATE, BATCH = "status", "log_date", "batch"
OK, QUARANTINE = "ok", "quarantine"

# Column of the sender's own key of a row, as JSON text, where there is one.
KEY = "event_key"
STORED_SCHEMA = StructType(
    [StructField(field.name, field.dataType, True) for field in LOG_SCHEMA.fields]
    + [
        StructField("reason", StringType(), True),
        StructField("body", StringType(), True),
        StructField(KEY, StringType(), True),
        StructField(STATUS, StringType(), True),
        StructField(DATE, DateType(), True),
        StructField(BATCH, StringType(), True),
    ]
)


def is_log_table(spark: SparkSession, path: str) -> bool:
    """Whether the folder has the layout of a log table; batch and streaming writes fill
    the same one."""
    return any(path_exists(spark, f"{path.rstrip('/')}/{STATUS}={status}") for status in (OK, QUARANTINE))


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Scan of a log table: the four columns and the partition column ``log_date``, which
    the filters use to skip whole days. A folder of other parquet files with the four
    columns is read as it is."""
    require_utc(spark)
    if not is_log_table(spark, path):
        return conform(spark.read.parquet(path))
    stored = spark.read.schema(STORED_SCHEMA).parquet(path)
    return stored.where(F.col(STATUS) == OK).select(*LOG_COLUMNS, DATE)


def read_quarantine(spark: SparkSession, path: str) -> DataFrame:
    """What was not accepted: the reason, the raw body if there was one, and the fields
    as far as they could be read."""
    stored = spark.read.schema(STORED_SCHEMA).parquet(path)
    return stored.where(F.col(STATUS) == QUARANTINE).select("body", "reason", *LOG_COLUMNS)


def project_logs(df: DataFrame) -> DataFrame:
    """The four declared columns, which is what every search returns."""
    return df.select(*LOG_COLUMNS)


def events_as_logs(events: DataFrame, *extra: str) -> DataFrame:
    """An event table seen as logs. ``ts`` keeps its type, so that time filters on
    the log column are still pushed to the scan of the events."""
    return events.select(
        F.col("ts").alias("Timestamp"),
        F.col("event_type").alias("Level"),
        F.col("props").alias("Message"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("ResourceID"),
        *extra,
    )
