"""Sources of raw log bodies: one DataFrame column ``value``, one body per row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidelog.functions.json_fields import FIELD_COLUMNS

# The file source skips files much older than the newest one unless told otherwise.
ANY_AGE = "36500d"
BATCH_BYTES = 64 << 30


def read_log_bodies(
    spark: SparkSession,
    path: str,
    streaming: bool = False,
    **options,
) -> DataFrame:
    """Text files with one body per line, as a batch or as a stream. ``options`` go to
    the file source: ``wholetext=True`` takes a file as one body. A stream takes files of
    any age, and so many bytes per micro-batch that a backlog comes in pieces; what is
    beyond them waits.
    """
    if not streaming:
        return spark.read.format("text").options(**options).load(path)
    usual = {"maxFileAge": ANY_AGE}
    if "maxFilesPerTrigger" not in options:
        usual["maxBytesPerTrigger"] = BATCH_BYTES
    return spark.readStream.format("text").options(**usual | options).load(path)


def read_kafka_bodies(spark: SparkSession, servers: str, topic: str, streaming: bool = True) -> DataFrame:
    """Bodies from a Kafka topic. Needs the Kafka connector on the class path."""
    reader = (spark.readStream if streaming else spark.read).format("kafka")
    return (
        reader.option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .load()
        .select(F.col("value").cast("string").alias("value"))
    )


def extract_plaintext(df: DataFrame, pattern: str, groups: dict[str, int], body: str = "value") -> DataFrame:
    """Fields of plain text lines by a caller's pattern: ``groups`` maps each of
    timestamp, level, message and resourceID to a group of the pattern. The columns are
    those of JSON bodies. A line that does not match gets empty fields and a reason."""
    text = F.col(body)
    fields = [
        (F.regexp_extract(text, pattern, groups[key]) if key in groups else F.lit("")).alias(column)
        for key, column in FIELD_COLUMNS.items()
    ]
    reason = F.when(~F.coalesce(text, F.lit("")).rlike(pattern), F.lit("no_match")).alias("reason")
    return df.select("*", *fields, reason)
