"""RFC 3339 parsing, timestamp text and search bounds, as built-in expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F
from pyspark.sql.types import DataType, TimestampNTZType

# The accepted RFC 3339 shape, the timestamp that stands for an
# unreadable one, and the text formats of the log table and the dashboard.
RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{1,2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:\d{2})\z"
ZERO_TIME_MICROS = -62135596800000000  # 0001-01-01 00:00:00 UTC
MICROS_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
DISPLAY_FORMAT = "M/d/yyyy, h:mm:ss a"


def rfc3339_to_timestamp(text: Column) -> Column:
    """UTC instant with microseconds, digits beyond them cut off; NULL when unreadable.

    A plain cast is laxer than RFC 3339 (date only, no zone, padding), hence the
    guard. Offsets beyond 18 hours are legal in the log format but not in a cast,
    so those rare rows are shifted by arithmetic instead.
    """
    dotted = F.replace(text, F.lit(","), F.lit("."))
    head = F.substring(dotted, F.lit(1), F.length(dotted) - 6)
    hours = F.substring(dotted, -5, 2).try_cast("int")
    minutes = F.substring(dotted, -2, 2).try_cast("int")
    sign = F.when(F.substring(dotted, -6, 1) == "-", 1).otherwise(-1)
    shifted = F.when(
        ~dotted.endswith("Z") & (hours <= 24) & (minutes <= 60),
        F.timestamp_add("MINUTE", sign * (hours * 60 + minutes), F.concat(head, F.lit("Z")).try_cast("timestamp")),
    )
    return F.when(text.rlike(RFC3339), F.coalesce(dotted.try_cast("timestamp"), shifted))


def zero_time() -> Column:
    return F.timestamp_micros(F.lit(ZERO_TIME_MICROS))


def micros_text(ts: Column) -> Column:
    return F.date_format(ts, MICROS_FORMAT)


def display_text(ts: Column, tz: str = "UTC", pattern: str = DISPLAY_FORMAT) -> Column:
    """Timestamp as the dashboard shows it. The dashboard reads the UTC text as wall
    time, so ``tz='UTC'`` gives the same digits; another zone converts first."""
    return F.date_format(ts if tz == "UTC" else F.from_utc_timestamp(ts, tz), pattern)


def local_to_utc_second(local: Column, tz: str) -> Column:
    """Local date-time of a form field to the UTC second; NULL or '' gives ''."""
    utc = F.to_utc_timestamp(local.try_cast("timestamp"), tz)
    return F.coalesce(F.date_format(F.date_trunc("second", utc), "yyyy-MM-dd HH:mm:ss"), F.lit(""))


def parse_bound(value: str | dt.datetime | dt.date) -> dt.datetime:
    """Bound given by a caller to a naive UTC datetime."""
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value.strip())
    elif not isinstance(value, dt.datetime):
        value = dt.datetime(value.year, value.month, value.day)
    if value.tzinfo is not None:
        value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return value


def bound_literal(value: dt.datetime, type_: DataType) -> Column:
    """Literal of the column's own type, so that the comparison reaches the scan."""
    text = value.isoformat(sep=" ", timespec="microseconds")
    if isinstance(type_, TimestampNTZType):
        return F.lit(text).cast("timestamp_ntz")
    return F.lit(text + "Z").cast("timestamp")
