import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidelog import ingest, normalize_bound, normalize_timestamp
from tidelog.functions.timestamps import micros_text, parse_bound

GOOD = {
    "2023-05-18T15:23:42Z": "2023-05-18 15:23:42.000000",
    "2023-05-18T15:23:42.123456789Z": "2023-05-18 15:23:42.123456",
    "2023-05-18T15:23:42.9999999Z": "2023-05-18 15:23:42.999999",
    "2023-05-18T15:23:42+05:30": "2023-05-18 09:53:42.000000",
    "2023-05-18T15:23:42-00:00": "2023-05-18 15:23:42.000000",
    "2023-05-18T5:23:42Z": "2023-05-18 05:23:42.000000",
    "2023-05-18T15:23:42,5Z": "2023-05-18 15:23:42.500000",
    "2023-05-18T15:23:42,25+01:00": "2023-05-18 14:23:42.250000",
    # offsets a cast does not take
    "2023-05-18T15:23:42+19:00": "2023-05-17 20:23:42.000000",
    "2023-05-18T15:23:42.5-23:59": "2023-05-19 15:22:42.500000",
    "2023-05-18T15:23:42+24:00": "2023-05-17 15:23:42.000000",
    "2023-05-18T15:23:42+05:60": "2023-05-18 09:23:42.000000",
    "2024-02-29T00:00:00Z": "2024-02-29 00:00:00.000000",
}
BAD = [
    "2023-05-18T15:23:42+0530", "2023-05-18 15:23:42", "2023-05-18", "2023-05-18T15:23:42",
    " 2023-05-18T15:23:42Z ", "2023-05-18T15:23:42Z\n", "2023-05-18t15:23:42z", "2023-02-30T00:00:00Z",
    "2023-05-18T24:00:00Z", "2023-05-18T15:23:60Z", "2023-05-18T15:23:42+25:00", "2023-05-18T15:23:42+05:61",
    "2023-05-18T15:23:42.Z", "2023-05-18T15:23:42 UTC", "bad", "",
]


def parsed(spark, texts, policy="null"):
    df = spark.createDataFrame([(t,) for t in texts], "time_text string")
    rows = normalize_timestamp(df, on_bad_ts=policy)
    return {r.time_text: r for r in rows.withColumn("Timestamp", micros_text(F.col("Timestamp"))).collect()}


def test_legal_spellings(spark):
    found = parsed(spark, GOOD)
    assert {text: row.Timestamp for text, row in found.items()} == GOOD


def test_random_instants_in_random_zones(spark):
    rng = random.Random(11)
    expected = {}
    for _ in range(400):
        local = dt.datetime(1970, 1, 2) + dt.timedelta(microseconds=rng.randrange(10**17))
        minutes = rng.randrange(-24 * 60, 24 * 60 + 1)
        digits = rng.choice([0, 1, 3, 6, 9])
        fraction = (f"{local.microsecond:06d}" + f"{rng.randrange(1000):03d}")[:digits]
        zone = "Z" if minutes == 0 else f"{'-' if minutes < 0 else '+'}{abs(minutes) // 60:02d}:{abs(minutes) % 60:02d}"
        kept = int(fraction[:6].ljust(6, "0")) if fraction else 0
        text = f"{local:%Y-%m-%dT%H:%M:%S}" + (rng.choice(".,") + fraction if fraction else "") + zone
        utc = local.replace(microsecond=kept) - dt.timedelta(minutes=minutes)
        expected[text] = f"{utc:%Y-%m-%d %H:%M:%S.%f}"
    assert {text: row.Timestamp for text, row in parsed(spark, expected).items()} == expected


def test_illegal_spellings_are_null(spark):
    assert [t for t, row in parsed(spark, BAD).items() if row.Timestamp is not None] == []


def test_bad_timestamp_policies(spark):
    zero = parsed(spark, BAD, "zero")
    assert {row.Timestamp for row in zero.values()} == {"0001-01-01 00:00:00.000000"}
    assert {row.reason for row in zero.values()} == {None}
    assert {row.reason for row in parsed(spark, BAD, "quarantine").values()} == {"bad_timestamp"}
    assert {row.reason for row in parsed(spark, GOOD, "quarantine").values()} == {None}
    with pytest.raises(ValueError):
        parsed(spark, BAD, "drop")


def test_null_text_is_bad(spark):
    df = spark.createDataFrame([(None,)], "time_text string")
    assert normalize_timestamp(df).first().reason == "bad_timestamp"


def test_load_script_body(spark):
    body = '{"timestamp": "2024-05-18T15:23:42.000123Z", "level": "warning", "message": "Test Message 1", "resourceID": "server-1234"}'
    accepted, rejected = ingest(spark.createDataFrame([(body,)], "value string"))
    row = accepted.withColumn("Timestamp", micros_text(F.col("Timestamp"))).first()
    assert tuple(row) == ("2024-05-18 15:23:42.000123", "warning", "Test Message 1", "server-1234")
    assert rejected.count() == 0


def test_parse_bound():
    assert parse_bound("2024-01-02 03:04:05") == dt.datetime(2024, 1, 2, 3, 4, 5)
    assert parse_bound("2024-01-02") == dt.datetime(2024, 1, 2)
    assert parse_bound(dt.date(2024, 1, 2)) == dt.datetime(2024, 1, 2)
    assert parse_bound("2024-01-02T03:04:05+02:00") == dt.datetime(2024, 1, 2, 1, 4, 5)
    with pytest.raises(ValueError):
        parse_bound("yesterday")


def test_normalize_bound(spark):
    df = spark.createDataFrame([("2024-07-01T10:00:30.9",), ("",), (None,)], "typed string")
    found = [r[0] for r in df.select(normalize_bound("typed", "America/New_York")).collect()]
    assert found == ["2024-07-01 14:00:30", "", ""]
