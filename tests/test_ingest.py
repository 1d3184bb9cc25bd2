import pytest
from pyspark.sql import functions as F

from tidelog import extract_fields, extract_plaintext, ingest, route_logs, to_log_rows, validate, write_routed
from plan_text import plan_of

LEVELS = {
    '{"level":"x"}': "x",
    '{"level":null}': "",
    "{}": "",
    '{"Level":"x"}': "",
    '{"level":5}': "5",
    '{"level":5.10}': "5.1",
    '{"level":12345678901234567890123}': "12345678901234567890123",
    '{"level":1.0}': "1",
    '{"level":1e2}': "100",
    '{"level":-2.50E-3}': "-0.0025",
    '{"level":123456789.5}': "123456789.5",
    '{"level":0.0}': "0",
    '{"level":1e-20}': "0.00000000000000000001",
    '{"level":1.5E-19}': "0.00000000000000000015",
    '{"level":1e30}': "1" + "0" * 30,
    '{"level":95e20}': "95" + "0" * 20,
    '{"level":0.1}': "0.1",
    '{"level":-0.30000000000000004}': "-0.30000000000000004",
    '{"level":123456789012345678901234567890.5}': "123456789012345680000000000000",
    '{"level":1.0,"message":"1.0"}': "1",
    '{"message":1.0,"level":"1.0"}': "1.0",
    '{"level":"1\\u002e50"}': "1.50",
    '{"level":2.50,"x":"\t"}': "2.5",
    '{"level":"1.0"}': "1.0",
    '{"level":"1.0E2"}': "1.0E2",
    '{"level":"10.0.0.1"}': "10.0.0.1",
    '{"level":true}': "true",
    '{"level":{"a": 1}}': '{"a":1}',
    '{"level":[1, 2]}': "[1,2]",
    '{"level":"a","level":"b"}': "a",
    '{"level":null,"level":"b"}': "",
    '{"x":{"level":"inner"},"level":"outer"}': "outer",
    '{"a":1} trailing': "",
    '{"le\\u0076el":"escaped"}': "escaped",
    '{"level":"q\\"\\u00e9\\n"}': 'q"é\n',
    '{"a":"\t","level":"tab"}': "tab",
}
NO_OBJECT = ["not json", "", '{"level":"x"', '[{"level":"x"}]', '"text"', "5", "null", "{'level':'x'}"]


def fields(spark, bodies, **options):
    df = spark.createDataFrame([(b,) for b in bodies], "value string")
    return {r.value: r for r in extract_fields(df, **options).collect()}


def test_level_of_json_objects(spark):
    found = fields(spark, LEVELS)
    assert {body: row.Level for body, row in found.items()} == LEVELS
    assert {row.reason for row in found.values()} == {None}


def test_bodies_that_are_no_object(spark):
    quarantined = fields(spark, NO_OBJECT)
    assert {row.reason for row in quarantined.values()} == {"bad_json"}
    kept = fields(spark, NO_OBJECT, on_bad_json="empty")
    assert {(row.reason, row.Level, row.Message, row.ResourceID, row.time_text) for row in kept.values()} == {
        (None, "", "", "", "")
    }
    with pytest.raises(ValueError):
        fields(spark, NO_OBJECT, on_bad_json="drop")


def test_null_body(spark):
    assert extract_fields(spark.createDataFrame([(None,)], "value string")).first().reason == "bad_json"


def test_long_message_is_kept_whole(spark):
    message = "дом " * 50_000
    body = spark.createDataFrame([(message,)], "m string").select(F.to_json(F.struct(F.col("m").alias("message"))).alias("value"))
    assert extract_fields(body).first().Message == message


def test_ingest_splits_rows_and_keeps_all(spark):
    bodies = ['{"timestamp":"2024-01-01T00:00:00Z"}', '{"timestamp":"?"}', "junk"]
    accepted, rejected = ingest(spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "id int, value string"))
    assert accepted.columns == ["id", "Timestamp", "Level", "Message", "ResourceID"]
    assert [r.id for r in accepted.collect()] == [0]
    assert {(r.id, r.reason, r.body) for r in rejected.collect()} == {(1, "bad_timestamp", bodies[1]), (2, "bad_json", "junk")}


def test_each_body_is_parsed_once_and_without_python(spark, folder):
    spark.createDataFrame([("{}",)], "value string").write.text(folder)
    bodies = spark.read.text(folder)
    for frame in (ingest(bodies)[0], to_log_rows(bodies)):
        plan = plan_of(frame)
        # and once more for bodies with a number that may need other digits
        assert plan.count("from_json(MapType(StringType,StringType") == 1
        assert plan.count("from_json(MapType(StringType,VariantType") == 1
        assert "Python" not in plan


def test_plaintext(spark):
    lines = ["2024-01-01T00:00:00Z ERROR db-1: disk full: /var", "no match"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    found = extract_plaintext(df, r"^(\S+) (\w+) (\S+): (.*)$", {"timestamp": 1, "level": 2, "resourceID": 3, "message": 4})
    first, second = found.collect()
    assert (first.time_text, first.Level, first.ResourceID, first.Message, first.reason) == (
        "2024-01-01T00:00:00Z", "ERROR", "db-1", "disk full: /var", None)
    assert (second.Message, second.reason) == ("", "no_match")


def test_validate_names_the_first_broken_rule(spark):
    df = spark.createDataFrame([("error", "a"), ("", "b"), ("", ""), (None, "x")], "Level string, Message string")
    rules = {"level": F.col("Level") != "", "message": F.length("Message") > 0}
    assert [r.reason for r in validate(df, rules).collect()] == [None, "level", "level", "level"]


def test_route_takes_the_first_rule(spark, folder):
    df = spark.createDataFrame([("error", "a"), ("info", "a"), ("info", "b"), (None, "c")], "Level string, Message string")
    routed = route_logs(df, [("alerts", F.col("Level") == "error"), ("a", F.col("Message") == "a")], "rest")
    assert [r.route for r in routed.collect()] == ["alerts", "a", "rest", "rest"]
    write_routed(routed, folder)
    assert spark.read.parquet(f"{folder}/route=alerts").count() == 1
    assert spark.read.parquet(folder).groupBy("route").count().count() == 3
