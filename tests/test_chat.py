"""From a question to an answer, and the upkeep of the corner map."""

import pytest
from pyspark.sql import functions as F

from stintline.functions import text as X
from stintline.operators import chat, corner_map


@pytest.fixture(scope="module")
def data(spark):
    sessions = spark.createDataFrame([("s", 2024, "Italian", "Q")], "id string, season int, circuit string, session_type string")
    laps = spark.createDataFrame([("s", d, n, t, 25.0, 30.0, t - 55, 1) for d, n, t in (("VER", 1, 80.0), ("HAM", 1, 81.0))], "session_id string, driver string, lap_number int, lap_time double, sector1 double, sector2 double, sector3 double, is_valid int")
    return laps, sessions


def test_reply(spark, data):
    first = chat.reply(spark, "compare VER vs HAM in qualifying at Monza 2024", *data)
    assert first.source == "stored_valid" and {r["driver"] for r in first.answer.rows.collect()} == {"VER", "HAM"} and first.answer.rejection is None
    again = chat.reply(spark, "are you sure?", *data, last=first.intent)
    assert again.mode == "telemetry" and again.intent["drivers"] == ["VER", "HAM"] and again.answer.session_id == "s"
    assert chat.reply(spark, "are you sure?", *data).text == chat.CLARIFY
    assert chat.reply(spark, "should we box?", *data).mode == "general"
    assert chat.reply(spark, "fastest lap at Spa in qualifying", *data).source == "data_unavailable"


def test_corner_map(spark):
    corners = spark.createDataFrame([("A", 1, 10.0), ("A", 2, None), ("B", 1, None)], "circuit string, corner_number int, distance_from_start double")
    sessions = spark.createDataFrame([("1", 2023, "B", "Q"), ("2", 2024, "B", "Race"), ("3", 2024, "B", "Q"), ("4", 2024, "A", "Q")], "id string, season int, circuit string, session_type string")
    assert [r["id"] for r in corner_map.map_sources(sessions, corners).collect()] == ["3"]
    assert {r["circuit"] for r in corner_map.without_empty(corners).collect()} == {"A"}
    fresh = spark.createDataFrame([("B", 7, 5.0)], corners.schema)
    assert {(r["circuit"], r["corner_number"]) for r in corner_map.replace_map(corners, fresh).collect()} == {("A", 1), ("A", 2), ("B", 7)}
    stats = spark.createDataFrame([("A", 3), ("A", 1), ("B", 1), ("C", 1)], "circuit string, corner_number int")
    assert {r["circuit"] for r in corner_map.without_stale(stats, corners).collect()} == {"B"}


def test_responses(spark):
    df = spark.createDataFrame([(' "quoted \\"x\\"" ',), ("'a'",), ("plain",)], "t string")
    assert [r["v"] for r in df.select(X.clean_response(F.col("t")).alias("v")).collect()] == ['quoted "x"', "a", "plain"]
    js = spark.createDataFrame([('```json\n{"user":"u"}\n```',), ('x {"user":"v"} y',), ("none",)], "t string")
    assert [r["v"] and r["v"]["user"] for r in js.select(X.recovered_json(F.col("t"), "user STRING").alias("v")).collect()] == ["u", "v", None]
