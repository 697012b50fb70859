"""Questions in bulk against the answer to one question after the other."""

from pyspark.sql import functions as F

from stintline.operators import chat, lap_query, routing

SESSIONS = [("24Q", 2024, "Italian", "Q"), ("23Q", 2023, "Italian", "Q"), ("24R", 2024, "Italian", "Race"), ("24M", 2024, "Monaco", "Race")]
TALK = [
    (1, "a", "compare VER vs HAM in qualifying at Monza"), (2, "a", "are you sure?"), (3, "a", "and lap 2?"), (4, "a", "Does rain matter?"), (5, "b", "are you sure?"),
    (6, "b", "compare VER vs NOR"), (7, "b", "fastest lap in the race at Monaco 2024"), (8, "b", "compare VER vs ALO"), (9, "c", "compare the average race pace of VER vs HAM in the race at Monza 2024"),
    (10, "c", "fastest lap of Verstappen in qualifying at Monza 2023"), (11, "c", "fastest lap at Spa"), (12, "d", None), (13, "d", "lap 1 of the race at Monza"), (14, "d", "lap 3?"),
]


def tables(spark):
    rows = [(s, d, n, 80.0 + k * 0.5 + n * 0.25 - (1 if n == 3 else 0) + (40 if d == "ALO" else 0), 25.0 + k, 30.0, 25.0 + n, 1) for s, *_ in SESSIONS for k, d in enumerate(("VER", "HAM", "NOR", "ALO")) for n in (1, 2, 3) if (s, d) != ("24M", "NOR")]
    laps = spark.createDataFrame(rows, "session_id string, driver string, lap_number int, lap_time double, sector1 double, sector2 double, sector3 double, is_valid int")
    return laps, spark.createDataFrame(SESSIONS, "id string, season int, circuit string, session_type string")


def test_agrees_with_one_question_at_a_time(spark):
    laps, sessions = tables(spark)
    messages = spark.createDataFrame(TALK, "id long, sid string, text string")
    got = {r["id"]: r for r in routing.answered(messages, laps, sessions).collect()}
    assert len(got) == len(TALK)
    last = {}
    for i, sid, text in TALK:
        if text is None:
            assert got[i]["source"] == "model_knowledge"
            continue
        one = chat.reply(spark, text, laps, sessions, last.get(sid))
        if one.answer is not None:
            last[sid] = one.intent
            assert got[i]["session_id"] == one.answer.session_id and (got[i]["branch"] or "") == one.answer.branch
            if one.answer.rows is not None and got[i]["source"] == "stored_valid":
                want = sorted((r["driver"], r["lap_time"], round(r["delta1"], 6)) for r in one.answer.rows.collect())
                assert sorted((r["driver"], r["lap_time"], round(r["delta1"], 6)) for r in got[i]["rows"]) == want
        assert got[i]["mode"] == one.mode, text
        if one.answer is not None and one.answer.rejection is None and got[i]["rejection"] is None:
            assert got[i]["source"] == one.source


def test_sources_and_rejections(spark):
    laps, sessions = tables(spark)
    got = {r["id"]: r for r in routing.answered(spark.createDataFrame(TALK, "id long, sid string, text string"), laps, sessions).collect()}
    assert (got[1]["source"], got[1]["session_id"], [r["driver"] for r in got[1]["rows"]]) == ("stored_valid", "24Q", ["VER", "HAM"])
    assert got[2]["rows"] == got[1]["rows"] and got[3]["branch"] == "lap_n" and got[3]["rows"][0]["lap_number"] == 2
    assert got[4]["source"] == "model_knowledge"
    assert (got[5]["mode"], got[5]["source"]) == ("telemetry", "no_data_found")  # doubts, but no circuit is known
    assert (got[6]["mode"], got[6]["source"]) == ("general", "model_knowledge")
    assert got[7]["session_id"] == "24M" and got[7]["source"] == "stored_valid" and [r["driver"] for r in got[7]["rows"]] == ["VER", "HAM", "ALO"]
    assert got[8]["rejection"] is None and got[8]["source"] == "stored_valid"
    assert got[9]["branch"] == "avg_lap" and got[9]["rows"][0]["lap_number"] is None
    assert got[10]["session_id"] == "23Q"
    assert (got[11]["source"], got[11]["rejection"]) == ("data_unavailable", routing.UNAVAILABLE)
    assert got[13]["source"] == "no_data_found"  # a race's first lap is none


def test_bounds_missing_equal_and_close(spark):
    laps, sessions = tables(spark)
    odd = laps.withColumn("lap_time", F.when((F.col("driver") == "HAM") & (F.col("session_id") == "24Q"), F.col("lap_time") - 0.5 + 0.01).otherwise(F.col("lap_time")))
    odd = odd.withColumn("sector2", F.when(F.col("driver") == "NOR", 70.0).otherwise(F.col("sector2")))
    asked = [(1, "a", "compare VER vs HAM in qualifying at Monza"), (2, "b", "compare VER vs GAS in qualifying at Monza"), (3, "c", "compare VER vs NOR in qualifying at Monza"), (4, "d", "compare VER vs HAM, lap 2 of the race at Monza"), (5, "e", "fastest lap of GAS vs BOT at Monaco")]
    got = {r["id"]: (r["source"], r["rejection"]) for r in routing.answered(spark.createDataFrame(asked, "id long, sid string, text string"), odd, sessions).collect()}
    assert got == {1: ("data_unavailable", lap_query.SUSPECT), 2: ("data_unavailable", lap_query.MISSING), 3: ("data_unavailable", routing.IMPLAUSIBLE), 4: ("stored_valid", None), 5: ("no_data_found", None)}


def test_no_messages(spark):
    laps, sessions = tables(spark)
    assert routing.answered(spark.createDataFrame([], "id long, sid string, text string"), laps, sessions).collect() == []
