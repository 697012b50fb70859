"""Cleaning, resampling and the lap query."""

import datetime as dt

import numpy as np
import pytest

from stintline.operators import cleaning, lap_query


def test_clean_laps(spark):
    s = dt.timedelta(seconds=80)
    base = {"LapTime": s, "Sector1Time": s, "Sector2Time": s, "Sector3Time": s, "PitOutTime": None, "PitInTime": None, "TrackStatus": "1", "Deleted": False}
    changes = [{}, {"Sector2Time": None}, {"PitInTime": s}, {"PitOutTime": s}, {"TrackStatus": "4"}, {"TrackStatus": "26"}, {"TrackStatus": None}, {"Deleted": True}, {"Deleted": None}, {"TrackStatus": "2"}]
    schema = "n int, LapTime interval day to second, Sector1Time interval day to second, Sector2Time interval day to second, Sector3Time interval day to second, PitOutTime interval day to second, PitInTime interval day to second, TrackStatus string, Deleted boolean"
    df = spark.createDataFrame([(i, *(base | c).values()) for i, c in enumerate(changes)], schema)
    kept = lambda d: {r["n"] for r in d.select("n").collect()}
    assert kept(cleaning.clean_laps(df)) == {0, 6, 8, 9}
    assert kept(cleaning.clean_laps(df, drop_null_status=True)) == {0, 8, 9}
    assert kept(cleaning.clean_laps(df.drop("TrackStatus", "Deleted"))) == {0, 4, 5, 6, 7, 8, 9}
    assert df.select(cleaning.seconds(df, "LapTime").alias("s")).first()["s"] == 80.0


def test_resample_matches_numpy(spark):
    d = [3.0, 40.0, 90.0, 151.0, 260.0]
    speed = [None, 100.0, 150.0, None, 90.0]
    gear = [1.0, 2.0, 5.0, 4.0, 4.0]
    rows = [("a", i, x, v, g) for i, (x, v, g) in enumerate(zip(d, speed, gear))] + [("b", 0, 1.0, 1.0, 1.0), ("c", 0, float("nan"), 1.0, 1.0)]
    df = spark.createDataFrame(rows, "lap_id string, i int, Distance double, Speed double, nGear double")
    got = cleaning.resample(df, {"Speed": "speed", "Throttle": "throttle", "nGear": "gear"}).orderBy("distance").collect()
    grid = np.arange(0.0, d[-1], 50.0)
    filled = [100.0, 100.0, 150.0, 150.0, 90.0]
    assert [r["distance"] for r in got] == grid.tolist() and {r["lap_id"] for r in got} == {"a"}
    assert [r["speed"] for r in got] == pytest.approx(np.interp(grid, d, filled).tolist())
    assert [r["gear"] for r in got] == np.round(np.interp(grid, d, gear)).astype(int).tolist() and {r["throttle"] for r in got} == {0.0}


@pytest.fixture(scope="module")
def data(spark):
    sessions = spark.createDataFrame([("2023|A|Q", 2023, "A", "Q"), ("2024|A|Q", 2024, "A", "Q"), ("2024|A|Race", 2024, "A", "Race")], "id string, season int, circuit string, session_type string")
    rows = [("2024|A|Q", "X", 1, 80.0), ("2024|A|Q", "X", 2, 80.0), ("2024|A|Q", "Y", 1, 80.04), ("2024|A|Q", "Z", 1, 82.0), ("2024|A|Race", "X", 1, 70.0), ("2024|A|Race", "X", 2, 90.0), ("2024|A|Race", "Y", 3, 90.0), ("2024|A|Race", "Y", 4, 0.0)]
    laps = spark.createDataFrame([(s, d, n, t, 25.0, 30.0, t - 55, 1) for s, d, n, t in rows], "session_id string, driver string, lap_number int, lap_time double, sector1 double, sector2 double, sector3 double, is_valid int")
    return laps, sessions


def ask(data, **intent):
    return lap_query.answer({"circuit": "A", **intent}, *data)


def test_fastest_lap(data):
    out = ask(data, session="Q")
    assert out.session_id == "2024|A|Q" and out.branch == "fastest_per_driver"
    assert {(r["driver"], r["lap_number"], r["lap_time"]) for r in out.rows.collect()} == {("X", 1, 80.0), ("Y", 1, 80.04), ("Z", 1, 82.0)}
    race = {(r["driver"], r["lap_number"]) for r in ask(data).rows.collect()}
    assert race == {("X", 2), ("Y", 3)}  # no first lap, no zero time


def test_numbered_and_average(data):
    assert ask(data, lap_number=1).source == "no_data_found"
    assert {r["driver"] for r in ask(data, lap_number=2, session="Q").rows.collect()} == {"X"}
    mean = ask(data, wants_average=True, session="Q")
    assert mean.branch == "avg_lap" and {r["driver"]: r["delta3"] for r in mean.rows.collect()}["X"] == pytest.approx(25 - (25 + 25.04 + 27) / 3)


def test_two_driver_checks(data):
    assert ask(data, session="Q", drivers=["X", "Y"]).rejection == lap_query.SUSPECT
    assert ask(data, session="Q", drivers=["X", "Z"]).rejection is None
    assert ask(data, session="Q", drivers=["X", "N"]).rejection == lap_query.MISSING
    assert ask(data, drivers=["X", "Y"]).rejection == lap_query.IDENTICAL


def test_missing_session(data):
    assert ask(data, session="Q", year=2020).source == "data_unavailable"
    called = []
    out = lap_query.answer({"circuit": "B", "session": "Q"}, *data, ingest=lambda *a: called.append(a) or data)
    assert called == [("B", None, "Q")] and out.source == "data_unavailable"
