"""Statistics on hand-made laps: gates, ties, bounds and neighbours."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stintline.operators import statistics as S

LAPS = "id string, session_id string, driver string, lap_number int, lap_time double, sector1 double, sector2 double, sector3 double, compound string, tyre_age int, is_valid int"


@pytest.fixture(scope="module")
def sessions(spark):
    return spark.createDataFrame([("r", 2024, "A", "Race"), ("q", 2024, "A", "Q")], "id string, season int, circuit string, session_type string")


def lap(spark, rows):
    full = [(f"{s}|{d}|{n}|{i}", s, d, n, t, *(sec or (20.0, 30.0, t - 50 if t else None)), c, a, 1) for i, (s, d, n, t, sec, c, a) in enumerate(rows)]
    return spark.createDataFrame(full, LAPS)


def test_slope_and_inliers_match_numpy(spark):
    rng = np.random.default_rng(1)
    x, y = rng.integers(1, 20, 40).astype(float), rng.normal(80, 1, 40)
    df = spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(x, y)], "g string, x double, y double")
    assert df.groupBy("g").agg(S.slope("y", "x").alias("s")).first()["s"] == pytest.approx(np.polyfit(x, y, 1)[0])
    kept = {r["y"] for r in df.withColumn("k", S.inlier("y", ["g"])).where("k").collect()}
    assert kept == {float(v) for v in y if abs(v - y.mean()) <= 2 * y.std()}
    flat = spark.createDataFrame([("g", 1.0, 5.0)] * 4, "g string, x double, y double")
    assert flat.groupBy("g").agg(S.slope("y", "x").alias("s")).first()["s"] is None
    assert flat.withColumn("k", S.inlier("y", ["g"])).where("k").count() == 4
    assert df.limit(3).withColumn("k", S.inlier("y", ["g"])).where("k").count() == 3


def tyre_rows(per_lap, cliff, ages=20):
    return [("r", f"D{d}", a, 80 + per_lap * a + (1.0 if a >= cliff else 0.0), None, "SOFT", a) for a in range(1, ages + 1) for d in range(2)]


def test_tyre_stats(spark, sessions):
    found = S.tyre_stats(lap(spark, tyre_rows(0.05, 14)), sessions).collect()
    assert len(found) == 1 and found[0]["cliff_lap"] == 14 and found[0]["max_viable_laps"] == 13
    assert S.tyre_stats(lap(spark, tyre_rows(-0.05, 99)), sessions).count() == 0  # faster with age
    assert S.tyre_stats(lap(spark, tyre_rows(0.05, 99)), sessions).count() == 0  # no cliff
    assert S.tyre_stats(lap(spark, tyre_rows(0.05, 14)[:14]), sessions).count() == 0  # too few laps


def test_sector_deltas_use_the_first_of_equal_laps(spark, sessions):
    rows = [("q", "A", 1, 80.0, (25.0, 30.0, 25.0), "S", 1), ("q", "B", 1, 80.0, (24.0, 31.0, 25.0), "S", 1), ("q", "C", 1, 90.0, (23.0, 36.0, 30.01), "S", 1)]
    got = {r["driver"]: r for r in S.driver_sector_stats(lap(spark, rows), sessions).collect()}
    assert got["A"]["avg_sector1_delta"] == 0 and got["B"]["avg_sector1_delta"] == -1
    assert got["C"]["avg_sector1_delta"] == -2 and got["C"]["avg_sector2_delta"] is None and got["C"]["avg_sector3_delta"] is None


def test_speed_rank_is_given_before_the_bounds(spark, sessions):
    laps = lap(spark, [("r", d, 1, 80.0, None, "S", 1) for d in "ABC"])
    tel = laps.select(F.col("id").alias("lap_id"), F.lit(0.0).alias("distance"), F.when(F.col("driver") == "A", 375.0).when(F.col("driver") == "B", 300.0).otherwise(290.0).alias("speed"))
    assert {(r["driver"], r["rank_in_field"]) for r in S.speed_trap_stats(tel, laps, sessions).collect()} == {("B", 2), ("C", 3)}


def test_local_minima(spark):
    trace = [5, 3, 3, 4, 9, 2, 2, 2, 8, 1]
    df = spark.createDataFrame([("a", float(i), float(v)) for i, v in enumerate(trace)], "lap_id string, distance double, speed double")
    p60 = np.percentile(trace, 60)
    want = {float(i) for i in range(1, len(trace) - 1) if trace[i] <= trace[i - 1] and trace[i] < trace[i + 1] and trace[i] <= p60}
    assert {r["distance"] for r in S.local_minima(df).collect()} == want == {2.0, 7.0}


def test_corner_tolerance_and_ties(spark, sessions):
    corners = spark.createDataFrame([("A", 1, 100.0), ("A", 2, 300.0), ("A", 3, 2000.0)], "circuit string, corner_number int, distance_from_start double")
    assert {r["corner_number"]: r["tolerance"] for r in S.corner_tolerances(corners).collect()} == {1: 100.0, 2: 100.0, 3: 250.0}
    lone = corners.where("corner_number = 3")
    assert S.corner_tolerances(lone).first()["tolerance"] == 250.0
    laps = lap(spark, [("r", "A", 1, 80.0, None, "S", 1)])
    lap_id = laps.first()["id"]
    points = [(0.0, 300.0), (200.0, 100.0), (250.0, 300.0), (1700.0, 90.0), (1900.0, 80.0), (2100.0, 300.0)]
    tel = spark.createDataFrame([(lap_id, *p) for p in points], "lap_id string, distance double, speed double")
    got = {(r["corner_number"], r["speed"]) for r in S.corner_matches(tel, laps, sessions, corners).collect()}
    assert got == {(1, 100.0), (3, 80.0)}  # 200 m is as near to corner 2: the lower number wins


def test_fuel_needs_a_finish_and_pairs(spark, sessions):
    def race(driver, last, gain=0.03):
        return [("r", driver, n, 90 - gain * n, None, "S", 1 + (n - 1) % 4) for n in range(1, last + 1)]

    got = {r["driver"]: r["fuel_effect_per_10kg"] for r in S.fuel_stats(lap(spark, race("A", 40) + race("B", 37) + race("C", 36) + race("D", 29)), sessions).collect()}
    assert set(got) == {"A", "B"} and got["A"] == pytest.approx(0.3 / 1.7)


@pytest.mark.parametrize("gap,known", [(1.99, False), (2.0, True), (15.0, True), (15.01, False)])
def test_quali_race_bounds(spark, sessions, gap, known):
    rows = [("q", "A", 1, 80.0, None, "S", 1)] + [("r", "A", n, 80.0 + gap, None, "S", n) for n in range(1, 12)]
    row = S.quali_race_delta(lap(spark, rows), sessions).first()
    assert (row["delta"] is not None) == known and row["quali_lap"] == 80.0


def test_rejects_name_the_first_reason(spark):
    df = spark.createDataFrame([(1, None, 5.0), (2, 9.0, 5.0), (3, 1.0, 50.0), (4, 1.0, 5.0)], "id int, a double, b double")
    assert {(r["id"], r["reason"]) for r in S.rejects(df, {"a": (0, 2), "b": (0, 9)}).collect()} == {(1, "a missing"), (2, "a out of bounds"), (3, "b out of bounds")}


def test_tyre_stats_reads_laps_twice(spark, sessions):
    laps = lap(spark, tyre_rows(0.05, 14)).withColumn("track_temp", 30 + F.col("lap_number") % 5 + F.lit(0.0))
    plan = S.tyre_stats(laps, sessions)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("stddev_pop(" in line and "Window" in line for line in plan.splitlines()) == 2


def test_warmth_is_the_slope_of_what_age_leaves(spark):
    rows = [("a", 80 + 0.05 * i + 0.3 * (i * 7 % 5), float(i), 20.0 + i * 7 % 5) for i in range(12)]
    rows += [("a", 200.0, 3.0, None), ("a", 300.0, 4.0, float("nan"))]  # of unknown warmth
    rows += [("b", 80.0 + i, 5.0, 20.0 + i) for i in range(6)] + [("c", 80.0 + i, float(i), 20.0 + i) for i in range(5)] + [("d", 80.0 + i, float(i), 20.0) for i in range(6)]
    laps = spark.createDataFrame(rows, "g string, lap_time double, age double, track_temp double")
    known = laps.where("track_temp IS NOT NULL AND NOT isnan(track_temp)")
    per_age = known.groupBy("g").agg(F.coalesce(F.regr_slope("lap_time", "age"), F.lit(0.0)).alias("per_age"))
    left = known.join(per_age, "g").withColumn("left", F.col("lap_time") - F.col("per_age") * F.col("age"))
    told = {r["g"]: r["s"] for r in left.groupBy("g").agg(F.regr_slope("left", "track_temp").alias("s")).collect()}
    found = {r["g"]: r["w"] for r in laps.groupBy("g").agg(S.warmth().alias("w")).collect()}
    assert found["a"] == pytest.approx(told["a"]) and found["b"] == pytest.approx(1.0)  # one age takes nothing off
    assert found["c"] is None and found["d"] is None  # too few laps; one temperature
