"""Traces: packed samples against the telemetry they stand for, and no shuffle of samples."""

import random

import pytest
from pyspark.sql import functions as F

from stintline.operators import cleaning, traces
from stintline.operators import statistics as S
from stintline.plans import laps as L
from stintline.plans import stats
from stintline.sources import fixtures
from stintline.sources.store import BUCKET_LAPS, buckets_for

SF = "/root/testdata/sf0.001"


def shuffled_by(df):
    """Shuffles of the plan but for that of the kinds of traces, some hundred."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line and "_kind" not in line]


def uneven(spark):
    """Laps of several lengths, with unknown and repeated samples out of order, long and packed."""
    rng = random.Random(3)
    rows = []
    for lap in range(60):
        for i in range(lap % 9):
            rows.append((f"l{lap}", i, rng.choice([None, float("nan"), *(50.0 * i + rng.choice([0, 7, 55]) for _ in range(9))]), rng.choice([None, *(float(rng.randrange(60, 90)) for _ in range(8))]), rng.choice([None, 1.0, 2.0, 5.0])))
    long = spark.createDataFrame(rows, "lap_id string, i int, Distance double, Speed double, nGear double")
    held = long.groupBy("lap_id").agg(F.shuffle(F.collect_list(F.struct("i", "Distance", "Speed", "nGear"))).alias("t"))
    return rows, long, held.select("lap_id", "t.i", "t.Distance", "t.Speed", "t.nGear")


def test_traces_are_the_telemetry(spark):
    held = stats.store(spark, SF)
    want = fixtures.view(spark, SF, "telemetry", held.lean)
    got = held["telemetry"]
    assert got.dtypes == want.dtypes and got.count() == want.count() > 0
    assert got.exceptAll(want).isEmpty()


def test_resample_of_packed_traces(spark):
    _, long, packed = uneven(spark)
    columns = {"Speed": "speed", "Throttle": "throttle", "nGear": "gear"}
    a, b = (sorted(map(str, cleaning.resample(t, columns).collect())) for t in (long, packed))
    assert a == b and len(a) > 100


def test_minima_of_uneven_laps(spark):
    rows, long, _ = uneven(spark)
    want = set()
    for lap in {r[0] for r in rows}:
        known = sorted((float("inf") if d != d else d, s) for k, _, d, s, _ in rows if k == lap and d is not None and s is not None)
        speeds = sorted(s for _, s in known)
        for i in range(1, len(known) - 1):
            at = (len(known) - 1) * 0.6
            slow = speeds[int(at)] + (at - int(at)) * (speeds[min(int(at) + 1, len(known) - 1)] - speeds[int(at)])
            if known[i - 1][1] >= known[i][1] < known[i + 1][1] and known[i][1] <= slow + 1e-9:
                want.add((lap, *known[i]))
    got = S.local_minima(long.select("lap_id", F.col("Distance").alias("distance"), F.col("Speed").alias("speed"))).collect()
    assert {(r[0], float("inf") if r[1] != r[1] else r[1], r[2]) for r in got} == want and want


def test_samples_and_laps_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(stats, "_STORES", {("another", str(i)): None for i in range(99)})  # a root of its own
    monkeypatch.setattr("stintline.sources.store.BUCKET_LAPS", (500, 5_000))
    t = stats.drawn(stats.store(spark, SF))
    traced, laps = t("telemetry"), t("laps")
    assert not shuffled_by(S.local_minima(traced))
    assert not shuffled_by(L.resample(spark, SF))
    assert not any("lap_id" in x or " id#" in x for x in shuffled_by(S.tyre_stats(laps, t("sessions"))))
    assert not any("lap_id" in x for x in shuffled_by(S.corner_matches(traced, laps, t("sessions"), t("corners"))))


def test_corner_sums_are_made_without_a_row_for_each_match(spark):
    t = stats.drawn(stats.store(spark, SF))
    given = t("telemetry"), t("laps"), t("sessions"), t("corners")
    want = {r[:3]: r[3:] for r in S.corner_sums(S.corner_matches(*given)).collect()}
    sums = S.matched_sums(*given)
    got = {r[:3]: r[3:] for r in sums.collect()}
    assert got.keys() == want.keys() and got
    assert all(got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0]) for k in want)
    plan = sums._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(x" not in plan and "lambdafunction" not in plan.split("MapInArrow")[1].split("Aggregate")[0]


def test_nearest_corner_of_maps_out_of_place(spark):
    """Corners that aren't numbered by distance, equally far ones, unknown places, and maps of several sizes."""
    rng, rows, want = random.Random(5), [], set()
    for lap in range(50):
        place = [rng.choice([None, float("nan"), 50.0 * rng.randrange(12)]) for _ in range(lap % 6)]
        speed = [float(rng.randrange(60, 300)) for _ in range(14)]
        rows.append((f"l{lap}", [50.0 * i for i in range(14)], speed, place, list(range(1, len(place) + 1)), [60.0] * len(place)))
        slow, found = sorted(speed)[7] * 0.2 + sorted(speed)[8] * 0.8, {}
        for i in range(1, 13):
            if speed[i - 1] >= speed[i] < speed[i + 1] and speed[i] <= slow:
                near = [(abs(50.0 * i - p), k) for k, p in enumerate(place, 1) if p is not None and p == p]
                if near and min(near)[0] <= 60:
                    found.setdefault(min(near)[1], []).append(speed[i])
        want |= {(f"l{lap}", k, min(v)) for k, v in found.items()}
    held = spark.createDataFrame(rows, "lap_id string, distance array<double>, speed array<double>, place array<double>, number array<int>, reach array<double>")
    assert {tuple(r) for r in traces.slowest_at_corners(held, "lap_id").collect()} == want and want
    got = {(r["lap_id"], r["corner_number"], r["total"]) for r in traces.sums_at_corners(held, "lap_id").collect()}
    assert got == want


@pytest.mark.parametrize("laps", [0, 600_000, 36_000_000, 216_000_000])
def test_buckets_grow_with_the_table(laps):
    assert laps / buckets_for(laps, 12) < 2 * BUCKET_LAPS[1]
