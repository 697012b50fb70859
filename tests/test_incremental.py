"""Statistics from states by session, and tables published by versions."""

import shutil
import threading
from urllib.parse import unquote

import duckdb
import pytest
from pyspark.sql import functions as F

from stintline.operators import build, incremental
from stintline.operators import statistics as S
from stintline.operators import traces
from stintline.plans.stats import KEYS, rounded
from stintline.sources.versions import Conflict, Versions

SESSIONS = [("a|Q", 2023, "A", "Q"), ("a|Race", 2023, "A", "Race"), ("b|Race", 2024, "A", "Race"), ("c|Q", 2024, "B", "Q")]
LAPS = "id string, session_id string, driver string, lap_number int, lap_time double, sector1 double, sector2 double, sector3 double, compound string, tyre_age int, is_valid int"


def data(spark, folder):
    """Laps and telemetry by session, as folders; sessions and corners."""
    laps = [
        (f"{s}|{d}|{n}", s, d, n, 80 + 0.02 * n + 0.1 * k + (0.3 if n % 17 > 12 else 0), 25.0 + k / 10, 30.0, 25.0 + n / 100, "SOFT", n % 17 + 1, 1)
        for s, *_ in SESSIONS for k, d in enumerate(("VER", "HAM", "NOR")) for n in range(1, 41)
    ]
    speed = lambda i, k: float(90 + 12 * abs(i % 10 - 5) * (5 if i % 3 == 0 else 4) + k)
    trace = [(f"{s}|{d}|{n}", s, 50.0 * i, speed(i, k + n % 3)) for s, _, _, kind in SESSIONS if kind == "Race" for k, d in enumerate(("VER", "HAM", "NOR")) for n in (1, 2, 3) for i in range(40)]
    tables = {"laps": spark.createDataFrame(laps, LAPS), "telemetry": spark.createDataFrame(trace, "lap_id string, session_id string, distance double, speed double")}
    tables["weather"] = tables["laps"].select(F.col("id").alias("lap_id"), "session_id", (25 + F.col("lap_number") % 7).cast("double").alias("track_temp"))
    for name, df in tables.items():
        incremental.by_session(df, f"file://{folder}/{name}")
    sessions = spark.createDataFrame(SESSIONS, "id string, season int, circuit string, session_type string")
    corners = spark.createDataFrame([(c, n, 250.0 * n) for c in "AB" for n in range(1, 8)], "circuit string, corner_number int, distance_from_start double")
    return lambda: {name: spark.read.parquet(f"file://{folder}/{name}") for name in tables}, sessions, corners


def rebuilt(t, sessions, corners):
    tables = {**t, "sessions": sessions, "corners": corners}
    tables["corner_means"] = build.corner_means(tables.__getitem__)
    return {name: make(tables.__getitem__) for name, make in build.STATISTICS.items()}


def shown(found):
    return sorted(map(tuple, incremental.together({n: rounded(df) for n, df in found.items()}, KEYS, 5).collect()))


def updated(spark, root, t, sessions, corners):
    return incremental.update(spark, root, t["laps"], t["telemetry"], sessions, corners, t["weather"])


def test_updates_equal_a_rebuild(spark, tmp_path):
    read, sessions, corners = data(spark, tmp_path)
    root = f"file://{tmp_path}/states"
    assert updated(spark, root, read(), sessions.where("season = 2023"), corners).number == 1
    t = read()  # lists all folders; those of old sessions are then taken away
    for name in ("laps", "telemetry", "weather"):
        for old in (tmp_path / name).iterdir():
            if unquote(old.name) in ("session_id=a|Q", "session_id=a|Race"):
                shutil.move(old, tmp_path / f"{name}-{old.name}")
    assert updated(spark, root, t, sessions, corners).number == 2  # reads new sessions' folders alone
    assert updated(spark, root, t, sessions, corners).number == 2  # nothing new
    for name in ("laps", "telemetry", "weather"):
        for old in tmp_path.glob(f"{name}-session_id*"):
            shutil.move(old, tmp_path / name / old.name.removeprefix(f"{name}-"))
    want = shown(rebuilt(read(), sessions, corners))
    assert shown(incremental.finals(spark, root, corners)) == want and {r[0] for r in want} == set(build.STATISTICS)


def test_many_sessions_are_read_by_season(spark, tmp_path, monkeypatch):
    read, sessions, corners = data(spark, tmp_path)
    t, root = read(), f"file://{tmp_path}/states"
    laps = t["laps"].join(t["weather"].select(F.col("lap_id").alias("id"), "track_temp"), "id").join(sessions.select(F.col("id").alias("session_id"), "season"), "session_id")
    traced = traces.packed(t["telemetry"]).join(laps.withColumnRenamed("id", "lap_id"), "lap_id")
    for name, df in (("laps", laps), ("traces", traced)):
        df.write.partitionBy("season").parquet(f"file://{tmp_path}/by/{name}")
    laps, traced = (spark.read.parquet(f"file://{tmp_path}/by/{name}") for name in ("laps", "traces"))
    monkeypatch.setattr(incremental, "NAMED", 0)  # sessions join
    assert incremental.update(spark, root, laps, traced, sessions.where("season = 2023"), corners).number == 1
    for name in ("laps", "traces"):  # listed, and not to be opened again
        shutil.move(tmp_path / f"by/{name}/season=2023", tmp_path / f"{name}-2023")
    assert incremental.update(spark, root, laps, traced, sessions, corners).number == 2
    want = shown(rebuilt(t, sessions, corners))
    assert shown(incremental.finals(spark, root, corners)) == want and {r[0] for r in want} == set(build.STATISTICS)


def test_another_map_finds_its_corners_anew(spark, tmp_path):
    read, sessions, corners = data(spark, tmp_path)
    root = f"file://{tmp_path}/states"
    updated(spark, root, read(), sessions, corners)
    moved = corners.withColumn("distance_from_start", F.when(F.col("circuit") == "A", F.col("distance_from_start") + 90).otherwise(F.col("distance_from_start")))
    assert updated(spark, root, read(), sessions, moved).number == 2
    assert shown(incremental.finals(spark, root, moved)) == shown(rebuilt(read(), sessions, moved))


def test_a_failed_update_adds_nothing(spark, tmp_path, monkeypatch):
    read, sessions, corners = data(spark, tmp_path)
    root = f"file://{tmp_path}/states"
    updated(spark, root, read(), sessions.where("season = 2023"), corners)
    with monkeypatch.context() as m:
        m.setattr(incremental, "corner_states", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            updated(spark, root, read(), sessions, corners)
    assert Versions(spark, root).current().number == 1
    monkeypatch.setattr(incremental, "BATCHES", 1)  # and batches are put together
    version = updated(spark, root, read(), sessions, corners)
    assert version.number == 2 and all(len(p) == 1 for p in version.folders.values())
    assert shown(incremental.finals(spark, root, corners)) == shown(rebuilt(read(), sessions, corners))


def test_readers_keep_to_a_version(spark, tmp_path):
    versions = Versions(spark, f"file://{tmp_path}/v")
    assert versions.current().number == 0
    table = lambda k: spark.range(3).withColumn("k", F.lit(k))
    versions.publish({"a": table(1), "b": table(1)})
    seen, wrong, done = set(), [], threading.Event()

    def reader():
        while not done.is_set():
            try:
                v = versions.current()
                ks = {r["k"] for n in ("a", "b") for r in versions.read(v, n).select("k").distinct().collect()}
                seen.add(v.number)
                if ks != {v.number}:
                    wrong.append((v.number, ks))
            except Exception as e:  # told after the thread has ended
                wrong.append(e)

    thread = threading.Thread(target=reader)
    thread.start()
    for k in range(2, 8):
        versions.publish({"a": table(k), "b": table(k)})
    done.set()
    thread.join(60)
    assert not wrong and len(seen) > 1
    versions.clean(keep=2)
    assert versions.numbers() == [6, 7] and versions.read(versions.version(6), "a").count() == 3
    assert len(list((tmp_path / "v/data").iterdir())) == 4


def test_two_writers_of_one_version(spark, tmp_path):
    versions = Versions(spark, f"file://{tmp_path}/v")
    base = versions.current()
    versions.commit(base, {"a": ["x"]})
    with pytest.raises(Conflict):
        versions.commit(base, {"a": ["y"]})
    assert versions.current().folders == {"a": ["x"]}


def test_corner_sums_add_up(spark):
    rows = spark.createDataFrame([("V", "A", 1, 100.0), ("V", "A", 1, 110.0), ("H", "A", 1, 90.0)], "driver string, circuit string, corner_number int, speed double")
    parts = S.corner_sums(rows.where("speed > 95")).unionByName(S.corner_sums(rows.where("speed <= 95")))
    assert sorted(map(tuple, S.corner_means(parts).select("driver", "avg_min_speed", "field").collect())) == [("H", 90.0, 97.5), ("V", 105.0, 97.5)]


def test_halves_are_rounded_as_sql_rounds_them(spark):
    values = [0.5200695, 1.0000005, 0.0078125, -0.5200695, -0.0078125, 2.5, 80.1234565, 0.1234565]
    rows = spark.createDataFrame(list(enumerate(values)), "k int, v double")
    got = {r["key"]: r["facts"] for r in incremental.together({"x": rows}, {"x": ["k"]}).collect()}
    con = duckdb.connect()
    assert got == {str(i): str(con.execute(f"SELECT CAST(CAST(round({v}::DOUBLE, 6) AS DECIMAL(18, 6)) AS VARCHAR)").fetchone()[0]) for i, v in enumerate(values)}
