"""Jobs: loading sessions, publishing tables, building the corpus, writing reports, settings."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from stintline.functions import metrics, render
from stintline.functions import text as X
from stintline.operators import corpus, lap_query, session_load
from stintline.sources import files, settings
from stintline.sources.store import Layout, Store, read, write
from stintline.sources.versions import Versions

RAW = "season int, circuit string, session_type string, Driver string, LapNumber int, LapTime double, Sector1Time double, Sector2Time double, Sector3Time double, PitInTime double, TrackStatus string, Compound string, TyreLife double"
TRACE = "season int, circuit string, session_type string, Driver string, LapNumber int, i int, Distance double, Speed double, Throttle double, Brake double, nGear double"


@pytest.fixture(scope="module")
def landed(spark):
    sessions = [(2025, "A", "Race"), (2025, "A", "Q"), (2025, "B", "Race"), (2024, "A", "Race"), (2025, "A", "Race")]
    laps = [(s, c, t, d, n, 80.0, 25.0, 30.0, 25.0, None, "1", "SOFT", 3.0) for s, c, t in sessions[:2] for d in ("VER", "HAM") for n in (1, 2)]
    laps += [(2025, "A", "Race", "LEC", 1, 80.0, None, 30.0, 25.0, None, "1", "SOFT", 3.0), (2025, "A", "Race", "LEC", 2, 80.0, 25.0, 30.0, 25.0, None, "14", "", 3.0)]
    trace = [(s, c, t, d, n, i, 60.0 * i, 200.0, 1.0, 0.0, 5.0) for s, c, t in sessions[:2] for d in ("VER", "LEC") for n in (1, 2, 3) for i in range(3 if n == 1 else 1)]
    named = spark.createDataFrame(sessions, "season int, circuit string, session_type string").withColumn("date", F.lit("2025-03-01"))
    return named, spark.createDataFrame(laps, RAW), spark.createDataFrame(trace, TRACE)


def test_load_keeps_what_fits(landed):
    named, laps, trace = landed
    new = session_load.load(named, laps, trace, named.where("season = 2024"))
    assert {(r["circuit"], r["session_type"]) for r in new.sessions.collect()} == {("A", "Race"), ("A", "Q"), ("B", "Race")}  # B has no lap and is recorded
    kept = {(r["driver"], r["lap_number"]) for r in new.laps.collect()}
    assert new.laps.count() == 8 and kept == {(d, n) for d in ("VER", "HAM") for n in (1, 2)}
    # races alone are traced; LEC's laps aren't kept, VER's second has one sample and the third no lap
    rows = new.telemetry.collect()
    assert [r["distance"] for r in sorted(rows, key=lambda r: r["distance"])] == [0.0, 50.0, 100.0] and {r["lap_id"].split("|")[1:] == ["VER", "1"] for r in rows} == {True}


def test_append_can_be_repeated(spark, landed, tmp_path):
    named, laps, trace = landed
    target = f"file://{tmp_path}/tables"
    new = session_load.load(named, laps, trace, named.where("1 = 0"))
    new.laps.withColumn("x", F.lit(1)).drop("x").write.partitionBy("session_id").parquet(f"{target}/laps")  # what a failed attempt left
    session_load.append(new, target)
    stored = spark.read.parquet(f"{target}/sessions")
    assert stored.count() == 4 and spark.read.parquet(f"{target}/laps").count() == 8
    again = session_load.load(named, laps, trace, stored)
    assert again.sessions.count() == again.laps.count() == again.telemetry.count() == 0
    session_load.clear(spark, target)
    assert os.listdir(f"{tmp_path}/tables") == []


def test_missing_sessions_are_tried_newest_first():
    tried = []
    there = lambda y, c, k: tried.append((y, k)) or y == 2023
    assert session_load.ensure_session("A", None, "Q2", there, [2022, 2023, 2024]) == (2023, "Q") and tried == [(2024, "Q"), (2023, "Q")]
    assert session_load.ensure_session("A", 2024, "Race", there, [2023]) is None
    assert session_load.ensure_session("A", None, "FP2", there, [2023]) is None and len(tried) == 3


def test_publish_replaces_all_or_nothing(spark, tmp_path):
    versions = Versions(spark, f"file://{tmp_path}/stats")
    one, two = spark.range(3), spark.range(5)
    versions.publish({"a": one, "b": one})
    broken = two.select(F.raise_error(F.lit("no")).alias("id"))
    with pytest.raises(Exception, match="no"):
        versions.publish({"a": two, "b": broken})
    assert versions.read(versions.current(), "a").count() == 3
    versions.publish({"a": two, "b": two})
    assert versions.read(versions.current(), "b").count() == 5


def test_store_builds_once_and_buckets(spark, tmp_path):
    made = []
    store = Store(spark, f"file://{tmp_path}/s", {"x": lambda s: made.append(1) or spark.range(4), "y": lambda s: s["x"].withColumn("k", F.col("id") % 2)})
    assert store["y"].count() == store["x"].count() == 4 and made == [1]
    path = f"file://{tmp_path}/t"
    write(spark.range(100).withColumn("k", F.col("id") % 7), path, Layout(bucket="k"))
    plan = read(spark, path, Layout(bucket="k")).groupBy("k").count()._jdf.queryExecution().toString()
    assert "Exchange hashpartitioning" not in plan.split("== Physical Plan ==")[1]


def test_store_reads_a_known_table_without_a_job(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", {"x": lambda s: spark.range(400)}, 600_000)
    assert store["x"].count() == 400 and len(list((tmp_path / "s" / "x").glob("*.parquet"))) == store.files > 1
    spark.sparkContext.setJobGroup("known", "reads of a known table")
    assert store["x"].dtypes == [("id", "bigint")]
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("known")


def test_laps_of_other_seasons_are_not_read(spark, tmp_path):
    laps = spark.createDataFrame([(s, f"{s}|A|Q", "VER", 1, 80.0, 25.0, 30.0, 25.0, 1) for s in (2023, 2024)], "season int, session_id string, driver string, lap_number int, lap_time double, sector1 double, sector2 double, sector3 double, is_valid int")
    laps.write.partitionBy("season").parquet(f"{tmp_path}/laps")
    sessions = spark.createDataFrame([(f"{s}|A|Q", s, "A", "Q") for s in (2023, 2024)], "id string, season int, circuit string, session_type string")
    got = lap_query.answer({"circuit": "A", "session": "Q"}, spark.read.parquet(f"{tmp_path}/laps"), sessions)
    assert got.session_id == "2024|A|Q" and "PartitionFilters: [isnotnull(season" in got.rows._jdf.queryExecution().toString()


def test_corpus(spark, tmp_path):
    made = lambda *rows: spark.createDataFrame(rows, "question string, answer string")
    whole = corpus.assemble({"first": made(("q1", "b"), ("q1", "a at Monza"), ("Spa?", "x")), "second": made(("q1", "c"), ("q2", "d"))})
    assert {(r["question"], r["answer"], r["source"], r["split"]) for r in whole.collect()} == {("q1", "a at Monza", "first", "test"), ("Spa?", "x", "first", "val"), ("q2", "d", "second", "train")}
    corpus.write_splits(whole, f"{tmp_path}/out", "You answer.")
    (path,) = glob.glob(f"{tmp_path}/out/split=test/*.json")
    with open(path) as f:
        assert [m["role"] for m in json.loads(f.readline())["messages"]] == ["system", "user", "assistant"]


def test_report_is_written_in_order(spark, tmp_path):
    pairs = spark.createDataFrame([(i, "the lap took 80.5 s", "the lap took 80.5 s" if i else "nothing 12") for i in range(4)], "id long, reference string, generated string")
    lines = metrics.report_lines(metrics.score(pairs))
    files.write_report(lines, f"file://{tmp_path}/report")
    (path,) = glob.glob(f"{tmp_path}/report/*.txt")
    with open(path) as f:
        text = f.read().splitlines()
    assert text[0] == "examples 4" and text[1] == "rouge_l 0.7500" and "wrong numbers in 1 of 4" in text and text[-1] == "wrong 0"


def test_rewrite_keeps_one_backup(spark, tmp_path):
    path = f"file://{tmp_path}/set.jsonl"
    files.write_jsonl(spark.range(4), path)
    files.rewrite_jsonl(spark, path, lambda df: df.where("id > 0"))
    files.rewrite_jsonl(spark, path, lambda df: df.where("id > 1"))
    assert spark.read.json(path).count() == 2 and spark.read.json(f"{path}.bak").count() == 4
    assert [p.rsplit("/", 1)[1] for p in files.dataset_paths(spark, f"file://{tmp_path}")] == ["set.jsonl"]


def test_settings():
    lines = ["# note", "", "A=1", "export B = 'two words' ", "A=3", 'C="x"', "=y"]
    assert settings.parse_settings(lines) == {"A": "1", "B": "two words", "C": "x"}
    assert settings.settings(lines, {"A": "9"})["A"] == "9"


def test_implausible_blocks(spark):
    rows = [("VER 3 2:59.000 25.000 30.000 61.000\nquali to race 0 s", 3), ("(1:10.000 99.000 99.000 99.000)", 0), ("", 0), (None, 0), ("rank #40, cliff lap 50, deg of 0.500 s per lap", 3), ("top speed of 255 km/h", 1)]
    got = [r["n"] for r in spark.createDataFrame(rows, "t string, k int").select(F.size(X.implausible(F.col("t"))).alias("n")).collect()]
    assert got == [k for _, k in rows]


def test_rendering_without_rows(spark):
    empty = spark.range(1).select(F.array().cast("array<struct<driver:string,lap_number:int,lap_time:double,sector1:double,sector2:double,sector3:double,compound:string,tyre_age:int>>").alias("rows"))
    assert empty.select(render.lap_table(F.col("rows")).alias("t"), render.lap_bullets(F.col("rows")).alias("b")).first() == (render.NO_ROWS, "")


def test_conversations(spark, tmp_path):
    from stintline.operators.chat import Conversations

    talk = Conversations(spark, f"file://{tmp_path}/talk")
    assert talk.history("a") == [] and talk.health() == {"status": "ok", "conversations": 0}
    talk.add("a", ("user", "one"), ("assistant", "two"), mode="telemetry")
    talk.add("b", ("user", "other"))
    talk.add("a", ("user", "three"))
    assert talk.history("a") == [("user", "one"), ("assistant", "two"), ("user", "three")] and talk.history("a", 1) == [("user", "three")]
    talk.clear("a")
    assert talk.history("a") == [] and talk.history("b") == [("user", "other")] and talk.health()["conversations"] == 2


def test_session_and_catalog(spark):
    from stintline.sources import schemas
    from stintline.sources.session import open_session, table_columns

    same = open_session(settings={"spark.sql.session.timeZone": "UTC"}, database="timing")
    try:
        schemas.create_tables(same, "timing")
        held = table_columns(same, "timing")
        assert set(held) == set(schemas.DDL) and sorted(held["laps"]) == sorted(f.name for f in schemas.schema("laps"))
    finally:
        spark.catalog.setCurrentDatabase("default")
        spark.sql("DROP DATABASE timing CASCADE")


def test_vectors_are_written_once(spark, tmp_path):
    from stintline.operators import knn

    rows = spark.createDataFrame([(1, [3.0, 4.0], "a"), (1, [3.0, 4.0], "a"), (2, [0.0, 0.0], None)], "id long, embedding array<double>, text string")
    knn.write_vectors(rows, f"file://{tmp_path}/v")
    assert {(r["id"], tuple(r["embedding"] or ()), r["text"]) for r in spark.read.parquet(f"{tmp_path}/v").collect()} == {(1, (0.6, 0.8), "a"), (2, (), None)}


def test_paced_calls():
    from stintline.operators.pacing import Paced, TooFast

    now, slept, answers = [0.0], [], iter(["a", TooFast(), "b", TooFast(), TooFast(), ValueError("x"), TooFast(for_today=True)])

    def call(prompt):
        got = next(answers)
        if isinstance(got, Exception):
            raise got
        return got

    def sleep(s):
        slept.append(s)
        now[0] += s

    paced = Paced(call, apart=2, pause=60, retries=1, sleep=sleep, clock=lambda: now[0])
    assert paced("p") == "a" and slept == []
    assert paced("p") == "b" and slept == [2, 60]  # too fast once, then a response
    assert paced("p") is None and paced("p") is None  # too fast twice; a failure
    for _ in range(2):
        with pytest.raises(TooFast) as e:
            paced("p")
        assert e.value.for_today


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_draws_come_before_texts(spark):
    from stintline.plans import templates

    for name in ("m3_race_moments", "e20_lap_query_from_real_laps", "m2e_driver_comparison"):
        plan = plan_of(templates.template(spark, "/root/testdata/sf0.001", name).select("question"))
        below = plan[plan.index("Sort [") :]
        assert "md5" not in below.splitlines()[0] and "md5" in below  # the key is computed once a row, not at each comparison
        assert " AS question" not in below


@pytest.mark.parametrize("name", ["m2b_undercut_strategy", "m2c_driver_characteristics", "m2e_driver_comparison", "m3_race_moments"])
def test_draws_come_before_what_joins_one_row(spark, name):
    from stintline.plans import templates

    plan = plan_of(templates.template(spark, "/root/testdata/sf0.001", name))
    assert plan.count("Join LeftOuter") == 2 and "Join LeftOuter" not in plan[plan.index("Sort [") :]


def test_stay_out_meets_its_draws(spark):
    from stintline.plans import templates

    assert "Window" not in plan_of(templates.template(spark, "/root/testdata/sf0.001", "stay_out"))  # no next lap is found for all laps


def test_assembled_corpus_is_dealt_to_all_cores(spark):
    rows = spark.range(3).select(F.concat(F.lit("At Monaco, "), "id").alias("question"), F.lit("Yes").alias("answer"))
    found = corpus.assemble({"a": rows, "b": rows})
    assert "RepartitionByExpression [question" in plan_of(found) and {(r["source"], r["circuit"], r["split"]) for r in found.collect()} == {("a", "Monaco", "test")}
