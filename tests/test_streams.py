"""Streams with state in RocksDB, and keyed ingest, against their tables; runs that break off and go on."""

import pytest
from pyspark.sql import functions as F

from stintline.sources.versions import Versions
from stintline.streaming import ingest, state, stateful

HISTORY = "sid string, turn long, role string, content string, clear boolean"


def stream(spark, folder, df):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}/in")


@pytest.fixture(scope="module")
def rocks(spark):
    stateful.durable_state(spark)
    return spark


def test_history_equals_the_table_after_each_part(rocks, tmp_path):
    rows = [(f"k{i % 7}", i, "user", f"m{i}", i % 31 == 30) for i in range(300)] + [("gone", 1, "user", "x", False)]
    df = rocks.createDataFrame(rows, HISTORY)
    out, parts = f"file://{tmp_path}/out", [df.where("turn < 90"), df.where("turn BETWEEN 90 AND 209"), df.where("turn > 209").unionByName(rocks.createDataFrame([("gone", 2, None, None, True)], HISTORY))]
    so_far = None
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stateful.run_to_end(stateful.history_stream(stream(rocks, tmp_path, df), 12), out, f"file://{tmp_path}/checkpoint")
        so_far = part if so_far is None else so_far.unionByName(part)
        want = state.kept_messages(so_far, "sid", ["turn"], F.col("clear"), 12).select("sid", "turn", "role", "content")
        got = stateful.newest(rocks.read.parquet(out)).select("sid", "turn", "role", "content")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    held = rocks.read.format("statestore").option("stateVarName", "messages").load(f"file://{tmp_path}/checkpoint")
    assert "gone" not in {r["key"]["sid"] for r in held.select("key").collect()}  # a cleared key leaves no state


def test_a_run_that_breaks_off_goes_on(rocks, tmp_path, monkeypatch):
    df = rocks.createDataFrame([(f"k{i % 3}", i, "user", f"m{i}", False) for i in range(60)], HISTORY)
    for k in range(3):
        df.where(F.col("turn") % 3 == k).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    out = f"file://{tmp_path}/out"
    made = stateful.history_stream(stream(rocks, tmp_path, df), 50)
    broken = made.writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}") if n < 1 else 1 / 0)
    with pytest.raises(Exception, match="division"):
        broken.option("checkpointLocation", f"file://{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    stateful.run_to_end(stateful.history_stream(stream(rocks, tmp_path, df), 50), out, f"file://{tmp_path}/checkpoint")
    got = stateful.newest(rocks.read.parquet(out))
    assert sorted(r["turn"] for r in got.collect()) == list(range(60))


def test_named_equals_the_table(rocks, tmp_path):
    schema = "sid string, turn long, circuit string, year int, session string, lap string, drivers array<string>, telemetry boolean, clear boolean"
    rows = [(f"k{i % 4}", i, "Monza" if i % 6 == 0 else None, 2020 + i % 5 if i % 5 == 0 else None, "Q" if i % 9 == 0 else None, None, ["VER"] if i % 7 == 0 else [], i % 3 != 1, i % 23 == 22) for i in range(120)]
    df = rocks.createDataFrame(rows, schema)
    for low, high in ((0, 49), (50, 119)):
        df.where(F.col("turn").between(low, high)).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stateful.run_to_end(stateful.named_stream(stream(rocks, tmp_path, df)), f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint")
    columns = ["sid", "turn", "circuit", "year", "session", "lap", "drivers"]
    want = state.carry_intent(df, "sid", ["turn"]).withColumn("drivers", F.array_join("drivers", ",")).select(*columns)
    assert sorted(map(tuple, rocks.read.parquet(f"file://{tmp_path}/out").select(*columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_keys_come_in_once(spark, tmp_path):
    target, rows = f"file://{tmp_path}/t", lambda low, high: spark.range(low, high).select(F.when(F.col("id") >= 0, F.col("id")).alias("id"), F.concat(F.lit("v"), "id").alias("v"))
    schema = spark.createDataFrame([], "id long, v string").schema
    ingest.append(spark, target, rows(0, 500), ["id"])
    ingest.append(spark, target, rows(400, 700).unionByName(rows(650, 700)), ["id"])
    with pytest.raises(ingest.Broken):
        ingest.append(spark, target, rows(600, 900), ["id"], ingest.BEFORE_COMMIT)
    assert ingest.table(spark, target, schema).count() == 700
    version = ingest.append(spark, target, rows(600, 900), ["id"])
    assert ingest.append(spark, target, rows(0, 900), ["id"]) == version == Versions(spark, target).current()
    assert sorted(r["id"] for r in ingest.table(spark, target, schema).collect()) == list(range(900))
    ingest.append(spark, target, spark.createDataFrame([(None, "n"), (None, "n"), (900, None)], schema), ["id"])
    ingest.append(spark, target, spark.createDataFrame([(None, "n")], schema), ["id"])
    assert ingest.table(spark, target, schema).where("id IS NULL").count() == 1 and ingest.table(spark, target, schema).count() == 902


def test_a_batch_opens_few_files_as_the_table_grows(spark, tmp_path):
    target, opened = f"file://{tmp_path}/t", []
    for k in range(4):
        ingest.append(spark, target, spark.range(1000 * k, 1000 * k + 1000), ["id"])
        versions = Versions(spark, target)
        fresh = ingest._hashed(spark.range(10_000_000, 10_000_020), ["id"])
        keys, folders = ingest.stored_keys(spark, versions, versions.current(), fresh, spark.range(1).schema, ["id"])
        opened.append(len(folders))
        known = ingest._hashed(spark.range(5, 6), ["id"])
        assert {r["id"] for r in ingest.stored_keys(spark, versions, versions.current(), known, spark.range(1).schema, ["id"])[0].collect()} >= {5}
    assert max(opened) <= 6 and sum(len(list((tmp_path / "t/data").glob("*/rows/_bucket=*"))) for _ in "x") > 200


def test_a_large_batch_asks_no_filter(spark, tmp_path, monkeypatch):
    target = f"file://{tmp_path}/t"
    ingest.append(spark, target, spark.range(3000), ["id"])
    monkeypatch.setattr(ingest, "PROBED", 10, raising=False)
    monkeypatch.setattr(ingest, "may_hold", lambda *a: 1 / 0)
    ingest.append(spark, target, spark.range(2000, 6000).unionByName(spark.range(10)), ["id"])
    assert sorted(r["id"] for r in ingest.table(spark, target, spark.range(1).schema).collect()) == list(range(6000))


def test_filters_are_words_by_place(spark):
    for n in (1, 5000):  # in a filter of few keys some words have no bit
        rows = ingest._hashed(spark.range(n), ["id"]).withColumn("_bucket", F.lit(3))
        held = ingest.filters(rows)
        assert dict(held.dtypes)["words"] == "array<bigint>" and held.where("size(words) = bits / 32").count() == 1
        asked = ingest._hashed(spark.range(20 * n), ["id"]).crossJoin(held).where(ingest.may_hold(F.col("_hash"), F.col("words"), F.col("bits")))
        found = [r["id"] for r in asked.select("id").collect()]
        assert set(range(n)) <= set(found) and len(found) <= n + 19 * n * 0.03 + 2


def test_zeros_and_nulls_of_keys_are_one(spark, tmp_path):
    target, schema = f"file://{tmp_path}/t", "k double, p string, v string"
    rows = lambda *r: spark.createDataFrame(r, schema)
    ingest.append(spark, target, rows((0.0, None, "a"), (-0.0, None, "b"), (float("nan"), "x", "c"), (float("nan"), "x", None)), ["k", "p"])
    ingest.append(spark, target, rows((-0.0, None, "d"), (float("nan"), "x", "e"), (None, None, None)), ["k", "p"])
    assert ingest.table(spark, target, rows().schema).count() == 3
