"""Text functions, metrics, corpus operators and conversation state."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stintline.functions import metrics
from stintline.functions import text as X
from stintline.operators import corpus, knn
from stintline.sources import files, schemas
from stintline.streaming import state


def each(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["v"] for r in df.select("i", column(F.col("t")).alias("v")).orderBy("i").collect()]


def test_mode_and_pushback(spark):
    texts = ["Should we undercut on lap 20?", "Compare HAM and VER telemetry, undercut lap 20", "fastest lap at Spa", "hello", "Are you sure?"]
    assert each(spark, texts, X.mode) == ["general", "telemetry", "telemetry", "general", "general"]
    assert each(spark, texts, X.pushback) == [False] * 4 + [True]


def test_intent(spark):
    got = each(spark, ["ver or Hamilton at Albert Park 2023, Q2 lap 7", "race pace in the United States, fastest lap", "fp3 practice with average pace"], X.intent)
    assert (got[0]["drivers"], got[0]["circuit"], got[0]["year"], got[0]["session"], got[0]["lap_number"]) == (["VER", "HAM"], "Australia", 2023, "Q", 7)
    assert got[1]["circuit"] == "United States" and got[1]["session"] == "Race" and got[1]["lap_fastest"] and got[1]["drivers"] == []
    assert got[2]["session"] == "FP3" and got[2]["wants_average"] and got[2]["circuit"] is None


def test_topics_keep_four(spark):
    assert each(spark, ["strategy tyre pace sector speed"], X.topics) == [["strategy", "tyres", "pace", "sectors"]]


def test_numbers(spark):
    texts = ["1:23.456 in 2024, 3rd 3 and 3 or -0.5, 83.456", "2017 2018 2027 2028", "", "21st of 21"]
    assert each(spark, texts, X.numbers) == [[83.456, -0.5], [2017.0, 2028.0], [], []]


def test_times(spark):
    df = spark.createDataFrame([(83.456,), (59.9,), (None,), (120.0005,)], "s double")
    assert [r["t"] for r in df.select(X.lap_time_text(F.col("s")).alias("t")).collect()][:3] == ["1:23.456", "59.900", "N/A"]
    assert each(spark, ["1:23.456", "59.9", "x"], X.lap_time_seconds) == [83.456, 59.9, None]


def test_rewrites(spark):
    assert each(spark, ["Hamilton is 0.2s ahead of Norris in Sector 1"], X.sector_wording) == ["Norris is 0.2s behind Hamilton in Sector 1"]
    assert each(spark, ["degradation rate of -0.05s/lap", "max viable stint of 60 laps", "max viable stint of 20 laps"], X.bad_degradation) == ["deg_rate=-0.05", "max_viable_laps=60", None]
    anchored = X.grounding_prefix(F.lit("pit window?"), F.col("t"))
    assert each(spark, ["deg 0.05s/lap, cliff lap 20", "Key facts: deg 0.05s/lap"], lambda _: anchored) == ["Key facts: deg 0.05s/lap, cliff lap 20. deg 0.05s/lap, cliff lap 20", "Key facts: deg 0.05s/lap"]
    turns = each(spark, ["ENG: a\nDRV: b\nENG: c\nDRV: d", "ENG: a\nDRV: b"], X.dialogue)
    assert [t["role"] for t in turns[0]] == ["user", "assistant"] * 2 and turns[1] is None


def plain_rouge(a, b):
    a, b = a.lower().split(), b.lower().split()
    if not a or not b:
        return 0.0
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    n = t[-1][-1]
    return 2 * n / (len(a) + len(b))


def plain_bleu(a, b):
    a, b = a.lower().split(), b.lower().split()
    total = 0.0
    for n in range(1, 5):
        ca, cb = (Counter(tuple(s[i : i + n]) for i in range(len(s) - n + 1)) for s in (a, b))
        hit = sum((ca & cb).values())
        if not hit:
            return 0.0
        total += math.log(hit / sum(cb.values()))
    return (1.0 if len(b) >= len(a) else math.exp(1 - len(a) / len(b))) * math.exp(total / 4)


def test_metrics_against_plain_versions(spark):
    import random

    rng = random.Random(1)
    said = lambda: " ".join(rng.choice(["the", "lap", "was", "1:20.5", "quick", "Slow", "12"]) for _ in range(rng.randint(0, 14)))
    pairs = [(said(), said()) for _ in range(60)] + [("a b c d e", "a b c d e"), ("a b c", "a b c"), ("", "a"), ("the the the the", "the the the the the"), ("a b " * 50, "b a c " * 40), ("x " * 70 + "y", "y " + "x " * 65)]
    df = metrics.score(spark.createDataFrame(pairs, "reference string, generated string"))
    for r in df.collect():
        assert r["rouge_l"] == pytest.approx(plain_rouge(r["reference"], r["generated"]))
        assert r["bleu"] == pytest.approx(plain_bleu(r["reference"], r["generated"]))
    assert metrics.report(df).first()["n"] == len(pairs)
    assert sum(r["n"] for r in metrics.histogram(df, "rouge_l").collect()) == len(pairs)


def test_grounding(spark):
    pairs = [("10", "11.4", True, 0.0), ("10", "12", False, 1.0), ("0.5", "1.5", True, 0.0), ("0", "0.9", True, 0.0), ("0", "1", False, 1.0), ("none", "5", True, 0.0), ("5", "none", False, 0.0)]
    df = metrics.score(spark.createDataFrame([p[:2] for p in pairs], "reference string, generated string")).collect()
    assert [(r["factual"], r["halluc"]) for r in df] == [p[2:] for p in pairs]


def test_corpus(spark):
    rows = [(1, "Monza pace", "a"), (2, "Monza pace", "b"), (3, "Great Britain via spa", "c"), (4, "nothing named", "d"), (5, "spans of time", "e")]
    df = corpus.tagged(corpus.first_wins(spark.createDataFrame(rows, "id int, q string, a string"), "q", ["id"]), "q")
    assert {(r["id"], r["circuit"], r["split"]) for r in df.collect()} == {(1, "Italy", "test"), (3, "Great Britain", "train"), (4, None, "train"), (5, "Belgium", "val")}
    corpus.require_no_leakage(df, "q")
    with pytest.raises(ValueError):
        corpus.require_no_leakage(df.unionByName(df.withColumn("split", F.lit("other"))), "q")
    one = corpus.sample_per_category(df, "split", "q", 1, 10, 3).collect()
    assert Counter(r["split"] for r in one) == {"train": 1, "val": 1, "test": 1}


def test_messages(spark):
    m = corpus.example(F.col("q"), F.col("a"), "old")
    row = spark.createDataFrame([("q", "a")], "q string, a string").select(corpus.with_system(m, "new").alias("m"), corpus.with_system(F.slice(m, 2, 9), "new").alias("n")).first()
    assert row["m"] == row["n"] and [x["content"] for x in row["m"]] == ["new", "q", "a"]


def test_generation_guard_and_quota(spark):
    facts = spark.createDataFrame([(c, f"lap {i}") for c in "ab" for i in range(40, 46)], "kind string, facts string")
    done = spark.createDataFrame([("a", "x")] * 4, "kind string, facts string")
    reply = lambda d: d.withColumn("response", F.when(F.col("facts").endswith("3"), "lap 99").otherwise(F.col("facts")))
    kept, bad = corpus.generate(facts, reply, "kind", done, 5)
    n = Counter(r["kind"] for r in kept.collect()) + Counter(r["kind"] for r in bad.collect())
    assert n == {"a": 1, "b": 5}


def test_jsonl(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"messages":[{"role":"user","content":"q"}]}\n\nnot json\n')
    good, bad = files.read_jsonl(spark, str(path), schemas.CHAT)
    assert good.count() == 1 and [r["value"] for r in bad.collect()] == ["not json"]
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_jsonl(spark, str(path), schemas.CHAT, strict=True)[0].collect()
    files.write_jsonl(good.withColumn("_circuit", F.lit("x")), f"{tmp_path}/out")
    assert "_circuit" not in spark.read.json(f"{tmp_path}/out").columns
    (tmp_path / "x_clean.jsonl").write_text("")
    assert [p.rsplit("/", 1)[-1] for p in files.dataset_paths(spark, str(tmp_path))] == ["x.jsonl"]


def test_tables(spark):
    names = schemas.create_tables(spark)
    assert set(schemas.DDL) <= set(names) and schemas.create_tables(spark) == names
    assert schemas.weather_mode(["lap_id", "track_temp"]) == "lap_id" and schemas.weather_mode(["x"]) is None


def test_history_and_carry(spark):
    df = spark.createDataFrame([("s", i, "A" if i == 1 else None, 2024 if i == 2 else None, None) for i in range(60)], "sid string, turn long, circuit string, year int, session string")
    assert {r["turn"] for r in state.last_messages(df, "sid", ["turn"]).collect()} == set(range(10, 60))
    got = {r["turn"]: (r["circuit"], r["year"]) for r in state.carry_intent(df, "sid", ["turn"]).collect()}
    assert got[0] == (None, None) and got[1] == ("A", None) and got[59] == ("A", 2024)


TURNS = "sid string, turn long, circuit string, year int, session string, lap string, drivers array<string>, telemetry boolean, clear boolean"


def test_streams(spark, tmp_path):
    rows = [("s", 0, None, None, None, None, [], True, False), ("s", 1, "A", None, "Q", "7", ["VER", "HAM"], True, False), ("s", 2, None, 2024, None, None, [], True, False), ("s", 3, "B", None, None, "fastest", ["LEC"], False, False)]
    rows += [("s", 4, None, None, None, None, None, True, False), ("s", 5, None, None, None, None, [], True, True), ("s", 6, None, 2023, None, None, [], True, None), ("t", 1, None, None, None, None, None, True, True), ("t", 2, None, None, None, None, [], False, False)]
    df = spark.createDataFrame(rows, TURNS)
    df.where("turn < 4").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")

    def run():
        q = state.carry_intent_stream(stream).writeStream.foreachBatch(lambda b, _: b.write.mode("append").parquet(f"{tmp_path}/carried")).option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    df.where("turn >= 4").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()  # the state goes on from the first batch
    told = lambda d: {(r["sid"], r["turn"], r["circuit"], r["year"], r["session"], r["lap"], tuple(r["drivers"] or ())) for r in d.collect()}
    want = told(state.carry_intent(df, "sid", ["turn"]))
    assert told(spark.read.parquet(f"{tmp_path}/carried")) == want
    assert ("s", 4, "A", 2024, "Q", "7", ("VER", "HAM")) in want and ("s", 3, "B", 2024, "Q", "fastest", ("LEC",)) in want and ("s", 6, None, 2023, None, None, ()) in want
    plain = df.select("sid", "turn")
    plain.coalesce(1).write.parquet(f"{tmp_path}/rows")
    for _ in range(2):  # the second load adds nothing
        state.ingest_stream(spark, f"{tmp_path}/rows", plain.schema, f"{tmp_path}/out", f"{tmp_path}/c2", ["sid", "turn"]).awaitTermination()
    plain.coalesce(1).write.mode("append").parquet(f"{tmp_path}/rows")
    state.ingest_stream(spark, f"{tmp_path}/rows", plain.schema, f"{tmp_path}/out", f"{tmp_path}/c2", ["sid", "turn"]).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 9


def test_history_stream(spark, tmp_path):
    rows = [("s", i, "user", f"m{i}", False) for i in range(6)] + [("t", 0, "user", "x", False)]
    more = [("s", 6, "assistant", "m6", None), ("t", 1, None, None, True), ("u", 0, "user", "y", True), ("u", 1, "user", "z", False)]
    schema = "sid string, turn long, role string, content string, clear boolean"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")

    def run(n):
        out = f"{tmp_path}/out{n}"
        state.last_messages_stream(stream, 3).writeStream.foreachBatch(lambda b, _: b.write.mode("append").parquet(out)).outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
        return {(r["sid"], r["turn"], r["content"]) for r in spark.read.parquet(out).collect()}

    assert run(1) == {("s", 3, "m3"), ("s", 4, "m4"), ("s", 5, "m5"), ("t", 0, "x")}
    spark.createDataFrame(more, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert run(2) == {("s", 4, "m4"), ("s", 5, "m5"), ("s", 6, "m6"), ("t", None, None), ("u", 1, "z")}


def test_clear_and_stamp(spark):
    df = spark.createDataFrame([("s", i, "x") for i in range(9)] + [("t", 1, "y")], "key string, n long, text string")
    got = {(r["key"], r["n"]) for r in state.kept_messages(df, "key", ["n"], F.col("text").eqNullSafe("x") & (F.col("n") == 5), 2).collect()}
    assert got == {("s", 7), ("s", 8), ("t", 1)}
    assert {r["n"] for r in state.kept_messages(df, "key", ["n"], F.col("n") == 8).collect()} == {1}
    stamped = state.stamped(df).collect()
    assert len({r["id"] for r in stamped}) == 10 and all(r["timestamp"] > 1.7e9 for r in stamped)


def test_nearest(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, embedding array<float>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for limit in (knn.BLOCK_BYTES, 200):  # at once, and in several blocks
        got = {(r["query_id"], r["place"]): r["id"] for r in knn.nearest(df, df.where("vec_id % 20 = 0"), 3, parts=4, block_bytes=limit).collect()}
        for q in (0, 20, 40):
            order = [i for i in np.argsort(-(unit @ unit[q])) if i != q][:3]
            assert [got[q, k] for k in (1, 2, 3)] == order


def test_common_subsequences_of_long_texts():
    """Against the table, and in linear words: 5,000 tokens a side in well under a second."""
    import random
    import time

    from stintline.functions import metrics

    rng = random.Random(7)
    for n, m, words in ((0, 5, 3), (5, 0, 3), (1, 1, 1), (70, 130, 6), (64, 64, 2), (200, 61, 30)):
        a, b = [str(rng.randrange(words)) for _ in range(n)], [str(rng.randrange(words)) for _ in range(m)]
        table = [[0] * (m + 1) for _ in range(n + 1)]
        for i, j in ((i, j) for i in range(n) for j in range(m)):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert metrics.common_subsequence(a, b) == table[n][m]
        grams = lambda t, k: [tuple(t[i : i + k]) for i in range(len(t) - k + 1)]
        assert metrics.clipped_hits(a, b) == [sum(min(grams(a, k).count(g), grams(b, k).count(g)) for g in set(grams(b, k))) for k in metrics.ORDERS]
    a, b = [str(rng.randrange(500)) for _ in range(5000)], [str(rng.randrange(500)) for _ in range(5000)]
    began = time.time()
    assert metrics.common_subsequence(a, b) > 300 and time.time() - began < 1
