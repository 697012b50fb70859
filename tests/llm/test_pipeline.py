"""The corpus pipeline: each stage's decisions take effect, and its columns are those of documents."""

import glob
import random
from collections import Counter

import corpus_pipeline
from test_small import LINE, prose
from stintline.llm import common, queries


def test_stages(spark, tmp_path):
    import random

    rng = random.Random(21)
    item = prose(20, rng)
    copy = prose(60, rng)
    rows = [(i, prose(40, rng), "en", "s") for i in range(12)]
    rows += [(20, copy, "en", "s"), (21, copy + " end", "en", "s"), (22, item + " " + prose(30, rng), "en", "s"), (23, "too short", "en", "s"), (24, None, None, None)]
    rows += [(30 + i, f"{LINE}\n{prose(40, rng)}", "en", "s") for i in range(6)]
    docs = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    sf = f"file://{tmp_path}"
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    at, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, sf).write.parquet(f"{sf}/out/{k}")
        at = spark.read.parquet(f"{sf}/out/{k}")
        seen[name] = at
    ids = {n: {r["doc_id"] for r in d.select("doc_id").collect()} for n, d in seen.items()}
    everything = {r[0] for r in rows}
    assert ids["quality rules"] == everything - {23, 24}
    assert ids["line dedup"] == ids["quality rules"]
    assert sum(LINE in r["text"] for r in seen["line dedup"].collect()) == 1
    assert all(r["n_chars"] == len(r["text"]) for r in seen["line dedup"].collect())
    assert ids["near duplicates"] == ids["line dedup"] - {21}
    assert ids["decontamination"] == ids["near duplicates"] - {22}
    assert ids["packing"] == ids["decontamination"]
    for name in list(seen)[:-1]:
        assert seen[name].columns == corpus_pipeline.COLUMNS
    def tables():
        return set(glob.glob(common.stage_root(spark).removeprefix("file://") + "/*"))

    held = tables()
    whole = corpus_pipeline.run(spark, sf)
    assert [p.rsplit("/", 1)[1][:21] for p in tables() - held] == ["stage-decontamination"]
    same = lambda d: Counter((r["doc_id"], r["doc_tokens"]) for r in d.select("doc_id", "doc_tokens").distinct().collect())
    assert same(whole) == same(seen["packing"])


def test_names():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_stages_of_empty_and_odd_tables(spark, tmp_path):
    """No rows, rows of nulls alone, repeated rows, and columns whose names the stages use themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row string, _gone string, _hits string"
    rng = random.Random(4)
    text = prose(50, rng)
    rows = [(None, None, None, None, None)] * 3 + [(5, text, "en", "s", len(text))] * 3 + [(6, text, None, None, None), (None, text, "en", "s", 1)]
    for name, given in (("none", []), ("odd", rows)):
        sf = f"file://{tmp_path}/{name}"
        spark.createDataFrame([(*r, "x", "y", "z") for r in given], schema).write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        got = Counter(r["doc_id"] for r in corpus_pipeline.run(spark, sf).where("start = 0").collect())
        assert got == (Counter() if name == "none" else Counter([5, None]))
