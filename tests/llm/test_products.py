"""Registered jobs return what they make, and what they tell of it follows from it."""

import hashlib
import random
import zlib
from collections import defaultdict

import corpus_pipeline
from test_small import LINE, prose, whole_ids
from stintline.llm import line_dedup, packing, queries


def test_packing_returns_the_ids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packing, "PIECES", 3)
    rng = random.Random(41)
    texts = {i: prose(rng.choice((20, 300, 1500)), rng) for i in range(25)} | {25: None}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    name, last = corpus_pipeline.STAGES[-1]
    for packed in (queries.op9_packing(spark, f"file://{tmp_path}"), last(spark, docs, f"file://{tmp_path}")):
        pieces = defaultdict(list)
        for r in packed.collect():
            assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
            pieces[r["doc_id"]].append((r["start"], bytes(r["ids"])))
        for i, t in texts.items():
            assert b"".join(p for _, p in sorted(pieces[i])) == b"".join(x.to_bytes(4, "little") for x in [*whole_ids(t), 1])


def test_line_dedup_returns_its_bitmaps(spark, tmp_path):
    own = lambda i, k: f"line {k} of document {i}, which no other one has, as is plain to see"
    texts = {i: "\n".join([LINE, own(i, 1), LINE, LINE, own(i, 2), LINE]) for i in range(6)} | {6: None, 7: "x\ny"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    for r in queries.op8_line_dedup(spark, f"file://{tmp_path}").collect():
        lines = (texts[r["doc_id"]] or "").split("\n")
        keep = line_dedup.runs_decode(r["keep_runs"], r["n_lines"])
        assert keep == [x != LINE or r["doc_id"] == 5 for x in lines] and r["n_dropped"] == keep.count(False)
        assert r["kept_sha256"] == hashlib.sha256("\n".join(x for x, k in zip(lines, keep, strict=True) if k).encode()).hexdigest()


def test_long_documents_lose_many_lines_in_linear_time(spark):
    """20,000 lines, every second of them lost, in seconds."""
    import time

    shared = [f"shared line {k} that a handful of documents hold, word for word" for k in range(10_000)]
    texts = {i: "\n".join(x for k, s in enumerate(shared) for x in (s, f"{i}.{k}")) for i in range(5)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in line_dedup.line_bitmaps(docs).collect()}
    assert time.time() - began < 60
    for i, t in texts.items():
        kept = t if i == 4 else "\n".join(f"{i}.{k}" for k in range(10_000))
        assert got[i] == (20_000, 0 if i == 4 else 10_000, hashlib.sha256(kept.encode()).hexdigest())


def test_line_dedup_tells_texts_of_one_id_apart(spark):
    rows = [(i, f"{LINE}\nown {i}") for i in range(6)] + [(2, f"a\n{LINE}"), (None, LINE), (None, LINE), (None, None)]
    cut = line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(((r["doc_id"], r["text"]) for r in cut.collect()), key=repr)
    want = [(i, f"own {i}") for i in range(5)] + [(5, f"{LINE}\nown 5"), (2, "a"), (None, LINE), (None, LINE), (None, None)]
    assert got == sorted(want, key=repr)
