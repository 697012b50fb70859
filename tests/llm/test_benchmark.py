"""Large benchmarks and passages that all items share."""

import random
import time

import numpy as np

from stintline.llm import decontaminate
from stintline.llm.hashing import window_hashes, word_hashes

PASSAGE = " ".join(f"shared{k}" for k in range(16))


def test_a_passage_of_all_items(spark):
    """Each document that holds it names all items, and its hits carry one list."""
    bench = spark.createDataFrame([(i, f"intro{i} {PASSAGE} tail{i}") for i in range(600)] + [(None, PASSAGE)], "item_id int, text string")
    docs = spark.createDataFrame([(f"d{i}", f"own{i} {PASSAGE} own" if i % 3 else f"own{i} nothing") for i in range(90)], "doc_id string, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.contamination(docs, bench).collect()}
    names = sorted(map(str, range(600)))
    assert got == {f"d{i}": (18, 16, names) if i % 3 else (2, 0, []) for i in range(90)}
    rows, lists = decontaminate.benchmark_hits(docs, bench, ["doc_id"])
    assert max(len(r["_hits"]["lists"]) for r in rows.collect()) == 1 and lists.count() == 601


def test_a_million_grams_fit_one_broadcast():
    """Their bytes, by the sizes that are sent, and the hits of a document among them."""
    rng = random.Random(5)
    words = [b"w%d" % rng.randint(0, 50_000) for _ in range(1_000_009)]
    text = b" ".join(words)
    hashes = window_hashes(word_hashes(text), 10)
    places = np.concatenate(([0], np.cumsum([len(w) + 1 for w in words])))[: len(hashes)]
    order = np.argsort(hashes)
    block = text + b"\n", {10: (hashes[order], places[order].astype(np.uint32), np.zeros(len(order), np.uint32))}, np.array([7])
    assert len(text) + decontaminate.GRAM_BYTES * len(hashes) < decontaminate.BLOCK_BYTES
    began = time.time()
    grams = decontaminate.Grams(*block)
    n, spans, lists = grams.find((b"Before it, " + b" ".join(words[500_000:500_012]) + b". w1 w2 w3").decode())
    assert (n, spans, lists) == (17, [(2, 10), (3, 10), (4, 10)], [7])
    assert grams.find("w1 " * 20_000)[1] == [] and time.time() - began < 5


def test_equal_hashes_are_verified(monkeypatch):
    """With hashes that all agree, only true occurrences are found."""
    monkeypatch.setattr(decontaminate, "window_hashes", lambda words, n: np.zeros(len(words) - n + 1, np.uint64))
    text = b"a b c d\na b c de\n"
    grams = decontaminate.Grams(text, {3: (np.zeros(3, np.uint64), np.array([0, 2, 8]), np.array([0, 1, 0]))}, np.array([5, 6]))
    assert grams.find("x A b c y") == (5, [(1, 3)], [5]) or grams.find("x A b c y") == (5, [(1, 3), (1, 3)], [5])
    assert grams.find("b c de")[1] == [] and grams.find("b c d")[1:] == ([(0, 3)], [6])
