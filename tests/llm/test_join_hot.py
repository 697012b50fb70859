"""The join's hashes and its hot lists."""

import random
import time

import numpy as np
import pytest

from stintline.llm import hashing, ngram_join
from test_small import near_copies, plain_components, rows_of


def thue_morse(n):
    return "".join("ab"[i.bit_count() % 2] for i in range(n))


@pytest.mark.parametrize("n", [64, 65, 512, 1024, 4096, 8192])
def test_words_that_mirror_each_other_have_hashes_of_their_own(n):
    word = thue_morse(n)
    other = word.translate(str.maketrans("ab", "ba"))
    a, b, c = hashing.word_hashes(f"{word} {other}\t{word}".encode()).tolist()
    assert a == c != b
    assert not set(ngram_join.shingle_set(f"{word} x", 5).tolist()) & set(ngram_join.shingle_set(f"{other} x", 5).tolist())


def test_word_hashes_go_by_words_alone(monkeypatch):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcé") for _ in range(rng.choice((1, 2, 5, 63, 64, 65, 200)))) for _ in range(400)]
    one = hashing.word_hashes("  ".join(words).encode()).tolist()
    assert len({*zip(words, one, strict=True)}) == len(set(words)) == len(set(one))
    monkeypatch.setattr(hashing, "PIECE", 50)
    assert hashing.word_hashes("\n".join(words).encode()).tolist() == one
    assert len(hashing.word_hashes(b" \t ")) == 0


@pytest.mark.parametrize("hot", [3, 20])
def test_hot_lists_in_parts(spark, monkeypatch, hot):
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "FREQUENT", 2)
    rows = near_copies(random.Random(hot), groups=3, each=60)
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = rows_of(ngram_join.ngram_join(table, 4, 85, 100, block_sets=16, block_tokens=2000), "doc_id", "n_shingles", "component_id")
    assert got == plain_components(rows, 4, 85, 100)


def test_a_filter_without_room_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FILTER_WORDS", 1)
    rows = near_copies(random.Random(8), groups=3, each=20)
    got = rows_of(ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100), "doc_id", "n_shingles", "component_id")
    assert got == plain_components(rows, 4, 85, 100)


def test_a_family_of_copies_is_searched_in_seconds():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 500)
    sets = []
    for _ in range(1000):
        s = base.copy()
        s[rng.integers(0, 500, 5)] = rng.integers(0, 1 << 62, 5)
        sets.append(np.unique(s))
    sets.sort(key=len)
    began = time.time()
    assert len(ngram_join.t_occurrence(sets, list(range(1000)), 85, 100)) == 999
    assert time.time() - began < 15


def test_sides_meet_each_other_alone():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 62, 60)
    sets = [np.unique(np.concatenate((base[k:], rng.integers(0, 1 << 62, k)))) for k in (0, 1, 2, 3, 4, 0)]
    sides = np.array([0, 0, 1, 0, 1, 1])
    found = ngram_join.t_occurrence(sets, list(range(6)), 85, 100, sides=sides)
    assert all(sides[i] != sides[j] for i, j in found) and len(found) == 5
    assert ngram_join.t_occurrence(sets, list(range(6)), 85, 100, sides=np.zeros(6, int)) == []
