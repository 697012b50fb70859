"""Near duplicates where ids and rows repeat: one row of each component stays."""

import random
from collections import Counter

import pytest
from test_small import prose
from stintline.llm import ngram_join

RNG = random.Random(31)
A, B, C = (prose(60, RNG) for _ in range(3))


@pytest.mark.parametrize("limits", [{}, {"block_sets": 2, "block_tokens": 100}])
def test_one_row_of_each_component_stays(spark, limits):
    rows = [(12, C, "x"), (12, C, "y"), (12, C, "z"), (13, C + " end", "x")]  # rows of the smallest id
    rows += [(5, A, "x"), (5, B, "x"), (3, B + " end", "x"), (9, A, "x")]  # an id with two texts; one leads to id 3
    rows += [(None, A, "x"), (None, A, "x"), (20, "", "x"), (20, "", "x"), (21, None, "x")]
    docs = spark.createDataFrame([(*r, 0, "g") for r in rows], "doc_id long, text string, source string, _row int, _gone string").coalesce(1)
    kept = ngram_join.keep_one(docs, **limits)
    assert kept.columns == docs.columns
    got = Counter((r["doc_id"], r["text"], r["source"]) for r in kept.collect())
    assert got == Counter([(12, C, "x"), (5, A, "x"), (3, B + " end", "x"), (None, A, "x"), (None, A, "x"), (20, "", "x"), (20, "", "x"), (21, None, "x")])
