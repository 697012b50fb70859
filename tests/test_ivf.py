"""The inverted-file index against brute force."""

import numpy as np

from stintline.operators import ivf, knn


def frame(spark, vectors):
    return spark.createDataFrame([(int(i), None if v is None else [float(x) for x in v]) for i, v in vectors], "vec_id long, embedding array<float>")


def pairs(df):
    return sorted((r["query_id"], r["id"], r["place"]) for r in df.collect())


def test_search_and_upsert(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ivf, "PART_ROWS", 40)  # long lists go to several tasks
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 12))
    rows = [(i, centres[i % 6 if i % 3 else 0] + rng.normal(0, 0.25, 12)) for i in range(600)]  # a third in one cloud
    index = ivf.Index(spark, f"file://{tmp_path}/index")
    index.build(frame(spark, [*rows[:400], (400, np.zeros(12)), (401, None), (3, rows[3][1])]))
    moved = [(i, centres[5] + rng.normal(0, 0.25, 12)) for i in range(0, 60)]
    version = index.upsert(frame(spark, [*moved, *rows[400:]]))
    held = dict(rows) | dict(moved)
    every = frame(spark, held.items())
    assert sorted(r["id"] for r in index.rows(version).collect()) == list(range(600))
    asked = every.where("vec_id % 20 = 0")
    exact = pairs(knn.nearest(every, asked, 5))
    assert pairs(index.search(asked, 5, probe=len(index._meta(version)[0]))) == exact
    probe = index._meta(version)[1]
    found = {x[:2] for x in pairs(index.search(asked, 5))}
    assert probe < len(index._meta(version)[0]) and len(found & {x[:2] for x in exact}) >= 0.9 * len(exact)


def test_small_and_empty(spark, tmp_path):
    index = ivf.Index(spark, f"file://{tmp_path}/one")
    index.build(frame(spark, [(1, [1.0, 0.0])]))
    index.upsert(frame(spark, [(2, [0.6, 0.8])]))
    assert pairs(index.search(frame(spark, [(1, [1.0, 0.0]), (9, [0.0, 1.0])]), 5)) == [(1, 2, 1), (9, 1, 2), (9, 2, 1)]
    assert index.search(frame(spark, []), 5).collect() == []


def test_neighbours_of_odd_vectors(spark):
    """Zero vectors, none, other widths, ties and repeated blocks; products are of matrices, not of pairs joined."""
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [3.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, 0.0, 0.0]), (6, [0.0, 1.0]), (7, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for limit in (knn.BLOCK_BYTES, 100):
        found = knn.nearest(df, df.where("vec_id IN (0, 3)"), 4, parts=3, block_bytes=limit)
        assert "NestedLoop" not in found._jdf.queryExecution().toString()
        got = {(r["query_id"], r["place"]): (r["id"], r["similarity"]) for r in found.collect()}
        assert [got[0, i] for i in range(1, 5)] == [(1, 1.0), (2, 1.0), (6, 0.0), (7, -1.0)]
        assert [got[3, i] for i in range(1, 5)] == [(0, None), (1, None), (2, None), (4, None)]
