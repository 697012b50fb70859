"""Hard negatives and bit-plane products against brute force."""

import math
import random

import numpy as np
import pytest

from stintline.llm import bit_planes, hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, row string, extra double"


def plain(rows, every=100):
    """The contract, pair by pair, with Python's integers."""
    sound = [(i, [math.floor(256 * float(np.float32(x))) for x in v], lab) for i, v, lab, *_ in rows if i is not None and v is not None and lab is not None and all(x is not None and math.isfinite(x) for x in v)]
    clip = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    out = []
    for k, (i, v, lab) in enumerate(sound):
        if i % every:
            continue
        scored = [(clip(sum(x * y for x, y in zip(v, w))), j, n, other == lab) for n, (j, w, other) in enumerate(sound) if n != k]
        order = lambda x: (-x[0], x[1], x[2])
        for p in sorted((x for x in scored if x[3]), key=order)[:5]:
            fits = [x for x in scored if not x[3] and 80 * p[0] <= 100 * x[0] <= 100 * p[0]]
            out += [(i, p[1], rank + 1, x[1], p[0], x[0]) for rank, x in enumerate(sorted(fits, key=order)[:5])]
    return sorted(out)


def mined(spark, rows, every=100, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    got = hard_negatives.hard_negatives(df, every)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


def clouds(n, dims, rng, labels=4, spread=0.08):
    """Vectors around a few centres that labels share, so that negatives lie near."""
    centres = rng.normal(0, 0.2, (3, dims))
    return [(i, [float(x) for x in np.float32(centres[i % 3] + rng.normal(0, spread, dims))], int(rng.integers(labels)), "r", 0.5) for i in range(n)]


@pytest.mark.parametrize(("n", "dims", "every", "spread"), [(300, 16, 20, 0.08), (90, 1, 10, 0.3), (200, 70, 50, 0.002)])
def test_agrees_with_brute_force(spark, n, dims, every, spread):
    rows = clouds(n, dims, np.random.default_rng(n), spread=spread)
    assert mined(spark, rows, every) == plain(rows, every)


def test_blocks_tiles_and_chunks_change_nothing(spark, monkeypatch):
    rows = clouds(240, 8, np.random.default_rng(5))
    want = plain(rows, 3)
    for name, value in (("BLOCK_BYTES", 3000), ("TILE", 7), ("CHUNK", 11), ("HELD", 20)):
        monkeypatch.setattr(hard_negatives, name, value)
    monkeypatch.setattr(bit_planes, "PAIRS", 5)
    assert mined(spark, rows, 3) == want and len(want) > 100


def test_defined_cases(spark):
    """Nulls in any column, numbers that aren't finite, ties and repeated rows, zero, negative and huge vectors."""
    v, w = [0.5, -0.25, 0.1], [0.45, -0.25, 0.1]
    rows = [
        (0, v, 1, "a", None), (0, v, 1, "a", None), (1, v, 1, None, 1.0), (2, v, 2, "b", 1.0), (3, w, 2, "b", 1.0), (4, w, 2, "b", 1.0), (4, w, 2, "b", 1.0),
        (None, v, 2, "c", 1.0), (5, None, 2, "c", 1.0), (6, v, None, "c", 1.0), (7, [0.5, None, 0.1], 2, "c", 1.0), (8, [0.5, math.nan, 0.1], 2, "c", 1.0), (9, [math.inf, 0.0, 0.1], 2, "c", 1.0),
        (100, [0.0, 0.0, 0.0], 3, "d", 1.0), (101, [0.0, 0.0, 0.0], 3, "d", 1.0), (200, [-0.5, 0.25, -0.1], 4, "e", 1.0), (201, v, 4, "e", 1.0),
        (300, [3e5, -2e4, 1e6], 5, "f", 1.0), (301, [3e5, -2e4, 9e5], 5, "f", 1.0), (302, [3e5, -2e4, 8e5], 6, "f", 1.0), (400, [1e30, 1e30, 0.0], 7, "g", 1.0), (401, [1e30, 0.0, 0.0], 7, "g", 1.0), (402, [1e30, 1.0, 0.0], 8, "g", 1.0),
    ]
    got = mined(spark, rows)
    assert got == plain(rows)
    assert {r[0] for r in got} >= {0, 100, 300, 400}
    assert mined(spark, [(i, x, lab, s, e) for i, x, lab, s, e in rows if i is not None and i > 300 and i != 400]) == []


def test_shorter_vectors_are_filled_up(spark):
    rows = [(0, [0.5, 0.5], 1, "", 0.0), (1, [0.5, 0.5, 9.0], 1, "", 0.0), (2, [0.5, 0.4, -3.0], 2, "", 0.0), (3, [], 2, "", 0.0)]
    assert mined(spark, rows) == plain(rows) == [(0, 1, 1, 2, 32768, 128 * 128 + 128 * 102)]


def test_empty_table(spark):
    assert mined(spark, []) == []


def test_planes_give_exact_products_and_drop_early():
    rng = np.random.default_rng(3)
    rows, anchors = rng.integers(-300, 300, (50, 33)).astype(float), rng.integers(-500, 500, (20, 33)).astype(float)
    want = rows.astype(int) @ anchors.astype(int).T
    asked = []

    def may(low, high, k):
        asked.append(low.size)
        exact = want if low.ndim == 2 else None
        if exact is not None:
            assert (low <= exact[:, k]).all() and (exact[:, k] <= high).all()  # intervals hold the score at every plane
        return high >= 900_000

    r, a, s = bit_planes.qualifying(rows, anchors, may)
    assert sorted(zip(r.tolist(), a.tolist(), s.tolist())) == sorted((i, j, want[i, j]) for i, j in zip(*np.nonzero(want >= 900_000)))
    assert asked[-1] < asked[0] / 4
    planes = bit_planes.planes_of(rows)
    assert (sum(w * p for w, p in planes) == rows).all() and planes[0][0] < 0 < planes[1][0]


def test_whole_is_the_floor():
    rng = random.Random(1)
    xs = np.float32([rng.uniform(-2, 2) for _ in range(500)] + [0.0, -0.0, 1 / 256, -1 / 256, 0.9999999])
    assert bit_planes.whole(xs).tolist() == [math.floor(256 * float(x)) for x in xs]
