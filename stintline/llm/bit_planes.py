"""Integer inner products by bit-planes: intervals of scores that tighten plane by plane, until few pairs are left.

A row's integers are taken apart in two's complement, r = -2^(B-1) b[B-1] + sum of 2^k b[k]. After the planes
from the most significant one down to plane k, what is missing of each component is at least 0 and less than
2^k, so that a score lies between the sum so far plus (2^k - 1) times the anchor's negative components and the
sum so far plus (2^k - 1) times its positive ones.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Integers below this in size go through planes; sums of their products are exact in doubles and longs.
ORDINARY = 1 << 20
#: Once at most one pair in so many is left, planes are multiplied pair by pair.
SPARSE = 8
#: Pairs multiplied at a time then.
PAIRS = 1 << 14
_LONG = (1 << 63) - 1


def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(256 x) of each component, as doubles: exact, as 256 is a power of two."""
    return np.floor(256.0 * vectors.astype(np.float64))


def planes_of(rows: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(weight, 0/1 matrix) of each bit-plane of whole numbers, most significant first; the first weight is negative."""
    ints = rows.astype(np.int64)
    bits = int(max(ints.max(initial=0), -(ints.min(initial=0) + 1))).bit_length() + 1
    return [((-1 if k == bits - 1 else 1) << k, ((ints >> k) & 1).astype(np.float64)) for k in range(bits - 1, -1, -1)]


def qualifying(rows: np.ndarray, anchors: np.ndarray, may: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, score) of the pairs that may qualify by their exact scores; rows and anchors are whole numbers.

    may(low, high, anchor) tells of arrays of intervals, and the anchors' numbers, which can qualify still; it
    is asked again after every plane. low and high have a row for each of rows as long as all pairs are held.
    """
    every = np.arange(len(anchors))
    up, down = np.maximum(anchors, 0).sum(1), np.minimum(anchors, 0).sum(1)
    sums, r, a = np.zeros((len(rows), len(anchors))), None, None
    alive = None
    for weight, plane in planes_of(rows):
        left = abs(weight) - 1
        if r is None:
            sums += weight * (plane @ anchors.T)
            alive = may(sums + left * down, sums + left * up, every)
            if np.count_nonzero(alive) * SPARSE <= alive.size:
                r, a = np.nonzero(alive)
                sums = sums[r, a]
        else:
            for at in range(0, len(r), PAIRS):
                part = slice(at, at + PAIRS)
                sums[part] += weight * np.einsum("ij,ij->i", plane[r[part]], anchors[a[part]])
            alive = may(sums + left * down[a], sums + left * up[a], a)
            r, a, sums = r[alive], a[alive], sums[alive]
    if r is None:
        r, a = np.nonzero(alive)
        sums = sums[r, a]
    return r, a, sums.astype(np.int64)


def _long(x: int) -> int:
    return max(-_LONG - 1, min(_LONG, x))


def exact(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Scores of all pairs by Python's integers, where components are too large for planes; beyond a long
    they are its ends."""
    a = [[int(x) for x in v] for v in anchors]
    return np.array([[_long(sum(int(x) * y for x, y in zip(v, w, strict=True) if y)) for w in a] for v in rows], np.int64).reshape(len(rows), len(anchors))


def pairs(rows: np.ndarray, anchors: np.ndarray, may: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """qualifying() for whole numbers of any size; a shorter side is filled up with zeros."""
    width = max(rows.shape[1], anchors.shape[1])
    rows, anchors = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (rows, anchors))
    big_r, big_a = ((np.abs(x) >= ORDINARY).any(1) if len(x) else np.zeros(0, bool) for x in (rows, anchors))
    found = []
    for of_r, of_a in ((~big_r, ~big_a), (big_r, big_a), (~big_r, big_a), (big_r, ~big_a)):
        i, j = np.flatnonzero(of_r), np.flatnonzero(of_a)
        if not len(i) or not len(j):
            continue
        if not big_r[i[0]] and not big_a[j[0]]:
            r, a, s = qualifying(rows[i], anchors[j], lambda low, high, k, j=j: may(low, high, j[k]))
        else:
            scores = exact(rows[i], anchors[j])
            r, a = np.nonzero(may(scores, scores, j))
            s = scores[r, a]
        found.append((i[r], j[a], s))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))
