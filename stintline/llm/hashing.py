"""64-bit hashes of words and of windows of words, in bulk."""

from __future__ import annotations

import numpy as np

#: Bytes of a text that are hashed at a time.
PIECE = 1 << 20
_RANDOM = np.random.default_rng(0x5EED)
_MULTIPLIERS = (_RANDOM.integers(0, 1 << 63, 64, np.uint64) << np.uint64(1)) | np.uint64(1)
#: Words of at most so many bytes are hashed by tabulation: a random number for each byte in each place.
PLACES = 64
_TABLE = _RANDOM.integers(0, (1 << 64) - 1, PLACES << 8, np.uint64, endpoint=True)
_WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of lower-cased bytes, in order; equal words have equal hashes.

    Words of up to PLACES bytes take the sum of a random table's entries, so that no pattern of bytes
    makes two of them meet more often than chance does; longer ones are hashed whole.
    """
    from xxhash import xxh3_64_intdigest

    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data) and not _WHITE[data[end]]:
            end += 1  # a piece ends with a word
        piece = np.frombuffer(data, np.uint8, end - at, at)
        inside = ~_WHITE[piece]
        edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
        starts, sizes = edge[::2], edge[1::2] - edge[::2]
        if len(starts):
            first = np.cumsum(sizes) - sizes
            letters = piece[inside]
            place = np.minimum(np.arange(len(letters)) - np.repeat(first, sizes), PLACES - 1)
            h = mixed(np.add.reduceat(_TABLE[(place << 8) | letters], first) + sizes.astype(np.uint64))
            for i in np.flatnonzero(sizes > PLACES).tolist():
                h[i] = xxh3_64_intdigest(data[at + starts[i] : at + starts[i] + sizes[i]])
            out.append(h)
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the windows of so many words, in order."""
    with np.errstate(over="ignore"):
        h = np.full(len(words) - size + 1, size, np.uint64)
        for i in range(size):
            h += words[i : len(words) - size + 1 + i] * _MULTIPLIERS[i % 64]
            if i % 64 == 63:
                h = mixed(h)
        return mixed(h)
