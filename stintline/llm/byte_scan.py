"""Counts of many texts at once from the bytes of an Arrow column: classes of bytes, prefix sums, word hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .hashing import _TABLE, PLACES, mixed

#: Bytes whose words are hashed or compared at a time; one text may be longer.
PIECE = 1 << 20
#: The bytes of white space, and the symbols counted.
WHITE, SYMBOLS = b" \t\n\x0b\x0c\r", b"#$%&*|"


def _among(members: bytes) -> np.ndarray:
    """A flag for each byte: whether it is a member."""
    return np.isin(np.arange(256), np.frombuffer(members, np.uint8))


IN_WORD, CAPITAL, SYMBOL = ~_among(WHITE), _among(bytes(range(65, 91))), _among(SYMBOLS)
#: Bytes that begin a character.
LEADS = (np.arange(256) & 0xC0) != 0x80


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings, in place, and the offsets of its texts in them; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)), at


def within(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many flags are set in each text, by prefix sums; at are offsets in flags."""
    if len(at) == 2:  # one text, maybe a very long one
        return np.array([np.count_nonzero(flags[at[0] : at[1]])])
    upto = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=upto[1:])
    return upto[at[1:]] - upto[at[:-1]]


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the words of texts that lie end to end at the offsets; a text's end ends a word."""
    inside = IN_WORD[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = at[(at > 0) & (at < len(data))]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1 - starts


def _bytes_of(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of the spans end to end, the place of each in its span, and where each span begins among them."""
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    return data[np.repeat(starts, sizes) + place], place, first


def _slices(sizes: np.ndarray, most: int):
    """Runs of spans, each of at most so many bytes or of one span."""
    if not len(sizes):
        return
    upto, low = np.cumsum(sizes), 0
    while low < len(sizes):
        high = max(low + 1, int(np.searchsorted(upto, most + (upto[low - 1] if low else 0), "right")))
        yield slice(low, high)
        low = high


def span_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans: by tabulation up to PLACES bytes, of longer ones whole."""
    from xxhash import xxh3_64_intdigest

    out = np.zeros(len(starts), np.uint64)
    short = np.flatnonzero(sizes <= PLACES)
    for part in _slices(sizes[short], PIECE):
        rows = short[part]
        letters, place, first = _bytes_of(data, starts[rows], sizes[rows])
        out[rows] = mixed(np.add.reduceat(_TABLE[(place << 8) | letters], first) + sizes[rows].astype(np.uint64))
    for i in np.flatnonzero(sizes > PLACES).tolist():
        out[i] = xxh3_64_intdigest(data[starts[i] : starts[i] + sizes[i]])
    return out


def same_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray) -> np.ndarray:
    """Whether the spans of each pair hold the same bytes."""
    same = sizes_a == sizes_b
    short = np.flatnonzero(same & (sizes_a <= PLACES))
    for part in _slices(sizes_a[short], PIECE):
        rows = short[part]
        left, _, first = _bytes_of(data, a[rows], sizes_a[rows])
        right, _, _ = _bytes_of(data, b[rows], sizes_a[rows])
        same[rows] = np.logical_and.reduceat(left == right, first)
    for i in np.flatnonzero(same & (sizes_a > PLACES)).tolist():
        same[i] = np.array_equal(data[a[i] : a[i] + sizes_a[i]], data[b[i] : b[i] + sizes_a[i]])
    return same


def distinct_words(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """How many different words each text has: the runs of equal hashes among its sorted ones.

    text is the number of each word's text. Words of one hash are compared byte by byte; a text in which
    two of them differ is counted from its words themselves.
    """
    if not len(starts):
        return np.zeros(texts, np.int64)
    hashes = span_hashes(data, starts, sizes)
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    again = np.flatnonzero((h[1:] == h[:-1]) & (t[1:] == t[:-1]))
    counts = np.bincount(text, minlength=texts) - np.bincount(t[again], minlength=texts)
    a, b = order[again], order[again + 1]
    for i in np.unique(t[again[~same_spans(data, starts[a], starts[b], sizes[a], sizes[b])]]).tolist():
        own = np.flatnonzero(text == i)
        counts[i] = len({data[s : s + n].tobytes() for s, n in zip(starts[own].tolist(), sizes[own].tolist(), strict=True)})
    return counts


def scan(column: pa.Array) -> dict[str, np.ndarray]:
    """words, distinct, capitals, symbols and chars (code points) of each text of a column.

    Texts are taken together up to PIECE bytes, or one by one where one is longer; the arrays made on the way
    are in proportion to these bytes.
    """
    data, at = texts_of(column)
    out = {k: np.zeros(len(at) - 1, np.int64) for k in ("words", "distinct", "capitals", "symbols", "chars")}
    for part in _slices(np.diff(at), PIECE):
        own = at[part.start : part.stop + 1]
        piece, own = data[own[0] : own[-1]], own - own[0]
        starts, sizes = word_spans(piece, own)
        text = np.searchsorted(own, starts, "right") - 1
        out["words"][part] = np.bincount(text, minlength=len(own) - 1)
        out["distinct"][part] = distinct_words(piece, starts, sizes, text, len(own) - 1)
        for name, table in (("capitals", CAPITAL), ("symbols", SYMBOL), ("chars", LEADS)):
            out[name][part] = within(table[piece], own)
    return out
