"""Operator 9, packing: hierarchical multi-length windows.

Documents become ids and are packed where they lie, in bundles of bounded size. Of each document, whole
windows of the longest tier are cut first. What is left goes to the shortest tier that holds it. The
tiers are packed from the longest to the shortest, largest remainder first: a window takes the remainder that
opens it, its gap is filled with the largest remainders that fit (of its tier or a shorter one), and what
gap still remains by cutting the next remainder. So windows of every tier are exactly full, and need no
padding. What is left over, less than the shortest tier, moves on to the next bundle; only the last window
of a partition may be padded. The windows of a bundle are dealt to step groups of near-equal cost.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import SLICE
from .tokens import shared_ids

TIERS = (256, 512, 1024, 2048)
#: Remainders in a bundle: with the longest tier's 2048 ids of 4 bytes each, 17 MB at most.
BUNDLE = 2048
#: Pieces passed on together: 4 MB of ids at most.
PIECES = 512
#: Windows of the longest tier in a step group; shorter windows count by their length.
STEP = 32


class Remainders:
    """A multiset of (length, piece), kept sorted by length; pieces of one length leave last in, first out."""

    def __init__(self, pieces: list):
        self.pieces = sorted(pieces, key=lambda p: p[0])
        self.lengths = [p[0] for p in self.pieces]

    def __len__(self):
        return len(self.pieces)

    def add(self, length: int, piece) -> None:
        at = bisect_right(self.lengths, length)
        self.lengths.insert(at, length)
        self.pieces.insert(at, (length, piece))

    def take(self, most: int):
        """The longest piece of at most so many ids, or None."""
        at = bisect_right(self.lengths, most) - 1
        if at < 0:
            return None
        self.lengths.pop(at)
        return self.pieces.pop(at)


def pack(pieces: list[tuple[int, tuple]], tiers: tuple[int, ...] = TIERS, last: bool = False) -> tuple[list, list]:
    """Pack (length, (document, start)) remainders, none longer than the longest tier.

    Returns windows, each (tier, [(document, start, length), ...]), and the remainders that no window
    took: together shorter than the shortest tier, and none if last, when one more window takes them.
    """
    left, total, windows = Remainders(pieces), sum(p[0] for p in pieces), []
    for tier in reversed(tiers):
        shorter = max((t for t in tiers if t < tier), default=0)
        while total >= tier and left.lengths[-1] > shorter:
            inside, gap = [], tier
            while gap:
                took = left.take(gap)
                if took is None:  # all are longer than the gap: cut the shortest
                    length, (doc, start) = left.take(left.lengths[0])
                    left.add(length - gap, (doc, start + gap))
                    took = gap, (doc, start)
                inside.append((*took[1], took[0]))
                gap -= took[0]
            windows.append((tier, inside))
            total -= tier
    # remainders above the total's tier: open them from the longest tier that the total still fills
    while total >= tiers[0]:
        tier, inside = max(t for t in tiers if t <= total), []
        gap = tier
        while gap:
            length, (doc, start) = left.take(left.lengths[-1])
            n = min(length, gap)
            inside.append((doc, start, n))
            if n < length:
                left.add(length - n, (doc, start + n))
            gap -= n
        windows.append((tier, inside))
        total -= tier
    rest = left.pieces
    if last and rest:
        windows.append((max(tiers), [(*p, n) for n, p in rest]))
        rest = []
    return windows, rest


def steps(lengths: list[int], size: int) -> list[int]:
    """A step group for each window, so that groups hold about `size` tokens and near-equal cost.

    Windows go from the costliest to the group with the least cost so far; cost is the square of
    the length (attention) beside the length itself.
    """
    from heapq import heapify, heapreplace

    groups = max(1, round(sum(lengths) / size))
    heap, out = [(0, g) for g in range(groups)], [0] * len(lengths)
    heapify(heap)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        cost, g = heap[0]
        out[i] = g
        heapreplace(heap, (cost + lengths[i] * (lengths[i] + 4096), g))
    return out


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int | None = 1, tiers: tuple[int, ...] = TIERS, bundle: int = BUNDLE, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    tier (the window's padded length), step (its step group) and, unless with_ids is false, ids.

    Each id of each text, and the end id after it, lies in exactly one piece. A null or empty text is
    its end id. Null and repeated ids are carried along: rows are packed one by one. Other columns are
    not read, an empty table gives an empty one, and a long text passes a window at a time. Nothing is
    shuffled; sequence and step ids hold the partition, so that they differ between partitions. Which
    windows a document's pieces lie in follows from the rows that its scan task reads, in their order; a
    task that runs again makes the same windows, a scan that is split in another way others.
    """
    kind = docs.schema[id_col].dataType
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType([T.StructField("doc_id", kind), *(T.StructField(n, T.LongType()) for n in names), T.StructField("tier", T.IntegerType()), T.StructField("step", T.LongType()), *([T.StructField("ids", T.BinaryType())] if with_ids else [])])
    arrow = to_arrow_schema(schema)
    end, most = b"" if end_id is None else end_id.to_bytes(4, "little"), max(tiers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, base = shared_ids(vocabulary), TaskContext.get().partitionId() << 36
        sequence = step = 0
        waiting: list = []  # (length, ((id, tokens, data, first), start)): data from the id `first` on
        whole: list = []

        def rows(windows):
            nonlocal sequence, step
            groups = steps([sum(p[2] for p in inside) for _, inside in windows], STEP * most)
            out = []

            def passed():
                return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(arrow)], schema=arrow)

            for (tier, inside), group in zip(windows, groups, strict=True):
                offset = 0
                for (doc, tokens, data, first), start, n in inside:
                    ids = data[4 * (start - first) : 4 * (start - first + n)]
                    out.append((doc, start, n, zlib.crc32(ids), tokens, base + sequence, offset, tier, base + step + group, ids if with_ids else None))
                    offset += n
                    if len(out) >= PIECES:
                        yield passed()
                        out.clear()
                sequence += 1
            step += max(groups, default=-1) + 1
            if out:
                yield passed()

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    data = encoder.encode(text, end)
                    n = len(data) // 4
                    cut = n - n % most
                    for start in range(0, cut, most):
                        whole.append((most, [((doc, n, data[4 * start : 4 * (start + most)], start), start, most)]))
                        if len(whole) >= bundle:
                            yield from rows(whole)
                            whole.clear()
                    if n > cut:
                        waiting.append((n - cut, ((doc, n, data[4 * cut :], cut), cut)))
                if len(waiting) >= bundle:
                    windows, waiting = pack(waiting, tiers)
                    yield from rows(whole + windows)
                    whole.clear()
        windows, _ = pack(waiting, tiers, last=True)
        yield from rows(whole + windows)

    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return slim.mapInArrow(run, schema)
