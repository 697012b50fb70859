"""Operator 11, hard-negative mining: for an anchor and its positive, the nearest rows of other labels.

Anchors are a stated query set against all rows. They go to the tasks in blocks of a checked size; each task
reads its rows in chunks, multiplies them with a block by bit-planes, and keeps what can still be among the
first of an anchor. Two passes over the rows: one for the positives, one for the negatives, whose window of
scores the positives fix. What a task returns is the first few of each anchor (and positive); these few meet
by anchor. No row is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bit_planes import pairs, whole
from .common import durable, release

FIRST = 5
#: Bytes of a block of anchors.
BLOCK_BYTES = 16 << 20
#: Rows and anchors multiplied at a time in a task.
CHUNK, TILE = 512, 512
#: Found pairs held back until they are reduced to the first of each anchor.
HELD = 1 << 18

_POSITIVE = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("row", T.LongType()), T.StructField("id", T.LongType()), T.StructField("score", T.LongType())])
_NEGATIVE = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("row", T.LongType()), T.StructField("id", T.LongType()), T.StructField("score", T.LongType())])


def valid_rows(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """row (a number of its own), id, label and vector of the rows that take part, written."""
    sound = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.coalesce(sound, F.lit(False)))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector"))
    return durable(rows, "negatives-rows")


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of lists as a matrix of whole numbers, shorter lists filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = whole(values)
    return out


class _Best:
    """The first FIRST pairs of each key: higher scores first, ties by smaller id, then by row."""

    def __init__(self, keys: int):
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size = 0
        #: Just below the last of a full key's scores: a pair below it isn't among the first.
        self.floor = np.full(keys, -np.inf)

    def add(self, key: np.ndarray, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        use = score >= self.floor[key]
        if use.any():
            self.held.append((key[use], row[use], ids[use], score[use]))
            self.size += int(use.sum())
        if self.size > HELD:
            self.reduce()

    def reduce(self) -> tuple[np.ndarray, ...]:
        """(key, row, id, score) of the first so far, by key."""
        if not self.held:
            return (np.zeros(0, np.int64),) * 4
        key, row, ids, score = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((row, ids, ~score, key))  # ~x falls as x rises, with no overflow
        key = key[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        place = np.arange(len(key)) - np.repeat(starts, np.diff(np.r_[starts, len(key)]))
        keep = place < FIRST
        out = key[keep], row[order][keep], ids[order][keep], score[order][keep]
        full = place == FIRST - 1
        self.floor[key[full]] = np.nextafter(score[order][full].astype(np.float64), -np.inf)
        self.held, self.size = [out], int(keep.sum())
        return out


def _chunks(batches: Iterator[pa.RecordBatch]):
    """(row, id, label, matrix) of so many rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            part = batch.slice(at, CHUNK)
            yield *(part.column(i).to_numpy() for i in range(3)), _matrix(part.column(3))


def _block_arrays(block: pa.Table) -> tuple:
    block = block.combine_chunks()
    vectors = block.column("vector").combine_chunks()
    vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors
    return *(block.column(c).to_numpy() for c in ("row", "id", "label")), _matrix(vectors)


def positives(rows: DataFrame, block: pa.Table) -> DataFrame:
    """anchor, row, id and score: each task's first FIRST rows of an anchor's own label, the anchor itself apart."""
    of_row, _, of_label, vectors = _block_arrays(block)
    order = np.argsort(of_label, kind="stable")
    shared = rows.sparkSession.sparkContext.broadcast((of_row[order], of_label[order], vectors[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_row, a_label, a_vector = shared.value
        begins = np.flatnonzero(np.r_[True, a_label[1:] != a_label[:-1]]) if len(a_label) else np.zeros(0, np.int64)
        tiles: dict[int, list] = {}
        for low, high in zip(begins.tolist(), [*begins[1:].tolist(), len(a_label)], strict=False):
            tiles[int(a_label[low])] = [(slice(at, min(high, at + TILE)), _Best(min(high, at + TILE) - at)) for at in range(low, high, TILE)]
        for row, ids, label, matrix in _chunks(batches):
            for value in np.unique(label).tolist():
                mine = np.flatnonzero(label == value)
                for tile, best in tiles.get(value, ()):
                    r, a, score = pairs(matrix[mine], a_vector[tile], lambda low, high, k, best=best: high >= best.floor[k])
                    other = row[mine[r]] != a_row[tile][a]
                    r, a, score = mine[r[other]], a[other], score[other]
                    best.add(a, row[r], ids[r], score)
                    best.reduce()
        for tile, best in (x for of_label in tiles.values() for x in of_label):
            key, row, ids, score = best.reduce()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a_row[tile][key], row, ids, score)], names=_POSITIVE.names)

    return rows.select("row", "id", "label", "vector").mapInArrow(run, _POSITIVE)


def negatives(rows: DataFrame, block: pa.Table) -> DataFrame:
    """anchor, place (of its positive), row, id and score: each task's first FIRST rows of other labels within the
    window of scores, 0.8 to 1 times the positive's."""
    of_row, _, of_label, vectors = _block_arrays(block)
    held = block.column("scores").to_pylist()  # of an anchor's positives, in their order
    counts = [len(s) for s in held]
    tops = np.array([s + [0] * (FIRST - len(s)) for s in held], np.int64).reshape(-1, FIRST)
    there = np.arange(FIRST) < np.array(counts, np.int64)[:, None]
    # The least score allowed is 0.8 of the positive's, rounded up, by whole numbers.
    least = np.array([[-((-4 * int(x)) // 5) for x in s] for s in tops.tolist()], np.int64).reshape(-1, FIRST)
    there &= least <= tops
    shared = rows.sparkSession.sparkContext.broadcast((of_row, of_label, vectors, tops, least, there))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = [(*(x[at : at + TILE] for x in shared.value), _Best(len(shared.value[0][at : at + TILE]) * FIRST)) for at in range(0, len(shared.value[0]), TILE)]
        for row, ids, label, matrix in _chunks(batches):
            for _, a_label, a_vector, tops, least, there, best in tiles:
                highest = np.where(there, tops, np.iinfo(np.int64).min).max(1)
                needed = np.where(there, np.maximum(least, best.floor.reshape(-1, FIRST)), np.inf).min(1)
                r, a, score = pairs(matrix, a_vector, lambda low, high, k, needed=needed, highest=highest: (high >= needed[k]) & (low <= highest[k]))
                differs = label[r] != a_label[a]
                r, a, score = r[differs], a[differs], score[differs]
                for i in range(FIRST):
                    fits = there[a, i] & (score >= least[a, i]) & (score <= tops[a, i])
                    best.add(a[fits] * FIRST + i, row[r[fits]], ids[r[fits]], score[fits])
                best.reduce()
        for tile in tiles:
            key, row, ids, score = tile[-1].reduce()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (tile[0][key // FIRST], (key % FIRST).astype(np.int32), row, ids, score)], names=_NEGATIVE.names)

    return rows.select("row", "id", "label", "vector").mapInArrow(run, _NEGATIVE)


def _blocks(anchors: DataFrame):
    """anchors, a written table, as Arrow tables of about BLOCK_BYTES, one after the other."""
    width = F.size("vector").cast("long") * 8 + 256
    n = max(1, -(-(anchors.agg(F.sum(width)).first()[0] or 0) // BLOCK_BYTES))
    dealt = F.pmod(F.xxhash64("row"), F.lit(n))
    for k in range(n):
        yield anchors.where(dealt == k).toArrow()


def _first(df: DataFrame, keys: list[str]) -> DataFrame:
    """The first FIRST rows of each key, with their rank from 1."""
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id", "row")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= FIRST)


def hard_negatives(embeddings: DataFrame, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by every. Components count as floor(256 x), and scores are exact
    integers; beyond a long they are its ends. Rows without an id, label or vector, or with a component that is
    null or not finite, take no part. Repeated rows are rows of their own: one may be the other's positive. A
    shorter vector counts as filled up with zeros. Anchors without a positive, and positives without a negative,
    give no row; an empty table gives an empty one. Other columns are not read.
    """
    rows = valid_rows(embeddings, id_col, vector_col, label_col)
    anchors = durable(rows.where(F.col("id") % every == 0), "negatives-anchors")
    found = reduce(DataFrame.unionByName, (positives(rows, block) for block in _blocks(anchors)))
    chosen = durable(_first(found, ["anchor"]), "negatives-positives")
    scores = chosen.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("scores"))  # FIRST at most
    wanted = durable(anchors.join(scores, F.col("row") == F.col("anchor")).drop("anchor"), "negatives-wanted")
    found = reduce(DataFrame.unionByName, (negatives(rows, block) for block in _blocks(wanted)))
    ranked = durable(_first(found, ["anchor", "place"]), "negatives-found").select("anchor", (F.col("place") + 1).alias("at"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), "rank")
    release(anchors, wanted)
    named = chosen.select(F.col("anchor").alias("of"), F.col("rank").alias("at_rank"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    ids = rows.select(F.col("row").alias("anchor_row"), F.col("id").alias("anchor_id")).where(F.col("anchor_id") % every == 0)
    out = ranked.join(named, (F.col("anchor") == F.col("of")) & (F.col("at") == F.col("at_rank"))).join(ids, F.col("anchor") == F.col("anchor_row"))
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score")
