"""Nearest neighbours by cosine: a stated set of queries against all vectors, in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most bytes of queries, or of vectors, that a task holds.
BLOCK_BYTES = 32 << 20
#: Tasks that pairs of blocks and parts are dealt to, at most.
MOST_TASKS = 2000


def write_vectors(rows: DataFrame, path: str, id_col: str = "id", vector_col: str = "embedding") -> None:
    """Write a table of vectors, each of unit length (null for a zero vector), with all other columns; the
    first row of each id, by the rest of it, stays."""
    others = [c for c in rows.columns if c not in (id_col, vector_col)]
    kept = rows.groupBy(id_col).agg(F.min(F.struct(*others, vector_col)).alias("_r")).select(id_col, "_r.*")
    kept.withColumn(vector_col, unit(F.col(vector_col))).write.mode("overwrite").parquet(path)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector over its length, in doubles; null for a zero vector."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm))


#: What stands for a similarity while pairs are ranked: none for a vector without direction or of another width, NaN above all, and no pair.
NONE, ODD, OUT = -3.0, 3.0, -np.inf


def _units(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """width -> places and unit vectors of the table's rows of that width; rows without a direction are in none."""
    held = table.column("v").combine_chunks()
    held = held.chunk(0) if isinstance(held, pa.ChunkedArray) else held
    there = np.flatnonzero(np.asarray(held.is_valid()))
    widths = np.asarray(held.value_lengths().fill_null(0))[there]
    values = held.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate(([0], np.cumsum(widths)))
    return {int(w): (there[widths == w], values[starts[:-1][widths == w][:, None] + np.arange(w)]) for w in np.unique(widths)}


def _best(k: int):
    """The k rows of the right most similar to each query of the left, by similarity and id."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = pa.schema([("query_id", left.schema.field("id").type), ("id", left.schema.field("id").type), ("similarity", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return kinds.empty_table()
        right = right.sort_by("id")  # of equal similarities the first has the least id
        asked, rows = left.column("id").to_numpy(), right.column("id").to_numpy()
        ql, rl = _units(left), _units(right)
        at, near, told = [], [], []
        step = max(1, (16 << 20) // (8 * len(rows)))
        for begin in range(0, len(asked), step):
            ids = asked[begin : begin + step]
            score = np.full((len(ids), len(rows)), NONE)
            for w in ql.keys() & rl.keys():
                mine = (ql[w][0] >= begin) & (ql[w][0] < begin + step)
                found = np.round(ql[w][1][mine] @ rl[w][1].T, 9)
                score[np.ix_(ql[w][0][mine] - begin, rl[w][0])] = np.where(np.isnan(found), ODD, found)
            score[ids[:, None] == rows[None, :]] = OUT
            every = np.arange(len(ids))
            for _ in range(min(k, len(rows))):
                best = score.argmax(axis=1)
                value = score[every, best]
                there = value > OUT
                at.append(every[there] + begin)
                near.append(best[there])
                told.append(value[there])
                score[every, best] = OUT
        at, near, told = map(np.concatenate, (at, near, told))
        similarity = pa.array(np.where(told == ODD, np.nan, told), mask=told == NONE)
        return pa.table([left.column("id").take(pa.array(at)), right.column("id").take(pa.array(near)), similarity], schema=kinds)

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = 32, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, id, similarity and place of the k vectors most similar to each query, itself left out.

    Queries and vectors are dealt to blocks of at most block_bytes, found from their number and width (vectors to
    parts of them at least); a task multiplies a block by a part. Of each part of the vectors, no more than the k
    best for a query are shuffled.
    """

    def dealt(rows: DataFrame, least: int, name: str) -> tuple[DataFrame, int]:
        held = rows.select(F.col(id_col).alias("id"), unit(F.col(vector_col)).alias("v")).where("id IS NOT NULL")
        size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size(vector_col)), F.lit(0)).alias("width")).first()
        n = max(1, min(least, size["n"]), -(-size["n"] * (8 * max(0, size["width"]) + 40) * 2 // block_bytes))  # twice, as hashing is uneven
        return held.withColumn(name, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")), n

    q, blocks = dealt(queries, 1, "_block")
    v, parts = dealt(vectors, parts, "_part")
    q = q.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    v = v.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    kind = vectors.schema[id_col].dataType.simpleString()
    pairs = blocks * parts
    q, v = (side.repartition(min(pairs, MOST_TASKS), "_block", "_part") for side in (q, v))
    best = q.groupBy("_block", "_part").cogroup(v.groupBy("_block", "_part")).applyInArrow(_best(k), f"query_id {kind}, id {kind}, similarity double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), F.col("id")))
    return best.withColumn("place", place).where(F.col("place") <= k)
