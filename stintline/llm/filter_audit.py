"""Operator 12, filter interaction audit: what each of five filters removes, in every order of applying them.

A text is scanned once, in the buffers of its Arrow batch, and becomes a mask of the filters it fails. Documents
are counted by part, mask and labels, some hundreds of counts for each part; what a filter removes after any set
of others follows from these counts, and each of the 120 orders reads it off for its steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_scan import scan

FILTERS = "ABCDE"
BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
#: Fewest words, least share of distinct words and greatest share of capitals, in percent.
FEW_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT = 100, 80, 10

_MASKED = T.StructType([
    T.StructField("doc", T.LongType()), T.StructField("part", T.StringType()),
    T.StructField("h", T.LongType()), T.StructField("g", T.LongType()), T.StructField("mask", T.IntegerType()),
])


def text_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """doc, part ('' for null), h and g (a 128-bit hash of the text) and mask, the bits of A to D that it fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from xxhash import xxh3_128_digest

        for batch in batches:
            if not batch.num_rows:
                continue
            doc, part, text = batch.columns
            n = scan(text)
            mask = (n["words"] < FEW_WORDS) * BIT["A"] + (100 * n["distinct"] < DISTINCT_PERCENT * n["words"]) * BIT["B"]
            mask += (100 * n["capitals"] > CAPITALS_PERCENT * n["chars"]) * BIT["C"] + (n["symbols"] > 0) * BIT["D"]
            sums = b"".join(xxh3_128_digest(x.as_buffer() or b"" if x.is_valid else b"") for x in text)
            halves = np.frombuffer(sums, "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([doc, part.fill_null(""), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(mask, pa.int32())], names=_MASKED.names)

    return docs.select(F.col(id_col).cast("long"), F.col(part_col).cast("string"), F.col(text_col)).mapInArrow(run, _MASKED)


def document_flags(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc, good and toxic: whether any label of the document says so. Labels without an id are none's."""
    said = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("label_doc"))
    return said.agg(*(F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))))


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, mask (of all five filters), good, toxic and n, the number of documents: at most 128 rows a part.

    Copies of a text are first counted by document, part and labels, then by part and labels, so that a text
    that a third of all documents share is a few rows when its smallest id is looked for.
    """
    masked = text_masks(docs, id_col, text_col, part_col).groupBy("h", "g", "doc", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    told = masked.join(document_flags(labels), F.col("doc") == F.col("label_doc"), "left")
    told = told.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    alike = told.groupBy("h", "g", "part", "mask", "good", "toxic").agg(
        F.min("doc").alias("least"),
        F.sum("n").alias("n"),
        F.min_by(F.when(F.col("doc").isNotNull(), F.col("n")), "doc").alias("at_least"),
        F.coalesce(F.sum(F.when(F.col("doc").isNull(), F.col("n"))), F.lit(0)).alias("unnamed"),
    )
    one = alike.withColumn("smallest", F.min("least").over(Window.partitionBy("h", "g")))  # a row for each part and labels of the text
    first = F.when(F.col("least") == F.col("smallest"), F.col("at_least")).otherwise(F.lit(0)) + F.col("unnamed")
    split = F.array(F.struct(F.col("mask"), first.alias("n")), F.struct((F.col("mask") + BIT["E"]).alias("mask"), (F.col("n") - first).alias("n")))
    counted = one.select("part", "good", "toxic", F.explode(split).alias("s")).select("part", "good", "toxic", "s.*").where("n > 0")
    return counted.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def _steps() -> list[tuple[str, int, int, int]]:
    """(order, step, the step's filter, the filters before it) for every order and step."""
    return [(order := "".join(p), k + 1, BIT[p[k]], sum(BIT[f] for f in p[:k])) for p in permutations(FILTERS) for k in range(len(p))]


def _removals() -> list[tuple[int, int, int]]:
    """(filter, filters before it, the number of orders in which it comes right after just these)."""
    n = len(FILTERS)
    return [(b, s, factorial(s.bit_count()) * factorial(n - 1 - s.bit_count())) for b in BIT.values() for s in range(1 << n) if not s & b]


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows a part.

    A null text is empty, and a copy of any other empty one. A null part is the empty string's. A document
    without an id is nobody's copy, and nobody is its; repeated rows of one id are no copies of each other, but
    each counts. Texts count as identical by a 128-bit hash. A text of any length is scanned whole, in memory in
    proportion to it. Other columns are not read; an empty table has no parts, and so no rows.
    """
    spark = docs.sparkSession
    counts = mask_counts(docs, labels, id_col, text_col, part_col)
    removals = F.array(*(F.struct(F.lit(b).alias("own"), F.lit(s).alias("before"), F.lit(w).alias("weight")) for b, s, w in _removals()))
    each = counts.withColumn("x", F.explode(removals)).select("part", "mask", "good", "toxic", "n", "x.*")
    fails, gone = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0

    def total(of):
        return F.sum(F.when(of, F.col("n")).otherwise(0))

    sets = each.groupBy("part", "own", "before", "weight").agg(
        total(~fails & ~gone).alias("kept"),
        total(fails & ~gone).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(F.col("mask") == F.col("own")).alias("unique_fails"),
        total(fails & ~gone & F.col("good")).alias("good_lost"),
        total(fails & ~gone & F.col("toxic")).alias("toxic_lost"),
    )
    worth = sets.groupBy("part", "own").agg(F.sum(F.col("weight") * F.col("removed")).alias("shapley"))
    steps = spark.createDataFrame(_steps(), "filter_order string, step int, own int, before int")  # 600 fixed rows
    found = sets.join(worth, ["part", "own"]).join(F.broadcast(steps), ["own", "before"])
    return found.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
