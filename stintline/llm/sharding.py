"""Operator 13, sharding: contiguous shards of near equal bytes, cut by global prefix sums. DataFrame functions only.

Documents are range-partitioned by id and sorted, once, with their texts, and written: the table as it lies
is the shards, one after the other. A row's place is its partition and its number there. Totals of each
partition, summed before it, say where each partition begins in bytes and rows; a partition in which no
cut falls lies in one shard, and only in those with a cut, fewer than there are shards, are the rows' own
sizes summed. What joins the texts again is a table with a row for each partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, release, small_enough

SHARDS = 16
#: Of a place, the bits that number the rows of a partition; Spark's own layout of such numbers.
ROW_BITS = 33
#: Bytes of a row of the table of partitions when it is broadcast, and of each cut in it.
PART_BYTES, CUT_BYTES = 96, 48


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text, none of a null, and one."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def checksum(text: Column) -> Column:
    """The unsigned CRC-32 of the text's UTF-8 bytes; of a null, that of no bytes."""
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def ordered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row (all columns of docs), size and place, written in the order of ids (nulls first).

    Rows of one id follow by size and checksum. Rows alike in all three follow as they were read, so that a
    third of all rows, even, may spread over many ranges.
    """
    keyed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.col(id_col).alias("id"),
        size_of(F.col(text_col)).alias("size"),
        checksum(F.col(text_col)).alias("sum"),
        F.monotonically_increasing_id().alias("read"),
    )
    order = ["id", "size", "sum", "read"]
    placed = keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    return durable(placed.select("row", "size", "place"), "shard-rows")


def partitions(rows: DataFrame, shards: int) -> DataFrame:
    """part, before (rows before it) and cuts: where in it a shard begins or goes on, by place; a row for each partition.

    A row belongs to the shard in whose equal share of all bytes the row's middle lies. A cut is {place, shard,
    first}, first the number of the shard's first row among all rows.
    """
    part, number = F.shiftright("place", ROW_BITS), F.col("place").bitwiseAND((1 << ROW_BITS) - 1)
    slim = rows.select("size", "place", part.alias("part"), number.alias("number"))
    totals = slim.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over partitions, not rows
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
        "bytes",
        F.sum("bytes").over(every).alias("total"),
    )

    def shard(twice: str) -> Column:
        """Of a point given as twice its byte."""
        return F.least(F.expr(f"({twice}) * {shards} div (2 * total)"), F.lit(shards - 1)).cast("int")

    totals = totals.withColumns({"low": shard("2 * bytes_before"), "high": shard("2 * (bytes_before + bytes)")})
    totals = durable(totals, "shard-totals")
    # A partition's rows, slim: as many as a task's.
    running = F.sum("size").over(Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    cut = slim.join(F.broadcast(totals.where("low < high")), "part").withColumn("upto", F.coalesce(running, F.lit(0)))
    cut = cut.withColumn("shard", shard("2 * (bytes_before + upto) + size"))
    begins = cut.groupBy("part", "before", "shard").agg(F.min("place").alias("place"), F.min("number").alias("number"))
    whole = totals.where("low = high").select("part", "before", F.col("low").alias("shard"), F.shiftleft("part", ROW_BITS).alias("place"), F.lit(0).cast("long").alias("number"))
    begins = begins.unionByName(whole)
    begins = begins.withColumn("first", F.min(F.col("before") + F.col("number")).over(Window.partitionBy("shard")))
    cuts = F.array_sort(F.collect_list(F.struct("place", "shard", "first"))).alias("cuts")
    found = durable(begins.groupBy("part", "before").agg(cuts), "shard-parts")
    release(totals)
    return found


def assign_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with shard, from 0, and slot, the row's place in its shard, gapless from 0; in the order of the id.

    Shards are contiguous: all ids of one are at least those of the one before. The bytes of two differ by no
    more than two of the longest texts. Every row is kept: null ids come first, null texts count as one byte,
    repeated rows are rows of their own (null and empty texts of one id in either order), and an id may lie on both sides of a cut. A text longer than a shard's
    share leaves shards empty. Columns of docs named shard or slot give way; an empty table gives an empty one.
    """
    rows = ordered(docs, id_col, text_col)
    parts = partitions(rows, shards).withColumnRenamed("part", "_part")
    if small_enough(parts, PART_BYTES + CUT_BYTES):
        parts = F.broadcast(parts)
    number = F.col("place").bitwiseAND((1 << ROW_BITS) - 1)
    found = rows.join(parts, F.shiftright("place", ROW_BITS) == F.col("_part"))
    found = found.withColumn("cut", F.element_at(F.filter("cuts", lambda c: c["place"] <= F.col("place")), -1))
    own = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("shard", "slot")]
    return found.select(*own, F.col("cut.shard").alias("shard"), (F.col("before") + number - F.col("cut.first")).alias("slot"))


def write_shards(assigned: DataFrame, path: str) -> None:
    """Write assigned documents as Parquet, a folder shard=K for each shard; slot tells the order in it."""
    assigned.write.partitionBy("shard").parquet(path)
