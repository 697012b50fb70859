"""Operator 7, token-ID output: Parquet files with a list column of ids, in ascending document order.

Texts are range-partitioned by id, sorted and then encoded, so each text is shuffled once and encoded
once. A file holds, for each document, its ids as a list (dictionary-encoded: ids take two bytes or less),
and its metadata as delta-encoded integers. Row groups are bounded, pages small, and the format's page
indexes are written, so that a reader of a few documents, or of the metadata alone, skips the rest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import SLICE
from .tokens import shared_ids

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
#: Pre-tokens in the older and the newer half of a worker's cache, 200 bytes each.
CACHE = 250_000
#: Parquet settings: bounded row groups, small pages with indexes, a dictionary for ids, deltas for metadata.
OPTIONS = {
    "compression": "zstd",
    "parquet.block.size": str(ROW_GROUP_BYTES),
    "parquet.page.size": str(PAGE_BYTES),
    "parquet.page.row.count.limit": "2000",
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "true",
    **{f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "part_start", "n_tokens")},
}


def file_schema(id_type: T.DataType) -> T.StructType:
    """doc_id; part, the file's place in the order; part_start, the ids before it in its part; its ids."""
    return T.StructType([T.StructField("doc_id", id_type), T.StructField("part", T.IntegerType()), T.StructField("part_start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of every whole text, each followed by end_id, to Parquet files under path.

    A null or empty text has the end id alone (or no ids). Rows are in ascending id order, nulls
    first; rows that share an id follow each other by the hash of their text. Other columns of
    docs are not read. An empty table writes no rows. A lost task is encoded again from the shuffle.
    """
    schema = file_schema(docs.schema[id_col].dataType)
    arrow = to_arrow_schema(schema)
    end = b"" if end_id is None else end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, start, encoder = TaskContext.get().partitionId(), 0, shared_ids(vocabulary, CACHE)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                rows = batch.slice(at, SLICE)
                data, offsets, starts = [], [0], []
                for text in rows.column(1).to_pylist():
                    data.append(encoder.encode(text, end))
                    starts.append(start)
                    n = len(data[-1]) // 4
                    offsets.append(offsets[-1] + n)
                    start += n
                values = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(data))])
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values).cast(arrow.field("ids").type)
                sizes = [b - a for a, b in zip(offsets, offsets[1:])]
                columns = [rows.column(0).cast(arrow.field(0).type), pa.array([part] * len(sizes), pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), ids]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    tie = F.xxhash64("_text")
    ordered = slim.repartitionByRange("_id", tie).sortWithinPartitions("_id", tie).select("_id", "_text")
    ordered.mapInArrow(run, schema).write.options(**OPTIONS).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with start, the ids of all documents before each: part_start and the
    total of the parts before, from a row for each part."""
    files = spark.read.parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = totals.select(F.col("part").alias("_part"), before.alias("_base"))  # as many rows as shuffle partitions
    return files.join(F.broadcast(bases), F.col("part") == F.col("_part")).withColumn("start", F.col("_base") + F.col("part_start")).drop("_part", "_base")


def token_digests(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of the rows of read_tokens(), the last from the ids read."""
    kind = files.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            offsets = lists.offsets.to_pylist()
            data = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)).cast("B")
            sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offsets, offsets[1:])]
            sizes = [b - a for a, b in zip(offsets, offsets[1:])]
            columns = [batch.column(0).cast(arrow.field(0).type), batch.column(1), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return files.select("doc_id", "start", "ids").mapInArrow(run, schema)
