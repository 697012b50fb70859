"""Keyed ingest of a stream of files: each key once, however often its rows are delivered, at a cost that follows the batch.

The table is hashed into buckets by key, and each file of a bucket is named in the published version with the
range of its keys' hashes and a filter of them. A batch is hashed the same way; of the stored files it only opens
those whose bucket and filter may hold one of its keys, so that what a small batch reads does not grow with the
table. A bucket of which a batch has many rows is opened without asking its filters, which would let some of them
through anyway. Rows and stored keys are dealt by bucket once, and meet there. A version is published last: a
batch that fails before leaves nothing behind, and one that is run again finds its keys and adds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.versions import Version, Versions

BUCKETS = 64
#: Bits of a file's filter for each key, and hash functions: some 1 % of other keys pass.
FILTER_BITS, FILTER_HASHES = 10, 7
#: Words of 32 bits that a filter has at most; fuller filters let more through, never less.
MOST_WORDS = 1 << 16
#: Rows that a batch may have of a bucket to be looked up in its filters.
PROBED = 1000
BEFORE_COMMIT = "before commit"


class Broken(Exception):
    """A load that was made to fail."""


def key_hash(key: list[str]) -> Column:
    return F.xxhash64(*key)


def _hashed(rows: DataFrame, key: list[str]) -> DataFrame:
    rows = rows.withColumn("_hash", key_hash(key))
    return rows.withColumn("_bucket", F.pmod("_hash", F.lit(BUCKETS)).cast("int"))


def _bit(h: Column, i: Column, bits: Column) -> Column:
    """The i-th bit of a key in a filter of so many bits."""
    return F.pmod(F.xxhash64(h, i), bits).cast("int")


def filters(rows: DataFrame) -> DataFrame:
    """_bucket, batch, n, low, high, bits and words of each bucket of hashed rows: its filter, 32 bits a word.

    Bits are found and put together by words, so that no task holds a bucket's keys. All words are there, in their
    order, those without a bit, too.
    """
    sizes = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"), F.min("_hash").alias("low"), F.max("_hash").alias("high"))
    sizes = sizes.withColumn("bits", F.least(F.lit(32 * MOST_WORDS), 32 * F.ceil(F.col("n") * FILTER_BITS / 32)).cast("int"))
    set_bits = rows.join(F.broadcast(sizes.select("_bucket", "bits")), "_bucket")  # BUCKETS rows
    set_bits = set_bits.withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(FILTER_HASHES)))).withColumn("_at", _bit(F.col("_hash"), F.col("_i"), F.col("bits")))
    set_bits = set_bits.select("_bucket", F.floor(F.col("_at") / 32).cast("int").alias("w"), F.expr("shiftleft(1L, _at % 32)").alias("v"))
    blank = sizes.select("_bucket", F.explode(F.sequence(F.lit(0), (F.col("bits") / 32 - 1).cast("int"))).alias("w"), F.lit(0).cast("long").alias("v"))
    words = set_bits.unionByName(blank).groupBy("_bucket", "w").agg(F.bit_or("v").alias("v"))
    lists = words.groupBy("_bucket").agg(F.array_sort(F.collect_list(F.struct("w", "v"))).alias("words"))  # MOST_WORDS at most
    return sizes.join(lists.select("_bucket", F.col("words.v").alias("words")), "_bucket")


def may_hold(h: Column, words: Column, bits: Column) -> Column:
    """Whether a filter may hold the key."""
    out = F.lit(True)
    for i in range(1, FILTER_HASHES + 1):
        at = _bit(h, F.lit(i), bits)
        out = out & (F.getbit(F.get(words, F.floor(at / 32).cast("int")), at % 32) == 1)
    return out


def _files(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """All rows in folders, however they lie there."""
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*paths)


def table(spark: SparkSession, target: str, schema: T.StructType, version: Version | None = None) -> DataFrame:
    """The rows of a version of the table."""
    version = version or Versions(spark, target).current()
    return _files(spark, version.folders.get("rows", []), schema)


def stored_keys(spark: SparkSession, versions: Versions, version: Version, fresh: DataFrame, schema: T.StructType, key: list[str]) -> tuple[DataFrame, list[str]]:
    """Keys of the stored files that may hold a key of fresh (hashed), and these files' folders: BUCKETS for each
    batch at most are looked at, by their filters alone if fresh has no more than PROBED rows of the bucket."""
    named = version.folders.get("filters", [])
    empty = spark.createDataFrame([], T.StructType([schema[k] for k in key]))
    if not named:
        return empty, []
    held = spark.read.parquet(*named)
    sizes = {r["_bucket"]: r["n"] for r in fresh.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")).collect()}  # BUCKETS at most
    few = [b for b, n in sizes.items() if n <= PROBED]
    hit = held.where(F.col("_bucket").isin([b for b in sizes if b not in few])).select("folder")
    if few:
        keys = fresh.where(F.col("_bucket").isin(few)).select("_hash", "_bucket").distinct()  # PROBED for each bucket at most
        inside = (F.col("_hash") >= F.col("low")) & (F.col("_hash") <= F.col("high"))
        found = held.join(F.broadcast(keys), "_bucket").where(inside & may_hold(F.col("_hash"), F.col("words"), F.col("bits")))
        hit = hit.unionByName(found.select("folder"))
    folders = [r["folder"] for r in hit.distinct().collect()]  # BUCKETS for each batch at most
    return _files(spark, folders, empty.schema), folders


def append(spark: SparkSession, target: str, batch: DataFrame, key: list[str], fail: str | None = None) -> Version:
    """Add the rows of batch whose key the table lacks; of rows of one key in the batch, any one.

    Rows with a null in their key count as having one key like any other.
    """
    versions = Versions(spark, target)
    base = versions.current()
    fresh = _hashed(batch, key)
    keys, _ = stored_keys(spark, versions, base, fresh, batch.schema, key)
    rows = fresh.withColumn("_held", F.lit(False)).unionByName(_hashed(keys, key).withColumn("_held", F.lit(True)), allowMissingColumns=True)
    kept = [F.first(c).alias(c) for c in fresh.columns if c not in (*key, "_bucket")]
    one = rows.repartition("_bucket").groupBy("_bucket", *key).agg(*kept, F.max("_held").alias("_held"))
    path = versions.new_folder("rows")
    one.where("NOT _held").select(fresh.columns).write.partitionBy("_bucket").parquet(path)
    at = spark.read.schema("_hash LONG, _bucket INT").parquet(path)
    if at.isEmpty():
        return base
    marks = versions.new_folder("filters")
    filters(at).withColumn("folder", F.concat(F.lit(f"{path}/_bucket="), F.col("_bucket"))).write.parquet(marks)
    if fail == BEFORE_COMMIT:
        raise Broken(target)
    return versions.commit(base, {"rows": [*base.folders.get("rows", []), path], "filters": [*base.folders.get("filters", []), marks]})


def run(spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str, key: list[str], fail: str | None = None) -> None:
    """Load the files that have arrived since the last run into the table; what fails is loaded by the next run."""
    rows = spark.readStream.schema(schema).parquet(source)
    broken: list[Exception] = []

    def load(batch: DataFrame, _: int) -> None:
        try:
            append(batch.sparkSession, target, batch, key, fail)
        except Broken as e:
            broken.append(e)
            raise

    query = rows.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except Exception:
        if broken:
            raise broken[0] from None
        raise
