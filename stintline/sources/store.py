"""Tables that are built once and read by many queries, in a folder that the whole cluster reaches."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Layout:
    """How a table lies on disk: folders by partition, files by bucket, rows by sort.

    Buckets let windows, aggregates and joins on their column run without a shuffle.
    """

    partition: tuple[str, ...] = ()
    bucket: str | None = None
    sort: tuple[str, ...] = ()


#: Tables that sessions, drivers and laps are looked up in. season is taken from the session's id.
LAYOUTS = {"laps": Layout(partition=("season",), bucket="session_id")}


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else a folder of our own: a local session's under /tmp, a cluster's in its warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        local = spark.sparkContext.master.split("[")[0] == "local"
        root = "file:///tmp/checkpoints" if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_stages"
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"


#: Laps of a bucket, at least and at most.
BUCKET_LAPS = 15_000, 150_000


def buckets_for(laps: int, cores: int) -> int:
    """Buckets that all cores share in, of a size that doesn't grow with the table."""
    return max(1, min(cores, laps // BUCKET_LAPS[0]), laps // BUCKET_LAPS[1])


def files_for(laps: int, cores: int) -> int:
    """Files of a table that isn't bucketed, so that what is made of its rows runs on all cores once it is large."""
    return max(1, min(cores, laps // BUCKET_LAPS[1]))


def write(df: DataFrame, path: str, layout: Layout = Layout(), buckets: int = 8, dealt: bool = False) -> None:
    """Write a table under path. Bucketed tables enter the session's catalog under a name made from the path; dealt
    says that df's partitions are the buckets already."""
    if layout.bucket is None:
        df.write.partitionBy(*layout.partition).parquet(path) if layout.partition else df.write.parquet(path)
        return
    writer = (df if dealt else df.repartition(buckets, layout.bucket)).write.format("parquet").option("path", path)
    if layout.partition:
        writer = writer.partitionBy(*layout.partition)
    writer.bucketBy(buckets, layout.bucket).sortBy(*(layout.sort or (layout.bucket,))).saveAsTable(table_name(path))


def table_name(path: str) -> str:
    return "built_" + uuid.uuid5(uuid.NAMESPACE_URL, path).hex


def read(spark: SparkSession, path: str, layout: Layout = Layout(), schema: T.StructType | None = None) -> DataFrame:
    """The table under path; of a known schema no file is opened before the query runs."""
    if layout.bucket is not None:
        return spark.table(table_name(path))
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def with_season(laps: DataFrame) -> DataFrame:
    """laps with season, the first part of the session's id: what they are partitioned by."""
    return laps.withColumn("season", F.split_part("session_id", F.lit("|"), F.lit(1)).cast("int"))


class Store:
    """Tables by name, each built on first use and then read back.

    build makes a table from the store itself, so that a table may draw on others. What is written
    stays valid for the session: a lost executor costs nothing, and queries don't build twice.
    """

    def __init__(self, spark: SparkSession, root: str, build: dict[str, Callable[[Store], DataFrame]], laps: int = 0, views: tuple[str, ...] = ()):
        self.spark, self.root, self.build, self.views = spark, root, build, views
        cores = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.buckets, self.files = buckets_for(laps, cores), files_for(laps, cores)
        self.there: set[str] = set()
        self.schemas: dict[str, T.StructType] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name in self.views:  # made from a stored table's rows, and not stored itself
            return self.build[name](self)
        layout, path = LAYOUTS.get(name, Layout()), f"{self.root}/{name}"
        if name not in self.there:
            df = self.build[name](self)
            df = df.repartition(self.files) if layout.bucket is None else df
            write(with_season(df) if layout.partition == ("season",) and "season" not in df.columns else df, path, layout, self.buckets, name == "laps")
            self.there.add(name)
        found = read(self.spark, path, layout, self.schemas.get(name))
        self.schemas[name] = found.schema
        return found

    def lean(self, name: str) -> DataFrame:
        """The table without the column that only its layout has."""
        return self[name].drop("season") if name == "laps" else self[name]
