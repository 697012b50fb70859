"""Shared pieces of the training-data operators: table access, durable stages and Arrow row mapping."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows handed to a row function at once; bounds the Python objects alive in a worker.
SLICE = 256
#: Rows of an Arrow batch at most: rows may be long, and the JVM and the worker each hold a batch.
BATCH_ROWS = 1024
#: Largest table, in bytes, that an operator sends to every executor.
BROADCAST_BYTES = 32 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by BATCH_ROWS, unless they are bounded more tightly already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stage_root(spark: SparkSession) -> str:
    """The shared folder for tables between jobs: spark.checkpoint.dir, else one of our own.

    Where the setting is missing, a local session (tests) uses /tmp/checkpoints and a cluster its
    warehouse, which all executors reach.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        root = "file:///tmp/checkpoints" if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_stages"
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"


#: Folders that durable() wrote in this process, in order.
_written: list[str] = []


def durable(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: later jobs don't recompute it, and
    a lost executor costs nothing that was written."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stage_path = path
    _written.append(path)
    return table


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(*tables: DataFrame) -> None:
    """Delete tables of durable() that nothing yet to run reads."""
    for table in tables:
        _delete(table.sparkSession, table.stage_path)


@contextmanager
def temporary(spark: SparkSession):
    """Delete at the end what durable() writes inside, but for the tables given to the function that this yields."""
    mark, kept_paths = len(_written), set()

    def lasting(table: DataFrame) -> DataFrame:
        kept_paths.add(table.stage_path)
        return table

    try:
        yield lasting
    finally:
        for path in _written[mark:]:
            if path not in kept_paths:
                _delete(spark, path)
        del _written[mark:]


def drop_stages(spark: SparkSession) -> None:
    """Delete every table that durable() has written in this session and that was not released."""
    _delete(spark, stage_root(spark))


def kept(key: tuple, make: Callable):
    """What make() returned the first time in this process: for models and caches that the tasks of
    a Python worker share. Functions travel by value, so a module's own globals would not last."""
    held = sys.__dict__.setdefault("_stintline_kept", {})
    if key not in held:
        held[key] = make()
    return held[key]


class Recent(dict):
    """A cache of make(key) with at most 2 * cap entries, from which what is not asked for goes first."""

    def __init__(self, cap: int = 100_000):
        super().__init__()
        self.cap, self.old = cap, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.cap:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def map_rows(df: DataFrame, columns: list[str], make: Callable[[], Callable], schema: T.StructType) -> DataFrame:
    """Map the named columns, in slices of SLICE rows, to rows of schema.

    make() runs once in each task and returns a function that takes one list for each column and
    returns one list for each field of schema; all lists it returns have the same length.
    """
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                out = fn(*(part.column(i).to_pylist() for i in range(len(columns))))
                yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(out, arrow, strict=True)], schema=arrow)

    return df.select(*columns).mapInArrow(run, schema)


def small_enough(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether df, at so many bytes a row, may be broadcast; df should be durable, as it is counted."""
    return df.count() * row_bytes <= limit
