"""Sources and sinks: JSON lines (tolerant and strict), Parquet tables with keys, and text reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: T.StructType, strict: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(rows, malformed lines). Blank lines are skipped; strict raises on the first malformed line."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(paths), None
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    lines = spark.read.text(paths).where("trim(value) <> ''")
    parsed = lines.select("value", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r"))
    bad = F.col("r").isNull() | F.col(f"r.{CORRUPT}").isNotNull()
    return parsed.where(~bad).select(*(f"r.{f.name}" for f in schema)), parsed.where(bad).select("value")


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """Write rows as JSON lines, without columns whose names begin with an underscore."""
    kept = [c for c in df.columns if not c.startswith("_")]
    df.select(*kept).write.mode("append" if append else "errorifexists").json(path)


def rewrite_jsonl(spark: SparkSession, path: str, change) -> None:
    """Replace a folder of JSON lines by change(its rows), a DataFrame of the same kind.

    The first time, what was there stays beside it as path.bak. The new rows are written whole before the old
    ones go, so that no table is overwritten while it is read.
    """
    jvm = spark._jvm
    at, new, kept = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.new", f"{path}.bak"))
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(new, True)
    change(spark.read.json(path)).write.json(f"{path}.new")
    if fs.exists(kept):
        fs.delete(at, True)
    else:
        fs.rename(at, kept)
    fs.rename(new, at)


def dataset_paths(spark: SparkSession, folder: str) -> list[str]:
    """JSON-lines files of a folder in any store Spark reads, but for cleaned ones and backups."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)
    names = [f.getPath().toString() for f in files]
    return sorted(n for n in names if n.endswith(".jsonl") and "clean" not in n.rsplit("/", 1)[-1] and ".bak" not in n.rsplit("/", 1)[-1])


def append_new(rows: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key the existing table doesn't hold: what an idempotent load appends."""
    return rows.join(existing.select(*key).distinct(), key, "left_anti")


def surrogate_key(*columns: str):
    """A stable id from a logical key."""
    return F.sha2(F.concat_ws("|", *columns), 256)


def write_report(lines: DataFrame, path: str) -> None:
    """Write a report's lines (place, line), some dozens, as one text file in their order."""
    lines.repartition(1).sortWithinPartitions("place").select("line").write.mode("overwrite").text(path)
