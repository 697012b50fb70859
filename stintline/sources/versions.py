"""Tables published together: data in folders that never change, and a numbered pointer written last.

A version is a small file that names the folders of all tables. Readers take the newest pointer and keep to
it, so that what they read is of one version and stays as it is while others are published; a job that fails
before its pointer is written changes nothing. Two writers of one number don't overwrite each other: the second
one's pointer isn't accepted, and it tries again on the newer state.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(Exception):
    """Another writer has published this version meanwhile."""


@dataclass(frozen=True)
class Version:
    """number, 0 before anything is published, and for each table its folders."""

    number: int
    folders: dict[str, list[str]]


class Versions:
    """The versions under a root, in any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        at, fs = self._at(f"{self.root}/pointers")
        if not fs.exists(at):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(at)]
        return sorted(int(n) for n in names if n.isdigit())

    def current(self) -> Version:
        held = self.numbers()
        return self.version(held[-1]) if held else Version(0, {})

    def version(self, number: int) -> Version:
        lines = self.spark.read.text(f"{self.root}/pointers/{number:010d}").collect()  # one line
        return Version(number, json.loads(lines[0]["value"]))

    def new_folder(self, table: str) -> str:
        return f"{self.root}/data/{uuid.uuid4().hex}/{table}"

    def commit(self, base: Version, folders: dict[str, list[str]]) -> Version:
        """Publish folders as the version after base; Conflict if that one is there already."""
        number = base.number + 1
        at, fs = self._at(f"{self.root}/pointers/{number:010d}")
        new, _ = self._at(f"{self.root}/pointers/.{uuid.uuid4().hex}")
        fs.mkdirs(at.getParent())
        out = fs.create(new, False)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        if fs.exists(at) or not fs.rename(new, at):
            fs.delete(new, False)
            raise Conflict(f"version {number} of {self.root}")
        return Version(number, folders)

    def publish(self, tables: dict[str, DataFrame | str]) -> Version:
        """Publish tables together: a DataFrame is written, a path is the folder of a table that never changes."""
        base, folders = self.current(), {}
        for name, table in tables.items():
            folders[name] = [table if isinstance(table, str) else self.new_folder(name)]
            if not isinstance(table, str):
                table.write.parquet(folders[name][0])
        while True:
            try:
                return self.commit(base, folders)
            except Conflict:
                base = self.current()

    def read(self, version: Version, table: str, schema=None) -> DataFrame:
        """A table of a version; with a schema, one that isn't there yet is empty."""
        paths = version.folders.get(table, [])
        if not paths and schema is not None:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(*paths)

    def clean(self, keep: int = 2) -> None:
        """Delete pointers but for the last so many, and folders under the root that none of these names.

        Readers of older versions, and writers that have yet to publish, must be done by then.
        """
        held = self.numbers()
        named = {p.removeprefix(f"{self.root}/data/").split("/")[0] for n in held[-keep:] for ps in self.version(n).folders.values() for p in ps}
        for n in held[:-keep]:
            at, fs = self._at(f"{self.root}/pointers/{n:010d}")
            fs.delete(at, False)
        at, fs = self._at(f"{self.root}/data")
        for f in fs.listStatus(at) if fs.exists(at) else []:
            if f.getPath().getName() not in named:
                fs.delete(f.getPath(), True)


def rows_of(versions: Versions, version: Version) -> DataFrame:
    """name and n: the number of rows of each table of a version."""
    counts = [versions.read(version, name).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for name in version.folders]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out
