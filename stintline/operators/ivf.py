"""An inverted-file index of vectors by cosine: lists of rows near a centroid, of which a search reads a few.

Centroids are fitted on a bounded sample; every row is stored, in the list of its nearest centroid. A search finds
the lists nearest to each query, reads these alone, and ranks their rows exactly. How many lists it takes for
the wanted recall is measured when the index is built, on a bounded sample of its own rows against a search of
all lists. Lists are folders named by a published version: an upsert rewrites those that it touches, and readers
keep to theirs. A search of all lists is exact, as is knn.nearest() without an index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.versions import Version, Versions
from .knn import unit

#: Rows that centroids are fitted on, rows that the recall is measured with, and lists, at most.
SAMPLE, MEASURED, LISTS = 20_000, 200, 1024
#: Rows of a list that are held in a task at once, about.
PART_ROWS = 20_000
RECALL = 0.95
ROW = "id long, list int, v array<double>"


def _drawn(rows: DataFrame, most: int, seed: str) -> DataFrame:
    """At most so many rows, the same on any cluster."""
    return rows.withColumn("_draw", F.md5(F.concat_ws("|", F.lit(seed), F.col("id")))).orderBy("_draw", "id").limit(most).drop("_draw")


def _near_lists(vectors: DataFrame, centroids: np.ndarray, n: int) -> DataFrame:
    """vectors (id, v) with lists, their n nearest centroids in order."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)  # LISTS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                width = shared.value.shape[1]
                m = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                near = np.argsort(-(m @ shared.value.T), axis=1, kind="stable")[:, :n].astype(np.int32)
                lists = pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * near.shape[1], near.ravel())
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["id", "v", "lists"])

    return vectors.select("id", "v").mapInArrow(run, "id long, v array<double>, lists array<int>")


def _unit_rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and v of unit length; rows without an id or a direction are left out, of repeated ids the least vector stays."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), unit(F.col(vector_col)).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    return rows.groupBy("id").agg(F.min("v").alias("v"))


class Index:
    """An index under a root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.versions = spark, Versions(spark, root)

    def build(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL) -> Version:
        """Index all vectors, which are of one width; measures and stores how many lists a search has to read."""
        path = self.versions.new_folder("unit")
        _unit_rows(vectors, id_col, vector_col).write.parquet(path)
        rows = self.spark.read.parquet(path)
        n = rows.count()
        k = int(max(1, min(LISTS, np.sqrt(n))))
        sample = _drawn(rows, SAMPLE, "fit").select(array_to_vector("v").alias("features"))
        fitted = KMeans(k=k, seed=7, maxIter=12, distanceMeasure="cosine").fit(sample) if n > 1 else None
        centres = np.array([c / max(np.linalg.norm(c), 1e-12) for c in fitted.clusterCenters()]) if n > 1 else np.array([r["v"] for r in rows.collect()])
        self._put({}, rows, centres, Version(self.versions.current().number, {}), {"centroids": centres.tolist(), "probe": len(centres)})
        asked = _drawn(rows, MEASURED, "measure").select("id", "v")
        truth = self.search(asked, 5, "id", "v", probe=len(centres)).select(F.col("query_id").alias("q"), F.col("id").alias("i"))
        place = self._list_places(rows, asked, truth, centres)
        found = place.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("place", recall, 10_000).alias("p")).first()
        version = self.versions.current()
        return self._put({}, None, centres, version, {"centroids": centres.tolist(), "probe": int(found["p"] or 0) + 1})

    def _list_places(self, rows: DataFrame, asked: DataFrame, truth: DataFrame, centres: np.ndarray) -> DataFrame:
        """For each true neighbour, the place of its list among its query's: what a search must probe to find it."""
        order = _near_lists(asked, centres, len(centres)).select(F.col("id").alias("q"), "lists")
        own = _near_lists(rows.join(truth.select(F.col("i").alias("id")).distinct(), "id", "left_semi"), centres, 1).select(F.col("id").alias("i"), F.get("lists", F.lit(0)).alias("list"))
        return truth.join(order, "q").join(own, "i").select((F.array_position("lists", F.col("list")) - 1).alias("place"))

    def _put(self, kept: dict, rows: DataFrame | None, centres: np.ndarray, base: Version, meta: dict | None) -> Version:
        """Publish base with the lists of rows in the place of those of the same number."""
        folders = {**base.folders, **kept}
        if meta is not None:
            path = self.versions.new_folder("meta")
            self.spark.createDataFrame([(meta["centroids"], meta["probe"])], "centroids array<array<double>>, probe int").coalesce(1).write.parquet(path)
            folders["meta"] = [path]
        if rows is not None:
            path = self.versions.new_folder("lists")
            listed = _near_lists(rows, centres, 1).select("id", "v", F.get("lists", F.lit(0)).alias("list"))
            listed.repartition("list", F.pmod(F.xxhash64("id"), F.lit(16))).write.partitionBy("list").parquet(path)
            for r in self.spark.read.parquet(path).select("list").distinct().collect():  # LISTS at most
                folders[f"list-{r['list']}"] = [f"{path}/list={r['list']}"]
        return self.versions.commit(base, folders)

    def _meta(self, version: Version) -> tuple[np.ndarray, int]:
        row = self.versions.read(version, "meta").first()
        return np.array(row["centroids"]), row["probe"]

    def rows(self, version: Version, lists: list[int] | None = None) -> DataFrame:
        """id, list and v of the lists named, or of all."""
        parts = []
        wanted = [int(n.split("-")[1]) for n in version.folders if n.startswith("list-")] if lists is None else lists
        by_root: dict[str, list[str]] = {}
        for k in wanted:
            for p in version.folders.get(f"list-{k}", []):
                by_root.setdefault(p.rsplit("/", 1)[0], []).append(p)
        for root, paths in by_root.items():  # of each write that still holds a list
            parts.append(self.spark.read.schema(ROW).option("basePath", root).parquet(*paths).select("id", "list", "v"))
        out = self.spark.createDataFrame([], ROW) if not parts else parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def upsert(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> Version:
        """Add vectors, in the place of those of the same id. Only lists that lose or get a row are written again."""
        base = self.versions.current()
        centres, _ = self._meta(base)
        path = self.versions.new_folder("unit")
        _unit_rows(vectors, id_col, vector_col).write.parquet(path)
        new = self.spark.read.parquet(path)
        lose = self.rows(base).select("id", "list").join(new.select("id"), "id", "left_semi").select("list").distinct()
        get = _near_lists(new, centres, 1).select(F.get("lists", F.lit(0)).alias("list")).distinct()
        touched = sorted({r["list"] for r in lose.unionByName(get).collect()})  # LISTS at most
        kept = self.rows(base, touched).join(new.select("id"), "id", "left_anti").select("id", "v").unionByName(new)
        emptied = {f"list-{k}": [] for k in touched}
        return self._put(emptied, kept, centres, base, None)

    def search(self, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", probe: int | None = None) -> DataFrame:
        """query_id, id, similarity and place of k near vectors of each query, itself left out; all lists probed is exact.

        Lists longer than PART_ROWS are dealt to several tasks, each with the list's queries.
        """
        version = self.versions.current()
        centres, measured = self._meta(version)
        rows = self.rows(version)
        sizes = rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).alias("parts"))  # LISTS rows
        dealt = rows.join(F.broadcast(sizes), "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).select("list", "part", "id", "v")
        asked = _near_lists(_unit_rows(queries, id_col, vector_col), centres, probe or measured)
        asked = asked.withColumn("list", F.explode("lists")).join(F.broadcast(sizes), "list").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select("list", "part", "id", "v")

        def best(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("similarity", pa.float64())]).empty_table()
            q, r = (np.array(t.column("v").combine_chunks().flatten()).reshape(t.num_rows, -1) for t in (left, right))
            qi, ri = left.column("id").to_numpy(), right.column("id").to_numpy()
            out: list[list] = [[], [], []]
            for at in range(0, len(qi), 256):
                score = np.round(q[at : at + 256] @ r.T, 9)
                score[qi[at : at + 256, None] == ri[None, :]] = -np.inf
                for row, own in zip(score, qi[at : at + 256], strict=True):
                    first = np.lexsort((ri, -row))[:k]
                    first = first[np.isfinite(row[first])]
                    out[0] += [own] * len(first)
                    out[1] += ri[first].tolist()
                    out[2] += row[first].tolist()
            return pa.table({"query_id": pa.array(out[0], pa.int64()), "id": pa.array(out[1], pa.int64()), "similarity": pa.array(out[2], pa.float64())})

        found = asked.groupBy("list", "part").cogroup(dealt.groupBy("list", "part")).applyInArrow(best, "query_id long, id long, similarity double")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id"))
        return found.withColumn("place", place).where(F.col("place") <= k)
