"""Connected components of an edge table, by repeated contraction.

Each partition first replaces its edges by a spanning forest. Then, round after round, every node points to
its smallest neighbour, pointers are shortened, and edges between different pointers remain; at least
half of the nodes that still have edges vanish each round. When no more than LOCAL edges remain, one task
finishes them. No node's neighbours are ever gathered: all grouping is by sums of minima.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

#: Edges that one task may finish: 16 bytes each, some 30 MB as Python objects.
LOCAL = 1 << 17


class Union(dict):
    """Disjoint sets of ids; a set's root is its smallest id."""

    def root(self, x: int) -> int:
        top = x
        while (up := self.get(top, top)) != top:
            top = up
        while x != top:
            self[x], x = top, self.get(x, x)
        return top

    def join(self, a: int, b: int) -> bool:
        """Whether a and b were in different sets; now they share one."""
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self[max(a, b)] = min(a, b)
        return True


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of the edges seen but the roots, with its root."""
    sets = Union()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sets.join(a, b)
    nodes = [x for x in sets if sets.root(x) != x]
    for at in range(0, len(nodes), 1 << 16):
        part = nodes[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([sets.root(x) for x in part], pa.int64())], names=["a", "b"])


def components(edges: DataFrame, local: int = LOCAL) -> DataFrame:
    """node and label, its component's smallest node, for every node of edges (a, b: long) that isn't
    its own label. Null ends, loops and repeated edges do no harm; no edges give no rows."""
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    left = durable(edges.mapInArrow(_forest, "a long, b long"), "component-edges")
    steps: list[DataFrame] = []
    while (n := left.count()) > local:
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = durable(both.groupBy("a").agg(F.least("a", F.min("b")).alias("up")), "component-pointers")
        shorter = up.alias("x").join(up.alias("y"), F.col("x.up") == F.col("y.a")).select("x.a", F.col("y.up").alias("up"))
        up = durable(shorter, "component-pointers")
        steps.append(up)
        moved = left.join(up.select("a", F.col("up").alias("_a")), "a").select("_a", "b")
        moved = moved.join(up.select(F.col("a").alias("b"), F.col("up").alias("_b")), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
        left = durable(moved.where("a <> b").distinct().mapInArrow(_forest, "a long, b long"), "component-edges")
    out = left.coalesce(1).mapInArrow(_forest, "a long, b long") if n else left
    out = out.select(F.col("a").alias("node"), F.col("b").alias("label"))
    for up in reversed(steps):
        out = durable(out, "component-labels")
        further = up.join(out, F.col("up") == F.col("node"), "left")
        out = further.select(F.col("a").alias("node"), F.coalesce("label", "up").alias("label")).where("node <> label")
    return out
