"""Shards: contiguous, whole and of near equal bytes."""

import random
import zlib

import pytest

from stintline.llm import queries, sharding


def told(rows):
    """Rows as a multiset; null and empty texts of an id have one place, so either may come first."""
    return sorted(((d, t or "", *x) for d, t, *x in rows), key=repr)


def plain(rows, shards):
    """Rows with shard and slot, by one pass over them in order."""
    size = lambda t: len((t or "").encode()) + 1
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, size(r[1]), zlib.crc32((r[1] or "").encode())))
    total, before, slots, out = sum(size(r[1]) for r in rows), 0, {}, []
    for r in order:
        s = min(shards - 1, (2 * before + size(r[1])) * shards // (2 * total))
        before += size(r[1])
        slots[s] = slots.get(s, -1) + 1
        out.append((*r, s, slots[s]))
    return out


def some_rows(n, rng):
    return [(rng.randrange(3 * n), rng.choice([None, "", "é" * rng.randint(1, 30), "x" * rng.choice((1, 50, 900))])) for _ in range(n)]


@pytest.mark.parametrize(("n", "shards", "parts"), [(500, 16, 5), (40, 16, 3), (7, 16, 2), (300, 1, 4), (200, 50, 1)])
def test_agrees_with_one_pass(spark, n, shards, parts):
    rows = some_rows(n, random.Random(n))
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), shards).collect()
    assert told(got) == told(plain(rows, shards))


def test_balance(spark):
    rng = random.Random(1)
    rows = some_rows(3000, rng)
    held = [0] * 16
    for r in sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        held[r["shard"]] += len((r["text"] or "").encode()) + 1
    assert max(held) - min(held) <= 2 * 901


def test_defined_cases(spark):
    """Null ids and texts, repeated rows that are most of all, one long text, clashing names, an empty table."""
    rows = [(None, "the same row")] * 300 + [(None, None), (1, None), (1, None), (1, "a"), (2, "b" * 5000), (3, "c"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 AS shard", "8 AS size", "9 AS place", "doc_id AS id", "'r' AS row", "1 AS cuts", "2 AS before").repartition(5)
    got = sharding.assign_shards(docs, 8)
    assert got.columns == ["doc_id", "text", "size", "place", "id", "row", "cuts", "before", "shard", "slot"]
    assert told((r["doc_id"], r["text"], r["shard"], r["slot"]) for r in got.collect()) == told(plain(rows, 8))
    assert {(r["size"], r["place"], r["row"]) for r in got.collect()} == {(8, 9, "r")}
    assert sharding.assign_shards(docs.limit(0)).collect() == []


def test_written_shards(spark, tmp_path):
    rows = some_rows(200, random.Random(4))
    path = f"file://{tmp_path}/shards"
    assigned = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"))
    sharding.write_shards(assigned, path)
    back = spark.read.parquet(path).select("doc_id", "text", "shard", "slot").collect()
    assert told(back) == told(plain(rows, 16))


def test_plan_is_native(spark, tmp_path):
    spark.createDataFrame(some_rows(50, random.Random(6)), "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    found = queries.op13_sharding(spark, f"file://{tmp_path}")
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert found.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
