"""Registered queries of streams: tables arrive in parts, each run goes on from the checkpoint of the one before."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import generation
from ..sources.store import shared_root
from ..streaming import ingest, stateful
from . import jobs, texts
from .texts import messages

PARTS = 3


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def arriving(rows: DataFrame, order: str, stream, name: str) -> DataFrame:
    """What stream (a function of the streamed rows) has written once rows have arrived in PARTS by the order given,
    with a run, and so a restart from the checkpoint, after each part."""
    spark, root = rows.sparkSession, _folder(rows.sparkSession, name)
    stateful.durable_state(spark)
    cuts = [r for r in rows.agg(F.percentile_approx(order, [k / PARTS for k in range(1, PARTS)], 10_000)).first()[0]]
    bounds = [None, *cuts, None]
    for low, high in zip(bounds, bounds[1:], strict=False):
        inside = (F.lit(True) if low is None else F.col(order) > low) & (F.lit(True) if high is None else F.col(order) <= high)
        rows.where(inside).write.mode("append").parquet(f"{root}/in")
        source = spark.readStream.schema(rows.schema).parquet(f"{root}/in")
        stateful.run_to_end(stream(source), f"{root}/out", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out")


def history_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last fifty events of each user since the one that clears them, kept by a stream over three parts of the events."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.select(F.col("user_id").cast("string").alias("sid"), place.cast("long").alias("turn"), F.col("event_type").alias("role"), F.col("event_id").cast("string").alias("content"), (F.col("event_id") % 97 == 0).alias("clear"), at.alias("at"))
    held = stateful.newest(arriving(rows, "at", stateful.history_stream, "history"))
    return held.select(F.col("content").cast("long").alias("event_id"), F.col("sid").cast("long").alias("user_id"), F.col("role").alias("event_type"))


def carry_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each question means after those before it, kept by a stream over three parts of the messages."""
    t = F.col("text")
    lap = F.coalesce(X.lap_number(t).cast("string"), F.when(X.lap_fastest(t), F.lit("fastest")))
    parts = {"circuit": X.circuit(t), "year": X.year(t), "session": X.session(t), "lap": lap, "drivers": X.drivers(t), "telemetry": (X.mode(t) == "telemetry") | X.pushback(t), "clear": F.col("id") % 41 == 0}
    turns = messages(spark, sf_dir).select("sid", F.col("id").alias("turn"), *(c.alias(n) for n, c in parts.items()))
    return arriving(turns, "turn", stateful.named_stream, "named").drop("batch")


def ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by customer after four deliveries into a keyed table, the second of which holds the first one's once more,
    and the third of which fails once before it is run again."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"), F.col("o_totalprice").alias("price"))
    root = _folder(spark, "ingest")
    deliver = lambda rows, n: rows.write.mode("overwrite").parquet(f"{root}/in/{n}")
    load = lambda fail=None: ingest.run(spark, f"{root}/in/*", orders.schema, f"{root}/table", f"{root}/checkpoint", ["id"], fail)
    most = orders.agg(F.max("id")).first()[0]
    deliver(orders.where(F.col("id") <= most / 3), 1)
    load()
    deliver(orders.where(F.col("id") <= most / 2).unionByName(orders.where("id % 5 = 0")), 2)
    load()
    deliver(orders, 3)
    try:
        load(ingest.BEFORE_COMMIT)
    except ingest.Broken:
        pass  # the delivery is tried again
    load()
    table = ingest.table(spark, f"{root}/table", orders.schema)
    return table.groupBy("customer").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 4).alias("total"))


#: Examples wanted of each category but the last, which gets none.
QUOTA, CATEGORIES = 160, 5


def generated_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run tries for five categories, one of them without candidates enough, if it is stopped after a round, fails in
    the next and goes on then: id, category, place and the reason of what is discarded.

    The generator is a stand-in: it says what the answers' table holds, and nothing for some.
    """
    told = texts.answers(spark, sf_dir).select(F.concat(F.lit("c"), F.col("id") % CATEGORIES).alias("category"), "id", F.col("reference").alias("facts"), "generated")
    told = told.where("id % 5 <> 3 OR id < 300")
    quotas = spark.createDataFrame([(f"c{k}", QUOTA) for k in range(CATEGORIES - 1)], "category string, quota long")
    root = _folder(spark, "generation")
    say = lambda df: df.withColumn("response", F.when(F.col("id") % 13 > 0, F.col("generated")))
    generation.run(spark, root, told, quotas, say, rounds=1)
    try:
        generation.run(spark, root, told, quotas, lambda df: say(df).withColumn("response", F.when(F.col("place") > 0, F.raise_error(F.lit("stopped")))))
    except Exception as e:
        if "stopped" not in str(e):
            raise
    generation.run(spark, root, told, quotas, say)
    return generation.tried(spark, root).select("category", "id", "place", "reason")


QUERIES = {f.__name__: f for f in (history_streamed, carry_streamed, ingested, generated_corpus)}
ORACLE_SQL = {
    "history_streamed": jobs.ORACLE_SQL["history_cleared"],
    "carry_streamed": texts.ORACLE_SQL["carry_forward"],
    "generated_corpus": f"""{texts._AN}, c AS (SELECT 'c' || id % 5 AS category, id, CASE WHEN id % 13 = 0 THEN 'bad_format' WHEN {texts._LONE} > 0 THEN 'ungrounded' END AS reason, md5(concat_ws('|', '84', id)) AS draw FROM n WHERE id % 5 < 4 AND (id % 5 <> 3 OR id < 300)),
p AS (SELECT *, row_number() OVER w AS place, count(*) FILTER (reason IS NULL) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS kept FROM c WINDOW w AS (PARTITION BY category ORDER BY draw, id))
SELECT category, id, place, reason FROM p WHERE kept < {QUOTA}""",
    "ingested": "SELECT o_custkey AS customer, count(*) AS n, round(sum(o_totalprice), 4) AS total FROM orders GROUP BY ALL",
}
