"""Generated examples up to a quota for each category, in rounds that can stop and go on.

The sink is its own progress: each round reads what was tried before, tries as many further candidates of each
category as it still lacks, in a seeded order, and publishes all that it tried together. A round that fails
publishes nothing, and the next one tries the same again; so a run that was stopped ends with the same rows as
one that was not. Nothing is asked of the generator twice but for a round that failed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.versions import Version, Versions

TRIED = "category STRING, id LONG, place LONG, response STRING, reason STRING"
#: Why a response is discarded: it isn't one, or it states numbers that the facts don't ground.
BAD_FORMAT, UNGROUNDED = "bad_format", "ungrounded"


def ordered(candidates: DataFrame, seed: str) -> DataFrame:
    """candidates (category, id, facts) with place, their number in the category's seeded order."""
    draw = F.md5(F.concat_ws("|", F.lit(seed), F.col("id")))
    return candidates.withColumn("place", F.row_number().over(Window.partitionBy("category").orderBy(draw, "id")).cast("long"))


def due(candidates: DataFrame, tried: DataFrame, quotas: DataFrame) -> DataFrame:
    """The candidates of the next round, none once every category has its quota or has been tried whole.

    All that was tried is the beginning of the order, so a category goes on behind its last place.
    """
    held = tried.groupBy("category").agg(F.count_if(F.col("reason").isNull()).alias("_kept"), F.max("place").alias("_last"))
    state = quotas.join(held, "category", "left").select("category", F.coalesce("_last", F.lit(0)).alias("_last"), (F.col("quota") - F.coalesce("_kept", F.lit(0))).alias("_lack"))
    at = F.col("place") - F.col("_last")
    return candidates.join(F.broadcast(state), "category").where((at > 0) & (at <= F.col("_lack"))).drop("_last", "_lack")  # a row for each category


def judged(told: DataFrame) -> DataFrame:
    """Responses with the reason for which they are discarded, or null."""
    blank = F.col("response").isNull() | (F.trim("response") == "")
    return told.withColumn("reason", F.when(blank, BAD_FORMAT).when(X.fails_guard(F.col("facts"), F.col("response")), UNGROUNDED))


def run(spark: SparkSession, root: str, candidates: DataFrame, quotas: DataFrame, generator: Callable[[DataFrame], DataFrame], seed: str = "84", rounds: int | None = None) -> Version:
    """Go on until all quotas are met or nothing is left to try (or for so many rounds); returns the version reached.

    generator takes candidates with place and adds response; it runs on executors. quotas are category and quota.
    """
    versions = Versions(spark, root)
    version = versions.current()
    if "candidates" not in version.folders:
        path = versions.new_folder("candidates")
        ordered(candidates, seed).write.parquet(path)
        version = versions.commit(version, {"candidates": [path]})
    every = versions.read(version, "candidates")
    while rounds is None or rounds > 0:
        rounds = None if rounds is None else rounds - 1
        path = versions.new_folder("tried")
        judged(generator(due(every, versions.read(version, "tried", TRIED), quotas))).select("category", "id", "place", "response", "reason").write.parquet(path)
        if spark.read.parquet(path).isEmpty():
            break
        version = versions.commit(version, {**version.folders, "tried": [*version.folders.get("tried", []), path]})
    return version


def tried(spark: SparkSession, root: str, version: Version | None = None) -> DataFrame:
    """All that was tried: kept where there is no reason."""
    versions = Versions(spark, root)
    return versions.read(version or versions.current(), "tried", TRIED)


def progress(tried: DataFrame) -> DataFrame:
    """What a checkpoint tells: of each category the examples kept, and the discarded ones of either reason."""
    return tried.groupBy("category").agg(F.count_if(F.col("reason").isNull()).alias("kept"), *(F.count_if(F.col("reason") == r).alias(r) for r in (BAD_FORMAT, UNGROUNDED)))
