"""Upkeep of the corner map: which session it comes from, and which rows are stale."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mapped_circuits(corners: DataFrame) -> DataFrame:
    """Circuits with at least one corner of known distance: these need no new map."""
    return corners.groupBy("circuit").agg(F.count("distance_from_start").alias("n")).where("n > 0").select("circuit")


def without_empty(corners: DataFrame) -> DataFrame:
    """Corners of mapped circuits alone."""
    return corners.join(mapped_circuits(corners), "circuit", "left_semi")


def map_sources(sessions: DataFrame, corners: DataFrame) -> DataFrame:
    """For each circuit without a map, the session to take it from: the newest season, Q before Race."""
    w = Window.partitionBy("circuit").orderBy(F.col("season").desc(), F.when(F.col("session_type") == "Q", 0).otherwise(1), "id")
    lacking = sessions.join(mapped_circuits(corners), "circuit", "left_anti")
    return lacking.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("circuit", "id", "season", "session_type")


def replace_map(corners: DataFrame, fresh: DataFrame) -> DataFrame:
    """corners with all rows of fresh's circuits replaced by fresh."""
    return corners.join(fresh.select("circuit").distinct(), "circuit", "left_anti").unionByName(fresh.select(*corners.columns))


def without_stale(stats: DataFrame, corners: DataFrame) -> DataFrame:
    """Corner statistics but those of circuits where they number corners that the map doesn't have."""
    most = corners.groupBy("circuit").agg(F.max("corner_number").alias("_mapped"))
    held = stats.groupBy("circuit").agg(F.max("corner_number").alias("_held")).join(most, "circuit", "left")
    stale = held.where(F.col("_held") > F.coalesce("_mapped", F.lit(0))).select("circuit")
    return stats.join(stale, "circuit", "left_anti")
