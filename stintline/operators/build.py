"""The statistics job: every statistic from the tables of laps and telemetry, published together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.versions import Version, Versions
from . import corner_map
from . import statistics as S

#: name -> the statistic, from a function that gives the tables by name; in the order of the job.
STATISTICS: dict[str, Callable[[Callable[[str], DataFrame]], DataFrame]] = {
    "tyre_stats": lambda t: S.tyre_stats(t("laps"), t("sessions"), t("weather")),
    "driver_sector_stats": lambda t: S.driver_sector_stats(t("laps"), t("sessions")),
    "speed_trap_stats": lambda t: S.speed_trap_stats(t("telemetry"), t("laps"), t("sessions")),
    "corner_stats": lambda t: corner_map.without_stale(S.corner_stats(t("corner_means")), t("corners")),
    "corners_typed": lambda t: S.typed_corners(t("corner_means"), t("corners")),
    "fuel_stats": lambda t: S.fuel_stats(t("laps"), t("sessions")),
    "quali_race_delta": lambda t: S.quali_race_delta(t("laps"), t("sessions")),
    "driver_session_counts": lambda t: S.driver_session_counts(t("laps")),
}


def corner_means(t: Callable[[str], DataFrame]) -> DataFrame:
    """What corner_stats and corners_typed draw on: found once, as it reads all telemetry."""
    return S.corner_means(S.matched_sums(t("telemetry"), t("laps"), t("sessions"), t("corners")))


def build_statistics(spark: SparkSession, tables: Callable[[str], DataFrame], target: str) -> Version:
    """Compute the statistics and publish them under target; readers see all of them together, or the old ones."""
    versions = Versions(spark, target)
    path = versions.new_folder("corner_means")
    corner_means(tables).write.parquet(path)
    means = spark.read.parquet(path)
    made = {name: make(lambda t: means if t == "corner_means" else tables(t)) for name, make in STATISTICS.items()}
    return versions.publish({**made, "corner_means": path})
