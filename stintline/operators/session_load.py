"""Loading sessions: what has landed and isn't stored yet becomes sessions, laps and telemetry."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import append_new, surrogate_key
from . import corner_map
from .cleaning import clean_laps, resample, to_laps

KEY = ["season", "circuit", "session_type"]
TYPES, TRACED = ("Q", "Race"), ("Race",)
#: Parts of qualifying are stored as one session.
SAME_AS = {"Q1": "Q", "Q2": "Q", "Q3": "Q", "R": "Race"}
TRACE = {"Speed": "speed", "Throttle": "throttle", "Brake": "brake", "nGear": "gear"}


def events(schedule: DataFrame, types: Iterable[str] = TYPES) -> DataFrame:
    """The sessions of a schedule (season, EventName, RoundNumber); tests before the season are no rounds."""
    rounds = schedule.where("RoundNumber > 0").select("season", F.col("EventName").alias("circuit"))
    return rounds.withColumn("session_type", F.explode(F.array(*map(F.lit, types))))


@dataclass
class Load:
    """Rows to append. A session without laps is recorded all the same, so that it isn't tried again."""

    sessions: DataFrame
    laps: DataFrame
    telemetry: DataFrame


def load(landed: DataFrame, raw_laps: DataFrame, traces: DataFrame, stored: DataFrame) -> Load:
    """What the landed sessions (KEY, date) add to those stored.

    raw_laps and traces carry KEY, Driver and LapNumber. Laps that aren't fit for analysis are left
    out, and so are traces of such laps, of sessions that keep none, and without two samples.
    """
    fresh = append_new(landed, stored, KEY).dropDuplicates(KEY).withColumn("id", surrogate_key(*KEY))
    named = fresh.select(*KEY, F.col("id").alias("session_id"))
    laps = to_laps(clean_laps(raw_laps.join(named, KEY)), F.col("session_id"))
    ids = laps.select("session_id", F.col("driver").alias("Driver"), F.col("lap_number").alias("LapNumber"), F.col("id").alias("lap_id"))
    traced = traces.join(named.where(F.col("session_type").isin(*TRACED)), KEY).join(ids, ["session_id", "Driver", "LapNumber"])
    return Load(fresh, laps, resample(traced, TRACE))


def append(new: Load, target: str) -> None:
    """Append under target. A session's laps and telemetry are a folder each, which a second attempt
    replaces; its own row comes last, so that a session counts as stored only once all of it is."""
    dynamic = {"partitionOverwriteMode": "dynamic"}
    session = F.split_part("lap_id", F.lit("|"), F.lit(1))
    new.telemetry.withColumn("session_id", session).write.mode("overwrite").options(**dynamic).partitionBy("session_id").parquet(f"{target}/telemetry")
    new.laps.write.mode("overwrite").options(**dynamic).partitionBy("session_id").parquet(f"{target}/laps")
    new.sessions.write.mode("append").parquet(f"{target}/sessions")


def clear(spark: SparkSession, *folders: str) -> None:
    """Delete all that is stored, and leave empty folders."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.delete(path, True)
        fs.mkdirs(path)


def ensure_session(circuit: str, season: int | None, session_type: str, ingest: Callable[[int, str, str], bool], seasons: Iterable[int]) -> tuple[int, str] | None:
    """The season and type of a session that is there or that ingest() could bring in, or None.

    Without a season, the newest comes first. Practice isn't landed, so it is never tried.
    """
    kind = SAME_AS.get(session_type, session_type)
    if kind not in TYPES:
        return None
    for year in sorted(seasons, reverse=True) if season is None else [season]:
        if ingest(year, circuit, kind):
            return year, kind
    return None


def populate_corners(sessions: DataFrame, corners: DataFrame, maps: DataFrame) -> DataFrame:
    """corners after circuits without a usable map took that of their source session.

    maps holds session_id, Number and Distance. Rows of circuits without any distance go; circuits whose
    source session has no map keep none.
    """
    usable = corner_map.without_empty(corners)
    wanted = corner_map.map_sources(sessions, corners).select("circuit", F.col("id").alias("session_id"))
    fresh = maps.join(wanted, "session_id").where("Distance IS NOT NULL")
    fresh = fresh.select("circuit", F.col("Number").cast("int").alias("corner_number"), F.col("Distance").cast("double").alias("distance_from_start"))
    return corner_map.replace_map(usable.select(*fresh.columns), fresh)
