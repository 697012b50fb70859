"""Statistics kept up to date: what new sessions add is found from them alone, and merged with what is stored.

State is kept by session. Most statistics belong to one event and so to one session, whose rows are their
state; a qualifying's best laps and a race's medians meet when the two are read together; corner speeds, which
run over all seasons, are kept as sums and numbers, and drivers as the sessions that they were seen in. An
update reads the laps and the telemetry of sessions that aren't stored, and of those whose circuit got
another map since for the corners alone (by folders of sessions or of seasons), and publishes its batch of states with the older ones: a version at
a time, so that an update that fails halfway adds nothing and one that is run again finds nothing to do.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.versions import Version, Versions
from . import corner_map, traces
from . import statistics as S

STATES = {
    "seen": "session_id STRING",
    "tyres": "circuit STRING, compound STRING, season INT, avg_deg_per_lap DOUBLE, cliff_lap INT, max_viable_laps INT, track_temp_sensitivity DOUBLE",
    "sectors": "driver STRING, circuit STRING, season INT, avg_sector1_delta DOUBLE, avg_sector2_delta DOUBLE, avg_sector3_delta DOUBLE",
    "speeds": "driver STRING, circuit STRING, season INT, avg_top_speed DOUBLE, rank_in_field INT",
    "fuel": "driver STRING, circuit STRING, season INT, fuel_effect_per_10kg DOUBLE",
    "best": "driver STRING, circuit STRING, season INT, quali_lap DOUBLE",
    "pace": "driver STRING, circuit STRING, season INT, avg_race_pace DOUBLE",
    "mapped": "session_id STRING, map LONG",
    "corners": "session_id STRING, map LONG, driver STRING, circuit STRING, corner_number INT, total DOUBLE, n LONG",
    "drivers": "driver STRING, session_id STRING",
}
#: Batches of states beyond which an update puts them together.
BATCHES = 24
#: States that an update finds at a time: some are small, and leave cores to others.
AT_ONCE = 4
#: Sessions whose names go to the driver, at most.
NAMED = 2000


def map_marks(corners: DataFrame) -> DataFrame:
    """circuit and map, a hash of its corners: states found with another map are not used."""
    return corners.groupBy("circuit").agg(F.xxhash64(F.array_sort(F.collect_list(F.struct("distance_from_start", "corner_number")))).alias("map"))  # some dozens


def _of(table: DataFrame, sessions: DataFrame) -> DataFrame:
    """Rows of the sessions named (id, season), without season, which the sessions have.

    Of a table with season, the season of each row's session, only their seasons are read. Up to NAMED sessions are a
    filter on their names, so that Spark opens only their folders where the table lies in folders by session; more of
    them join.
    """
    if "season" in table.columns:
        seasons = [r["season"] for r in sessions.select("season").distinct().collect()]  # one a year
        table = table.where(F.col("season").isin(seasons)).drop("season")
    ids = [r["id"] for r in sessions.select("id").limit(NAMED + 1).collect()]
    if len(ids) <= NAMED:
        return table.where(F.col("session_id").isin(ids))
    return table.join(sessions.select(F.col("id").alias("session_id")), "session_id", "left_semi")


def _traces_of(telemetry: DataFrame, sessions: DataFrame) -> DataFrame:
    """Telemetry of the sessions named; such as joins its laps goes without the session's id, which these have."""
    found = _of(telemetry, sessions)
    return found if traces.is_packed(found) and "is_valid" in found.columns else found.drop("session_id")


def states(laps: DataFrame, telemetry: DataFrame, weather: DataFrame | None, new: DataFrame) -> dict[str, DataFrame]:
    """The states of new sessions (id, season, circuit, session_type) but those of corners; laps, telemetry and
    weather, which must all carry session_id, may hold others, too. Telemetry may be traces of the laps, with their
    columns, and laps may hold track_temp instead of weather."""
    own, traced = _of(laps, new), _traces_of(telemetry, new)
    return {
        "tyres": S.tyre_stats(own, new, None if weather is None else _of(weather, new)),
        "sectors": S.driver_sector_stats(own, new),
        "speeds": S.speed_trap_stats(traced, own, new),
        "fuel": S.fuel_stats(own, new),
        "best": S.quali_best(own, new),
        "pace": S.race_pace(own, new),
        "drivers": own.select("driver", "session_id").distinct(),
        "seen": new.select(F.col("id").alias("session_id")),
    }


def corner_states(laps: DataFrame, telemetry: DataFrame, corners: DataFrame, due: DataFrame) -> dict[str, DataFrame]:
    """The states of corners for sessions with their circuit's mark (id, ..., map)."""
    own, traced = _of(laps, due), _traces_of(telemetry, due)
    sums = S.matched_sums(traced, own, due.drop("map"), corners, "session_id").join(due.select(F.col("id").alias("session_id"), "map"), "session_id")
    return {"corners": sums.select(*(c.split(" ")[0] for c in STATES["corners"].split(", "))), "mapped": due.select(F.col("id").alias("session_id"), "map")}


def update(spark: SparkSession, root: str, laps: DataFrame, telemetry: DataFrame, sessions: DataFrame, corners: DataFrame, weather: DataFrame | None = None) -> Version:
    """Bring the states under root up to the sessions given; returns the version, the old one if nothing was new."""
    versions = Versions(spark, root)
    base = versions.current()
    held = lambda name: versions.read(base, name, STATES[name])
    named = sessions.select("id", "season", "circuit", "session_type")
    new = named.join(held("seen"), F.col("id") == F.col("session_id"), "left_anti")
    marked = named.join(map_marks(corners), "circuit")
    due = marked.join(held("mapped").withColumnRenamed("map", "_map"), (F.col("id") == F.col("session_id")) & (F.col("map") == F.col("_map")), "left_anti")
    folders = dict(base.folders)
    for kind, wanted in (("new", new), ("due", due)):
        path = versions.new_folder(f"sessions-{kind}")
        wanted.write.parquet(path)
        wanted = spark.read.parquet(path)
        if wanted.isEmpty():
            continue
        found = states(laps, telemetry, weather, wanted) if kind == "new" else corner_states(laps, telemetry, corners, wanted)
        made = {name: versions.new_folder(name) for name in found}
        with ThreadPoolExecutor(AT_ONCE) as pool:
            list(pool.map(lambda name: found[name].write.parquet(made[name]), found))  # noqa: B023 (done within the loop)
        folders |= {name: [*folders.get(name, []), at] for name, at in made.items()}
    if folders == base.folders:
        return base
    for name, paths in folders.items():
        if len(paths) > BATCHES:
            at = versions.new_folder(name)
            spark.read.schema(STATES[name]).parquet(*paths).coalesce(max(1, len(paths) // 8)).write.parquet(at)
            folders[name] = [at]
    return versions.commit(base, folders)


def finals(spark: SparkSession, root: str, corners: DataFrame, version: Version | None = None) -> dict[str, DataFrame]:
    """The statistics that the states of a version amount to, by name; nothing runs until they are read."""
    versions = Versions(spark, root)
    version = version or versions.current()
    held = lambda name: versions.read(version, name, STATES[name])
    current = held("corners").join(F.broadcast(map_marks(corners)), ["circuit", "map"], "left_semi")  # a row for each circuit
    means = S.corner_means(current)
    return {
        "tyre_stats": held("tyres"),
        "driver_sector_stats": held("sectors"),
        "speed_trap_stats": held("speeds"),
        "corner_stats": corner_map.without_stale(S.corner_stats(means), corners),
        "corners_typed": S.typed_corners(means, corners),
        "fuel_stats": held("fuel"),
        "quali_race_delta": S.quali_race(held("best"), held("pace")),
        "driver_session_counts": S.driver_session_counts(held("drivers")),
    }


def by_session(df: DataFrame, path: str) -> None:
    """Lay a table out in a folder for each session, of which update() then opens the new ones alone: for sessions by the
    hundred, as each folder costs files and time. Many lie better by season, in buckets (store.LAYOUTS)."""
    df.repartition("session_id").write.partitionBy("session_id").parquet(path)


def together(tables: dict[str, DataFrame], keys: dict[str, list[str]], digits: int = 6) -> DataFrame:
    """Rows of several statistics in one table: name, key (its keys, joined) and facts (its other columns, rounded, joined).

    Rounding is that of a double times a power of ten, as SQL engines do it: Spark's own rounds a double's shortest
    decimal text, which may be half of a digit where the double lies below it.
    """

    def told(df: DataFrame, c: str):
        value = (F.round(F.col(c) * 10.0**digits) / 10.0**digits).cast(f"decimal(18,{digits})") if dict(df.dtypes)[c] == "double" else F.col(c)
        return F.coalesce(value.cast("string"), F.lit("-"))

    parts = []
    for name, df in tables.items():
        facts = sorted(c for c in df.columns if c not in keys[name])
        parts.append(df.select(F.lit(name).alias("name"), F.concat_ws("|", *keys[name]).alias("key"), F.concat_ws(" ", *(told(df, c) for c in facts)).alias("facts")))
    return reduce(DataFrame.unionByName, parts)
