"""Explicit schemas of the engine's tables and documents, and the DDL that follows from them."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T

#: name -> DDL of its columns; ids are stable hashes or keys, not counters.
DDL = {
    "sessions": "id STRING, season INT, circuit STRING, session_type STRING, date STRING",
    "laps": "id STRING, session_id STRING, driver STRING, lap_number INT, lap_time DOUBLE, sector1 DOUBLE, sector2 DOUBLE, sector3 DOUBLE, compound STRING, tyre_age INT, is_valid INT",
    "telemetry": "lap_id STRING, distance DOUBLE, speed DOUBLE, throttle DOUBLE, brake DOUBLE, gear INT",
    "corners": "circuit STRING, corner_number INT, corner_type STRING, distance_from_start DOUBLE",
    "tyre_stats": "circuit STRING, compound STRING, season INT, avg_deg_per_lap DOUBLE, cliff_lap INT, max_viable_laps INT, track_temp_sensitivity DOUBLE",
    "driver_sector_stats": "driver STRING, circuit STRING, season INT, avg_sector1_delta DOUBLE, avg_sector2_delta DOUBLE, avg_sector3_delta DOUBLE",
    "speed_trap_stats": "driver STRING, circuit STRING, season INT, avg_top_speed DOUBLE, rank_in_field INT",
    "corner_stats": "driver STRING, circuit STRING, corner_number INT, avg_min_speed DOUBLE, delta_vs_field DOUBLE",
    "fuel_stats": "driver STRING, circuit STRING, season INT, fuel_effect_per_10kg DOUBLE",
    "quali_race_delta": "driver STRING, circuit STRING, season INT, quali_lap DOUBLE, avg_race_pace DOUBLE, delta DOUBLE",
    "weather": "session_id STRING, lap_number INT, track_temp DOUBLE",
}
#: Columns by which a table is laid out on disk, so that session filters prune files.
LAYOUT = {"sessions": ["season"], "laps": ["session_id"], "telemetry": []}

_S, _D = T.StringType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


CHAT = _struct(messages=T.ArrayType(_struct(role=_S, content=_S)))
EVAL = _struct(question=_S, reference=_S, generated=_S, rouge_l=_D, bleu=_D, factual=T.BooleanType(), halluc=_D, ref_nums=T.ArrayType(_D), pred_nums=T.ArrayType(_D))
CHECKPOINT = _struct(m2_done=T.MapType(_S, T.IntegerType()), m3_done=T.IntegerType(), total_discarded=T.IntegerType())


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[table])


def create_tables(spark: SparkSession, database: str = "default") -> list[str]:
    """Create the tables that aren't there yet, as partitioned Parquet; returns the names of all."""
    for name, columns in DDL.items():
        layout = f" PARTITIONED BY ({', '.join(LAYOUT[name])})" if LAYOUT.get(name) else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet{layout}")
    return sorted(t.name for t in spark.catalog.listTables(database))


def weather_mode(columns: list[str]) -> str | None:
    """How a weather table joins to laps: by lap_id, by session and lap number, or not at all."""
    have = set(columns)
    if {"lap_id", "track_temp"} <= have:
        return "lap_id"
    if {"session_id", "lap_number", "track_temp"} <= have:
        return "session_lap"
    return None
