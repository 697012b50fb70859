"""Registered queries of the lap table: cleaning, resampling, the interactive lap query, catalogue work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import cleaning, corner_map, lap_query
from ..operators.statistics import GROUP, inlier, rejects, with_session
from ..sources.files import append_new
from ..sources import fixtures
from ..sources.fixtures import run_sql
from .stats import rounded, tables
from .stats_sql import with_stats

#: Raw timing rows, as a timing feed lands them: the laps, with pit stops, flags and deletions.
RAW_LAPS = """
SELECT session_id, driver AS Driver, lap_number AS LapNumber, CASE WHEN lap_number % 17 = 5 THEN NULL ELSE lap_time END AS LapTime,
  sector1 AS Sector1Time, CASE WHEN lap_number % 23 = 7 THEN NULL ELSE sector2 END AS Sector2Time, sector3 AS Sector3Time,
  CASE WHEN tyre_age = 1 AND lap_number > 1 THEN lap_time END AS PitOutTime, CASE WHEN tyre_age = 18 THEN lap_time END AS PitInTime,
  CASE WHEN lap_number % 13 = 3 THEN '24' WHEN lap_number % 29 = 4 THEN '6' WHEN lap_number % 31 = 9 THEN NULL ELSE '1' END AS TrackStatus,
  CASE WHEN lap_number % 37 = 11 THEN true WHEN lap_number % 7 = 2 THEN NULL ELSE false END AS Deleted,
  CASE WHEN lap_number % 41 = 6 THEN '' ELSE compound END AS Compound, CAST(tyre_age AS DOUBLE) AS TyreLife
FROM laps"""
KEPT = "LapTime IS NOT NULL AND Sector1Time IS NOT NULL AND Sector2Time IS NOT NULL AND Sector3Time IS NOT NULL AND PitOutTime IS NULL AND PitInTime IS NULL AND NOT coalesce(TrackStatus LIKE '%4%' OR TrackStatus LIKE '%6%', false) AND NOT coalesce(Deleted, false)"

#: An uneven trace: samples at growing gaps, with gaps in speed and gear.
TRACE = """
SELECT lap_id, CAST(distance / 50 AS INT) AS i, distance * 0.93e0 + 7e0 * (CAST(distance / 50 AS INT) % 3) AS "Distance",
  CASE WHEN CAST(distance / 50 AS INT) % 6 = 1 THEN NULL ELSE speed END AS "Speed", CASE WHEN CAST(distance / 50 AS INT) % 9 < 2 THEN NULL ELSE floor(speed / 45) END AS "nGear"
FROM telemetry"""


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, RAW_LAPS, tables(spark, sf_dir, "laps"))


def clean_laps(spark: SparkSession, sf_dir: str) -> DataFrame:
    laps = cleaning.to_laps(cleaning.clean_laps(_raw(spark, sf_dir)), F.col("session_id"))
    return laps.select("id", "session_id", "driver", "lap_number", "lap_time", "compound", "tyre_age")


def resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    uneven = run_sql(spark, TRACE.replace('"', "`"), {"telemetry": fixtures.shapes(spark)})
    trace = fixtures.traces(tables(spark, sf_dir, "laps")["laps"], uneven, "i")
    return cleaning.resample(trace, {"Speed": "speed", "Throttle": "throttle", "nGear": "gear"})


def _laps(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir, "laps", "sessions")
    return with_session(t["laps"], t["sessions"])


def fastest_lap_per_driver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lap_query.fastest_per_driver(_laps(spark, sf_dir))


def lap_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lap_query.numbered_lap(_laps(spark, sf_dir), 12)


def avg_pace_per_driver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lap_query.average_pace(_laps(spark, sf_dir)))


def sector_delta_vs_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lap_query.sector_deltas(fastest_lap_per_driver(spark, sf_dir))


def sector_delta_vs_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lap_query.sector_deltas(lap_query.average_pace(_laps(spark, sf_dir)), average=True))


def head_to_head_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lap_query.pair_check(fastest_lap_per_driver(spark, sf_dir))


def latest_session_per_circuit(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = tables(spark, sf_dir, "sessions")["sessions"]
    return sessions.groupBy("circuit", "session_type").agg(F.max_by("id", "season").alias("id"), F.max("season").alias("season"))


def outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    raced = _laps(spark, sf_dir).where("session_type = 'Race'")
    return raced.withColumn("_in", inlier("lap_time", GROUP)).where("NOT _in").select("id", "lap_time")


def next_slower(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each lap's gap to the next strictly slower time of its session and lap number."""
    laps = tables(spark, sf_dir, "laps")["laps"]
    times = laps.select("session_id", "lap_number", "lap_time").distinct()
    lead = F.expr("lead(lap_time) OVER (PARTITION BY session_id, lap_number ORDER BY lap_time)")
    return laps.join(times.withColumn("next", lead), ["session_id", "lap_number", "lap_time"]).select("id", (F.col("next") - F.col("lap_time")).alias("gap"))


def incremental_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laps of the newest season that a table of the older seasons lacks."""
    laps = tables(spark, sf_dir, "laps")["laps"]
    old = laps.where("NOT session_id LIKE '2025%'")
    return append_new(laps, old, ["session_id", "driver", "lap_number"]).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))


def corner_type_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners and mapped corners of each circuit: circuits without any mapped one need a new map."""
    corners = tables(spark, sf_dir, "corners")["corners"]
    return corners.groupBy("circuit").agg(F.count(F.lit(1)).alias("corners"), F.count("distance_from_start").alias("mapped"), F.max("corner_number").alias("highest"))


def lap_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rejects(tables(spark, sf_dir, "laps")["laps"], {"lap_time": (78.0, 83.0), "sector1": (23.0, 25.2)})
    return found.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def map_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the maps of circuits outside of Asia, taken as unmapped, come from."""
    t = tables(spark, sf_dir, "corners", "sessions")
    return corner_map.map_sources(t["sessions"], t["corners"].where("circuit LIKE 'ASIA%'"))


def stale_corner_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corner statistics that stay if Europe's map ended at corner nine."""
    t = tables(spark, sf_dir, "corner_stats", "corners")
    short = t["corners"].where("NOT circuit LIKE 'EUROPE%' OR corner_number < 10")
    return corner_map.without_stale(t["corner_stats"], short).select("driver", "circuit", "corner_number")


def plausible_laps(spark: SparkSession, sf_dir: str) -> DataFrame:
    laps = tables(spark, sf_dir, "laps")["laps"]
    ok = X.plausible_times(F.col("lap_time"), F.col("sector1"), F.col("sector2"), F.col("sector3"))
    return laps.groupBy("driver").agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("odd"), F.min(X.lap_time_text(F.round("lap_time", 1))).alias("best"))


QUERIES = {f.__name__: f for f in (map_sources, stale_corner_stats, plausible_laps, fastest_lap_per_driver, lap_n, avg_pace_per_driver, sector_delta_vs_reference, sector_delta_vs_field, head_to_head_check, latest_session_per_circuit, clean_laps, resample, outliers, next_slower, incremental_load, corner_type_usable, lap_rejects)}

_FULL = "is_valid = 1 AND lap_time IS NOT NULL AND sector1 IS NOT NULL AND sector2 IS NOT NULL AND sector3 IS NOT NULL AND (session_type <> 'Race' OR lap_number > 1)"
_FAST = f"SELECT session_id, driver, lap_number, lap_time, sector1, sector2, sector3 FROM raced WHERE {_FULL} AND lap_time > 0 QUALIFY row_number() OVER (PARTITION BY session_id, driver ORDER BY lap_time, lap_number) = 1"
_MEAN = f"SELECT session_id, driver, round(avg(lap_time), 9) AS lap_time, round(avg(sector1), 9) AS sector1, round(avg(sector2), 9) AS sector2, round(avg(sector3), 9) AS sector3 FROM raced WHERE {_FULL} AND lap_time > 0 GROUP BY ALL"
_FILL = "coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY lap_id ORDER BY i ROWS UNBOUNDED PRECEDING), first_value({c} IGNORE NULLS) OVER (PARTITION BY lap_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"

ORACLE_SQL = {
    "map_sources": with_stats("SELECT circuit, id, season, session_type FROM sessions WHERE circuit NOT LIKE 'ASIA%' QUALIFY row_number() OVER (PARTITION BY circuit ORDER BY season DESC, session_type, id) = 1"),
    "stale_corner_stats": with_stats("SELECT driver, circuit, corner_number FROM corner_stats WHERE circuit NOT LIKE 'EUROPE%' OR circuit NOT IN (SELECT circuit FROM corner_stats WHERE corner_number > 9)"),
    "plausible_laps": with_stats("SELECT driver, count(*) FILTER (lap_time BETWEEN 60 AND 145 AND sector1 BETWEEN 10 AND 60 AND sector2 BETWEEN 10 AND 60 AND sector3 BETWEEN 10 AND 60) AS ok, count(*) FILTER (NOT (lap_time BETWEEN 60 AND 145 AND sector1 BETWEEN 10 AND 60 AND sector2 BETWEEN 10 AND 60 AND sector3 BETWEEN 10 AND 60)) AS odd, min('1:' || lpad(CAST(CAST(round(lap_time, 1) - 60 AS DECIMAL(9, 3)) AS VARCHAR), 6, '0')) AS best FROM laps GROUP BY driver"),
    "fastest_lap_per_driver": with_stats(_FAST),
    "lap_n": with_stats(f"SELECT session_id, driver, lap_number, lap_time, sector1, sector2, sector3 FROM raced WHERE {_FULL} AND lap_number = 12"),
    "avg_pace_per_driver": with_stats(_MEAN),
    "sector_delta_vs_reference": with_stats(f", f AS ({_FAST}) SELECT *, sector1 - first_value(sector1) OVER w AS delta1, sector2 - first_value(sector2) OVER w AS delta2, sector3 - first_value(sector3) OVER w AS delta3 FROM f WINDOW w AS (PARTITION BY session_id ORDER BY lap_time, driver)"),
    "sector_delta_vs_field": with_stats(f", f AS (SELECT session_id, driver, avg(lap_time) AS lap_time, avg(sector1) AS s1, avg(sector2) AS s2, avg(sector3) AS s3 FROM raced WHERE {_FULL} AND lap_time > 0 GROUP BY ALL) SELECT session_id, driver, round(lap_time, 9) AS lap_time, round(s1, 9) AS sector1, round(s2, 9) AS sector2, round(s3, 9) AS sector3, round(s1 - avg(s1) OVER w, 9) AS delta1, round(s2 - avg(s2) OVER w, 9) AS delta2, round(s3 - avg(s3) OVER w, 9) AS delta3 FROM f WINDOW w AS (PARTITION BY session_id)"),
    "head_to_head_check": with_stats(f", f AS ({_FAST}) SELECT a.session_id, a.driver AS d1, b.driver AS d2, b.lap_time - a.lap_time AS gap, CASE WHEN round(a.lap_time, 3) = round(b.lap_time, 3) THEN 'identical lap times' WHEN a.session_id LIKE '%|Q' AND abs(b.lap_time - a.lap_time) < 0.05 THEN 'suspiciously close' END AS reason FROM f AS a JOIN f AS b ON a.session_id = b.session_id AND a.driver < b.driver"),
    "latest_session_per_circuit": with_stats("SELECT circuit, session_type, arg_max(id, season) AS id, max(season) AS season FROM sessions GROUP BY ALL"),
    "clean_laps": with_stats(f", r AS ({RAW_LAPS}) SELECT concat_ws('|', session_id, Driver, LapNumber) AS id, session_id, Driver AS driver, LapNumber AS lap_number, LapTime AS lap_time, nullif(Compound, '') AS compound, CAST(TyreLife AS INTEGER) AS tyre_age FROM r WHERE {KEPT}"),
    "resample": with_stats(
        f""", t AS ({TRACE}), p AS (SELECT lap_id, i, "Distance" AS d, {_FILL.format(c='"Speed"')} AS s, {_FILL.format(c='"nGear"')} AS g FROM t WHERE "Distance" IS NOT NULL),
e AS (SELECT lap_id, arg_max(d, i) AS last_d, count(*) AS k FROM p GROUP BY lap_id),
grid AS (SELECT lap_id, CAST(unnest(range(0, CAST(ceil(last_d / 50) AS BIGINT))) * 50 AS DOUBLE) AS x FROM e WHERE k >= 2),
b AS (SELECT grid.lap_id, x, arg_max(struct_pack(d := d, s := s, g := g), d) FILTER (d <= x) AS lo, arg_min(struct_pack(d := d, s := s, g := g), d) FILTER (d > x) AS hi FROM grid JOIN p USING (lap_id) GROUP BY ALL)
SELECT lap_id, x AS distance, coalesce(lo.s + (x - lo.d) / (hi.d - lo.d) * (hi.s - lo.s), lo.s, hi.s) AS speed, CAST(0 AS DOUBLE) AS throttle,
  CAST(round_even(coalesce(lo.g + (x - lo.d) / (hi.d - lo.d) * (hi.g - lo.g), lo.g, hi.g), 0) AS INTEGER) AS gear FROM b"""
    ),
    "outliers": with_stats("SELECT id, lap_time FROM (SELECT id, lap_time, avg(lap_time) OVER g AS mu, stddev_pop(lap_time) OVER g AS sig, count(*) OVER g AS k FROM raced WHERE session_type = 'Race' WINDOW g AS (PARTITION BY season, circuit, compound)) WHERE k >= 4 AND sig > 0 AND abs(lap_time - mu) > 2 * sig"),
    "next_slower": with_stats("SELECT a.id, (SELECT min(b.lap_time) FROM laps AS b WHERE b.session_id = a.session_id AND b.lap_number = a.lap_number AND b.lap_time > a.lap_time) - a.lap_time AS gap FROM laps AS a"),
    "incremental_load": with_stats("SELECT session_id, count(*) AS n FROM laps WHERE session_id LIKE '2025%' GROUP BY ALL"),
    "corner_type_usable": with_stats("SELECT circuit, count(*) AS corners, count(distance_from_start) AS mapped, max(corner_number) AS highest FROM corners GROUP BY ALL"),
    "lap_rejects": with_stats("SELECT coalesce(CASE WHEN NOT lap_time BETWEEN 78 AND 83 THEN 'lap_time out of bounds' END, CASE WHEN NOT sector1 BETWEEN 23.0 AND 25.2 THEN 'sector1 out of bounds' END) AS reason, count(*) AS n FROM laps WHERE NOT (lap_time BETWEEN 78 AND 83 AND sector1 BETWEEN 23.0 AND 25.2) GROUP BY ALL"),
}
