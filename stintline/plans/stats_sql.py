"""The statistics of operators.statistics once more, as independent DuckDB SQL for the comparison."""

from __future__ import annotations

from ..sources.fixtures import duck_views

#: name -> SQL over the adapter tables; later ones may use earlier ones.
STATS = {
    "raced": """
SELECT l.*, s.season, s.circuit, s.session_type FROM laps AS l JOIN sessions AS s ON s.id = l.session_id WHERE is_valid = 1""",
    "tyre_clean": """
SELECT * FROM (SELECT season, circuit, compound, tyre_age, lap_time, id,
  avg(lap_time) OVER g AS mu, stddev_pop(lap_time) OVER g AS sig, count(*) OVER g AS k
  FROM raced WHERE session_type = 'Race' AND lap_time > 0 AND tyre_age IS NOT NULL AND compound <> ''
  WINDOW g AS (PARTITION BY season, circuit, compound)) WHERE k < 4 OR sig <= 0 OR abs(lap_time - mu) <= 2 * sig""",
    "tyre_fit": """
SELECT season, circuit, compound, regr_slope(lap_time, CAST(tyre_age AS DOUBLE)) AS deg FROM tyre_clean GROUP BY ALL
HAVING count(*) >= 15 AND count(DISTINCT tyre_age) >= 3""",
    "tyre_age": """
SELECT season, circuit, compound, tyre_age, avg(lap_time) AS m FROM tyre_clean GROUP BY ALL""",
    "tyre_step": """
SELECT *, (m - lag(m) OVER w) / (tyre_age - lag(tyre_age) OVER w) AS step FROM tyre_age WINDOW w AS (PARTITION BY season, circuit, compound ORDER BY tyre_age)""",
    "tyre_base": """
SELECT season, circuit, compound, count(*) AS k, count(step) AS n, median(step) AS mid, min(tyre_age) AS first_age, max(tyre_age) AS last_age FROM tyre_step GROUP BY ALL""",
    "tyre_cliff": """
SELECT season, circuit, compound, min(least(tyre_age, 40)) AS cliff FROM tyre_step JOIN tyre_base USING (season, circuit, compound)
WHERE k >= 4 AND n >= 2 AND step > greatest(0.15, 1.75 * mid) GROUP BY ALL""",
    "tyre_worn": """
SELECT season, circuit, compound, first_age, last_age, deg, min(tyre_age) FILTER ((tyre_age - first_age) * deg > 2.0) AS over_age
FROM tyre_age JOIN tyre_base USING (season, circuit, compound) JOIN tyre_fit USING (season, circuit, compound) WHERE deg > 0 AND deg <= 0.3 GROUP BY ALL""",
    "tyre_temp": """
SELECT season, circuit, compound, CASE WHEN count(DISTINCT track_temp) > 1 THEN regr_slope(lap_time - a * tyre_age, track_temp) END AS warmth
FROM (SELECT c.*, track_temp, CASE WHEN count(DISTINCT tyre_age) OVER g > 1 THEN regr_slope(lap_time, CAST(tyre_age AS DOUBLE)) OVER g ELSE 0 END AS a, count(*) OVER g AS rows_of
  FROM tyre_clean AS c JOIN weather ON lap_id = c.id WINDOW g AS (PARTITION BY season, circuit, compound)) WHERE rows_of >= 6 GROUP BY ALL""",
    "tyre_stats": """
SELECT circuit, compound, season, round(deg, 9) AS avg_deg_per_lap, cliff AS cliff_lap, viable AS max_viable_laps, round(warmth, 9) AS track_temp_sensitivity FROM (
  SELECT *, least(CASE WHEN over_age IS NULL THEN last_age ELSE greatest(over_age - 1, first_age) END, CASE WHEN cliff IS NULL THEN 1000 ELSE greatest(1, cliff - 1) END) AS viable
  FROM tyre_worn LEFT JOIN tyre_cliff USING (season, circuit, compound) LEFT JOIN tyre_temp USING (season, circuit, compound))
WHERE deg BETWEEN 0.010 AND 0.250 AND cliff BETWEEN 8 AND 35 AND viable BETWEEN 10 AND 35""",
    "driver_sector_stats": """
SELECT * FROM (SELECT driver, circuit, season,
  round(avg(d1) FILTER (d1 BETWEEN -2 AND 5), 9) AS avg_sector1_delta, round(avg(d2) FILTER (d2 BETWEEN -2 AND 5), 9) AS avg_sector2_delta, round(avg(d3) FILTER (d3 BETWEEN -2 AND 5), 9) AS avg_sector3_delta
  FROM (SELECT driver, circuit, season, sector1 - first_value(sector1) OVER w AS d1, sector2 - first_value(sector2) OVER w AS d2, sector3 - first_value(sector3) OVER w AS d3
    FROM raced WHERE session_type = 'Q' AND lap_time IS NOT NULL WINDOW w AS (PARTITION BY session_id ORDER BY lap_time, id)) GROUP BY ALL)
WHERE coalesce(avg_sector1_delta, avg_sector2_delta, avg_sector3_delta) IS NOT NULL""",
    "speed_trap_stats": """
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY circuit, season ORDER BY avg_top_speed DESC, driver) AS INTEGER) AS rank_in_field FROM (
  SELECT driver, circuit, season, round(avg(top), 9) AS avg_top_speed FROM (SELECT lap_id, max(speed) AS top FROM telemetry WHERE speed BETWEEN 250 AND 380 GROUP BY lap_id)
  JOIN raced ON id = lap_id WHERE session_type = 'Race' GROUP BY ALL)) WHERE avg_top_speed BETWEEN 280 AND 370""",
    "minima": """
SELECT lap_id, distance, speed FROM (SELECT *, lag(speed) OVER w AS b, lead(speed) OVER w AS a, quantile_cont(speed, 0.6) OVER (PARTITION BY lap_id) AS p60
  FROM telemetry WINDOW w AS (PARTITION BY lap_id ORDER BY distance)) WHERE speed <= b AND speed < a AND speed <= p60""",
    "corner_reach": """
SELECT *, greatest(60, least(250, least(coalesce(distance_from_start - lag(distance_from_start) OVER w, 1e9), coalesce(lead(distance_from_start) OVER w - distance_from_start, 1e9)) / 2)) AS tolerance
FROM corners WINDOW w AS (PARTITION BY circuit ORDER BY distance_from_start, corner_number)""",
    "corner_hits": """
SELECT driver, circuit, lap_id, corner_number, min(speed) AS speed FROM (
  SELECT driver, c.circuit, lap_id, distance, speed, corner_number, tolerance, abs(distance - distance_from_start) AS away,
    row_number() OVER (PARTITION BY lap_id, distance ORDER BY abs(distance - distance_from_start), corner_number) AS rn
  FROM minima JOIN raced ON id = lap_id JOIN corner_reach AS c ON c.circuit = raced.circuit) WHERE rn = 1 AND away <= tolerance GROUP BY ALL""",
    "corner_means": """
SELECT *, avg(avg_min_speed) OVER (PARTITION BY circuit, corner_number) AS field FROM (SELECT driver, circuit, corner_number, avg(speed) AS avg_min_speed FROM corner_hits GROUP BY ALL)""",
    "corner_stats": """
SELECT driver, circuit, corner_number, round(avg_min_speed, 9) AS avg_min_speed, round(avg_min_speed - field, 9) AS delta_vs_field FROM corner_means WHERE avg_min_speed BETWEEN 60 AND 320""",
    "corners_typed": """
SELECT circuit, corner_number, distance_from_start, CASE WHEN field < 100 THEN 'slow' WHEN field <= 180 THEN 'medium' WHEN field IS NOT NULL THEN 'high' END AS corner_type
FROM corners LEFT JOIN (SELECT circuit, corner_number, any_value(field) AS field FROM corner_means WHERE avg_min_speed BETWEEN 60 AND 320 GROUP BY ALL) USING (circuit, corner_number)""",
    "fuel_stats": """
WITH r AS (SELECT session_id, driver, circuit, season, compound, tyre_age, lap_number, lap_time, max(lap_number) OVER (PARTITION BY session_id) AS race_end FROM raced WHERE session_type = 'Race'),
o AS (SELECT *, max(lap_number) OVER d AS own_end, count(*) OVER d AS own_laps FROM r WHERE lap_time IS NOT NULL AND tyre_age IS NOT NULL AND compound <> '' WINDOW d AS (PARTITION BY session_id, driver)),
u AS (SELECT * FROM o WHERE race_end >= 30 AND own_laps >= 30 AND own_end >= race_end - 3 AND lap_number < own_end),
p AS (SELECT e.session_id, e.driver, e.circuit, e.season, (e.lap_time - l.lap_time) * 10.0 / ((l.lap_number - e.lap_number) * CAST(1.7 AS DOUBLE)) AS effect
  FROM u AS e JOIN u AS l ON e.session_id = l.session_id AND e.driver = l.driver AND e.compound = l.compound
  WHERE e.lap_number BETWEEN 2 AND 6 AND l.lap_number >= l.own_end - 5 AND abs(e.tyre_age - l.tyre_age) <= 2 AND l.lap_number - e.lap_number >= 20)
SELECT driver, circuit, season, round(median(effect), 9) AS fuel_effect_per_10kg FROM (SELECT *, count(*) OVER (PARTITION BY session_id, driver) AS n FROM p WHERE abs(effect) <= 3.0) WHERE n >= 3 GROUP BY ALL""",
    "quali_race_delta": """
SELECT driver, circuit, season, round(quali_lap, 9) AS quali_lap, round(avg_race_pace, 9) AS avg_race_pace, round(CASE WHEN avg_race_pace - quali_lap BETWEEN 2.0 AND 15.0 THEN avg_race_pace - quali_lap END, 9) AS delta
FROM (SELECT driver, circuit, season, min(lap_time) AS quali_lap FROM raced WHERE session_type = 'Q' GROUP BY ALL)
JOIN (SELECT driver, circuit, season, median(lap_time) AS avg_race_pace FROM (
  SELECT *, max(lap_number) OVER (PARTITION BY session_id, driver) AS total FROM raced WHERE session_type = 'Race') WHERE lap_number >= 5 AND lap_number <= total - 3 GROUP BY ALL)
USING (driver, circuit, season)""",
    "driver_session_counts": """
SELECT driver, count(DISTINCT session_id) AS n_sessions, count(DISTINCT session_id) < 3 AS sparse FROM laps GROUP BY driver""",
}


def with_stats(body: str) -> str:
    """A DuckDB query over the adapter tables and the statistics."""
    parts = ", ".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in STATS.items())
    return f"WITH {duck_views()}, {parts}{body if body.startswith(chr(44)) else chr(32) + body}"
