"""The facts of every question template once more, as independent DuckDB SQL for the comparison.

Nothing here is made from the templates' own relations: conditions, joins, pivots and rankings are written
out again, where there is a choice in other words.
"""

from __future__ import annotations

from ..functions.constants import FULL_NAMES

_TYRE = "circuit, season, compound, avg_deg_per_lap, cliff_lap, max_viable_laps"
_GATE = "avg_deg_per_lap >= 0.010 AND avg_deg_per_lap <= 0.250 AND cliff_lap >= 8 AND cliff_lap <= 35 AND max_viable_laps >= 10 AND max_viable_laps <= 45"
_DELTA = "avg_sector1_delta, avg_sector2_delta, avg_sector3_delta"
_SUM = "avg_sector1_delta + avg_sector2_delta + avg_sector3_delta"
_ALL = "(avg_sector1_delta + avg_sector2_delta + avg_sector3_delta) IS NOT NULL"
#: The number of the sector with the greatest or the least delta, the lowest on ties.
_WEAK = f"CAST(list_position([{_DELTA}], list_max([{_DELTA}])) AS INTEGER)"
_STRONG = f"CAST(list_position([{_DELTA}], list_min([{_DELTA}])) AS INTEGER)"
_TYPED = "corner_stats JOIN (SELECT circuit, corner_number, corner_type FROM corners_typed) USING (circuit, corner_number)"
_FORMS = """
SELECT circuit, count(*) FILTER (corner_type = 'slow') AS n_slow, count(*) FILTER (corner_type = 'medium') AS n_med, count(*) FILTER (corner_type = 'high') AS n_high, count(corner_type) AS total,
  ['slow', 'medium', 'high'][list_position([n_slow, n_med, n_high], greatest(n_slow, n_med, n_high))] AS dominant
FROM corners_typed GROUP BY circuit HAVING count(corner_type) >= 5"""
_PAIR = """
SELECT circuit, season, x.driver AS d1, y.driver AS d2, x.avg_sector1_delta AS a1, x.avg_sector2_delta AS a2, x.avg_sector3_delta AS a3, y.avg_sector1_delta AS b1, y.avg_sector2_delta AS b2, y.avg_sector3_delta AS b3
FROM driver_sector_stats AS x JOIN driver_sector_stats AS y USING (circuit, season) WHERE y.driver > x.driver"""
_FULL_PAIR = f"SELECT * FROM ({_PAIR}) WHERE (a1 + a2 + a3 + b1 + b2 + b3) IS NOT NULL"


def _best(table: str, value: str, columns: str, where: str = "true") -> str:
    """The row of each event with the least value."""
    return f"SELECT {columns} FROM {table} WHERE {where} QUALIFY row_number() OVER (PARTITION BY season, circuit ORDER BY {value}) = 1"


def _podium(value: str) -> str:
    rows = f"list(driver ORDER BY {value}, driver) AS d, list({value} ORDER BY {value}, driver) AS v"
    return f"SELECT circuit, season, d[1] AS d1, v[1] AS v1, d[2] AS d2, v[2] AS v2, d[3] AS d3, v[3] AS v3 FROM (SELECT circuit, season, {rows} FROM quali_race_delta WHERE {value} IS NOT NULL GROUP BY ALL) WHERE len(d) >= 3"


def _typed(kind: str) -> str:
    return f"SELECT driver, circuit, round(avg(avg_min_speed), 9) AS speed, round(avg(delta_vs_field), 9) AS avg_delta, count(*) AS n_corners FROM {_TYPED} WHERE corner_type = '{kind}' GROUP BY ALL HAVING n_corners > 1"


def _strategy(where: str = "true", more: str = "") -> str:
    return f"SELECT {_TYRE}{more} FROM tyre_stats WHERE {_GATE} AND {where}"


def _scene(low: int, high: int, n: int, salt: str = "") -> str:
    """Laps of a race with the tyre statistics of their compound, drawn by a hash."""
    draw = f"md5(concat_ws('|', {salt}season, circuit, driver, lap_number))"
    return f"""
SELECT season, circuit, driver, lap_number, tyre_age, compound, avg_deg_per_lap, cliff_lap, max_viable_laps, cliff_lap - tyre_age AS margin
FROM raced JOIN tyre_stats USING (season, circuit, compound) WHERE session_type = 'Race' AND tyre_age >= {low} AND tyre_age <= {high} AND {_GATE}
ORDER BY {draw} LIMIT {n}"""


FACTS: dict[str, str] = {
    "t01_tyre_deg_rate": f"SELECT {_TYRE} FROM tyre_stats WHERE avg_deg_per_lap > 0 AND NOT max_viable_laps IS NULL",
    "t02_tyre_cliff": "SELECT circuit, season, compound, cliff_lap, max_viable_laps FROM tyre_stats WHERE NOT cliff_lap IS NULL",
    "t03_compound_compare": "SELECT circuit, season, a.compound AS c1, a.avg_deg_per_lap AS d1, a.max_viable_laps AS m1, b.compound AS c2, b.avg_deg_per_lap AS d2, b.max_viable_laps AS m2, if(b.avg_deg_per_lap <= a.avg_deg_per_lap, b.compound, a.compound) AS durable FROM tyre_stats AS a JOIN tyre_stats AS b USING (circuit, season) WHERE b.compound > a.compound",
    "t04_best_long_stint": _best("tyre_stats", "avg_deg_per_lap, compound", _TYRE, "max_viable_laps IS NOT NULL"),
    "t05_temp_sensitivity": "SELECT circuit, season, compound, track_temp_sensitivity, avg_deg_per_lap, if(track_temp_sensitivity > 0, 'worse', 'better') AS direction FROM tyre_stats WHERE track_temp_sensitivity > 0.005 OR track_temp_sensitivity < -0.005",
    "t06_driver_sector_strengths": f"SELECT driver, circuit, season, {_DELTA}, {_STRONG} AS best, {_WEAK} AS worst FROM driver_sector_stats WHERE {_ALL}",
    "t07_driver_sector_vs_field": f"""
SELECT driver, circuit, season, {_DELTA}, array_to_string(list_filter(list_transform([{_DELTA}], lambda d, i: if(d > 0.05, 'Sector ' || i, NULL)), lambda x: x IS NOT NULL), ' and ') AS lost,
  array_to_string(list_filter(list_transform([{_DELTA}], lambda d, i: if(d < -0.05, 'Sector ' || i, NULL)), lambda x: x IS NOT NULL), ' and ') AS gained
FROM driver_sector_stats WHERE {_ALL} AND greatest(abs(avg_sector1_delta), abs(avg_sector2_delta), abs(avg_sector3_delta)) > 0.05""",
    "t08_speed_trap_leader": "SELECT circuit, season, driver, avg_top_speed FROM speed_trap_stats WHERE rank_in_field < 2",
    "t09_driver_speed_rank": "SELECT driver, circuit, season, avg_top_speed, rank_in_field, ['fastest', 'second fastest', 'third fastest'][rank_in_field] AS place FROM speed_trap_stats WHERE rank_in_field < 4",
    "t10_corner_min_speed": "SELECT driver, circuit, corner_number, avg_min_speed, delta_vs_field, coalesce((SELECT any_value(corner_type) FROM corners_typed AS c WHERE c.circuit = s.circuit AND c.corner_number = s.corner_number), 'unknown') AS corner_type FROM corner_stats AS s",
    "t11_high_speed_corners": _typed("high"),
    "t12_slow_speed_corners": _typed("slow"),
    "t13_circuit_corner_types": _FORMS,
    "t14_fuel_effect_circuit": "SELECT circuit, season, round(avg(fuel_effect_per_10kg), 9) AS effect, count(fuel_effect_per_10kg) AS n_drivers FROM fuel_stats GROUP BY ALL HAVING n_drivers > 2",
    "t15_driver_fuel_sensitivity": "SELECT driver, circuit, season, fuel_effect_per_10kg, if(fuel_effect_per_10kg > 0.25, 'large', 'modest') AS size FROM fuel_stats",
    "t16_quali_race_converts": "SELECT driver, circuit, season, quali_lap, avg_race_pace, delta FROM quali_race_delta WHERE delta = delta",
    "t17_best_quali_at_circuit": _best("quali_race_delta", "quali_lap, driver", "circuit, season, driver, quali_lap"),
    "t18_best_race_pace": _best("quali_race_delta", "avg_race_pace, driver", "circuit, season, driver, avg_race_pace"),
    "t19_large_quali_race_gap": "SELECT driver, circuit, season, quali_lap, avg_race_pace, delta FROM quali_race_delta WHERE NOT delta <= 5",
    "t20_sector1_specialist": _best("driver_sector_stats", "avg_sector1_delta, driver", "circuit, season, driver, avg_sector1_delta", "avg_sector1_delta IS NOT NULL"),
    "t21_sector3_specialist": _best("driver_sector_stats", "avg_sector3_delta, driver", "circuit, season, driver, avg_sector3_delta", "avg_sector3_delta IS NOT NULL"),
    "t22_speed_trap_range": "SELECT circuit, season, list_max(v) AS fastest, list_min(v) AS slowest, CAST(len(v) AS BIGINT) AS n_drivers, list_max(v) - list_min(v) AS spread FROM (SELECT circuit, season, list(avg_top_speed) AS v FROM speed_trap_stats GROUP BY ALL) WHERE len(v) > 4",
    "t23_tyre_deg_season_delta": "SELECT circuit, compound, a.season AS s1, a.avg_deg_per_lap AS d1, b.season AS s2, b.avg_deg_per_lap AS d2, abs(b.avg_deg_per_lap - a.avg_deg_per_lap) AS change, if(b.avg_deg_per_lap < a.avg_deg_per_lap, b.season, a.season) AS kinder FROM tyre_stats AS a JOIN tyre_stats AS b USING (circuit, compound) WHERE b.season > a.season",
    "t24_driver_corner_profile": """
SELECT driver, circuit, min(delta_vs_field) AS min_delta, max(delta_vs_field) AS max_delta, count(*) AS n_corners,
  first(corner_number ORDER BY round(delta_vs_field, 6), corner_number) AS min_corner, first(corner_number ORDER BY round(delta_vs_field, 6) DESC, corner_number) AS max_corner
FROM corner_stats GROUP BY ALL HAVING n_corners > 3""",
    "t25_best_race_converters": _best("quali_race_delta", "delta, driver", "circuit, season, driver, delta, quali_lap, avg_race_pace", "delta > 0"),
    "t26_compound_viability": _best("tyre_stats", "max_viable_laps DESC, compound", _TYRE, "avg_deg_per_lap IS NOT NULL"),
    "t27_field_corner_speed_by_type": f"SELECT circuit, corner_type, round(avg(avg_min_speed), 9) AS field_avg, count(DISTINCT corner_number) AS n_corners FROM {_TYPED} WHERE corner_type IS NOT NULL GROUP BY ALL HAVING n_corners > 1",
    "t28_speed_trap_top5": "SELECT circuit, season, CAST(len(d) AS BIGINT) AS n, d[list_position(k, 1)] AS d1, v[list_position(k, 1)] AS v1, d[list_position(k, 2)] AS d2, v[list_position(k, 2)] AS v2, d[list_position(k, 3)] AS d3, v[list_position(k, 3)] AS v3, d[list_position(k, 4)] AS d4, v[list_position(k, 4)] AS v4, d[list_position(k, 5)] AS d5, v[list_position(k, 5)] AS v5 FROM (SELECT circuit, season, list(driver ORDER BY rank_in_field) AS d, list(avg_top_speed ORDER BY rank_in_field) AS v, list(rank_in_field ORDER BY rank_in_field) AS k FROM speed_trap_stats WHERE rank_in_field < 6 GROUP BY ALL) WHERE len(d) > 2",
    "t29_quali_summary": _best("driver_sector_stats", f"round({_SUM}, 9), driver", f"circuit, season, driver, {_DELTA}, {_SUM} AS total", _ALL),
    "t30_tyre_deg_vs_speed": "SELECT circuit, season, compound, avg_deg_per_lap, max_viable_laps, top AS avg_top_speed FROM tyre_stats JOIN (SELECT circuit, season, avg_top_speed AS top FROM speed_trap_stats WHERE rank_in_field < 2) USING (circuit, season)",
    "e01_pit_window_open": _strategy(more=", if(cliff_lap > 4, cliff_lap - 3, 1) AS open_lap"),
    "e02_extend_or_box": _strategy(more=", if(cliff_lap > 10, cliff_lap - 2, 8) AS age, if(if(cliff_lap > 10, cliff_lap - 2, 8) + 2 < max_viable_laps, 'extend', 'box soon') AS decision"),
    "e03_low_deg_stretch": _strategy("NOT avg_deg_per_lap > 0.040"),
    "e04_high_deg_protect": _strategy("NOT avg_deg_per_lap < 0.080"),
    "e05_best_compound_for_offset": _best("tyre_stats", "max_viable_laps DESC, avg_deg_per_lap, compound", _TYRE, _GATE),
    "e06_compound_risk_rank": f"""
SELECT circuit, season, array_to_string(list_sort(l), ' | ') AS summary, CAST(len(l) AS BIGINT) AS n FROM (
  SELECT circuit, season, list(compound || ':' || CAST(round(avg_deg_per_lap, 3) AS DECIMAL(9, 3)) || ':' || max_viable_laps) AS l FROM tyre_stats WHERE {_GATE} GROUP BY ALL) WHERE len(l) > 1""",
    "e07_sector_attack_plan": f"SELECT driver, circuit, season, {_DELTA}, {_WEAK} AS worst FROM driver_sector_stats WHERE {_ALL}",
    "e08_sector_strength_defend": f"SELECT driver, circuit, season, {_DELTA}, {_STRONG} AS best FROM driver_sector_stats WHERE {_ALL}",
    "e09_head_to_head_sector_edge": f"SELECT *, if(a1 > b1, d2, d1) AS w1, if(a2 > b2, d2, d1) AS w2, if(a3 > b3, d2, d1) AS w3, greatest(a1, b1) - least(a1, b1) AS m1, greatest(a2, b2) - least(a2, b2) AS m2, greatest(a3, b3) - least(a3, b3) AS m3 FROM ({_FULL_PAIR})",
    "e10_top_speed_vs_sector_loss": f"SELECT driver, circuit, season, {_DELTA}, avg_top_speed, rank_in_field, {_SUM} AS total FROM driver_sector_stats JOIN speed_trap_stats USING (driver, circuit, season) WHERE rank_in_field < 6 AND {_ALL}",
    "e11_speed_setup_signal": "SELECT circuit, season, list_max(v) AS fastest, list_min(v) AS slowest, round(list_avg(v), 9) AS avg_speed, CAST(len(v) AS BIGINT) AS n, list_max(v) - list_min(v) AS spread FROM (SELECT circuit, season, list(avg_top_speed) AS v FROM speed_trap_stats GROUP BY ALL) WHERE len(v) > 7",
    "e12_corner_attack": "SELECT driver, circuit, corner_number, avg_min_speed, delta_vs_field FROM corner_stats WHERE delta_vs_field >= 3 OR delta_vs_field <= -3",
    "e13_corner_type_setup": f"SELECT driver, circuit, corner_type, round(avg(avg_min_speed), 9) AS avg_speed, round(avg(delta_vs_field), 9) AS avg_delta, count(*) AS n FROM {_TYPED} WHERE corner_type IS NOT NULL GROUP BY ALL HAVING n > 1",
    "e14_corner_consistency": "SELECT driver, circuit, list_min(v) AS min_delta, list_max(v) AS max_delta, CAST(len(v) AS BIGINT) AS n, list_max(v) - list_min(v) AS spread FROM (SELECT driver, circuit, list(delta_vs_field) AS v FROM corner_stats GROUP BY ALL) WHERE len(v) > 5",
    "e15_fuel_phase_strategy": "SELECT driver, circuit, season, fuel_effect_per_10kg FROM fuel_stats",
    "e16_quali_to_race_setup": "SELECT driver, circuit, season, quali_lap, avg_race_pace, delta FROM quali_race_delta WHERE delta >= 2 AND delta <= 15",
    "e17_race_pace_order": _podium("avg_race_pace"),
    "e18_quali_pace_order": _podium("quali_lap"),
    "e19_strategy_snapshot": f"SELECT {_TYRE}, (SELECT max(avg_top_speed) FROM speed_trap_stats AS s WHERE s.circuit = t.circuit AND s.season = t.season) AS fastest_speed FROM tyre_stats AS t WHERE {_GATE}",
    "e20_lap_query_from_real_laps": _scene(6, 30, 500),
    "e21_clean_air_priority": _strategy("NOT avg_deg_per_lap < 0.050"),
    "e22_push_lap_timing": _strategy(more=", if(cliff_lap > 2, cliff_lap - 1, 1) AS push_age"),
    "e23_undercut_pressure": _strategy("NOT avg_deg_per_lap < 0.035"),
    "e24_overcut_case": _strategy("NOT avg_deg_per_lap > 0.035"),
    "k1_tyre_corrections": _strategy(more=", if(max_viable_laps > 9, max_viable_laps - 6, 3) AS wrong_max"),
    "k2_corner_type_corrections": f"SELECT *, ['high-speed', 'slow-speed', 'slow-speed'][list_position(['slow', 'medium', 'high'], dominant)] AS wrong FROM ({_FORMS})",
    "k3_driver_comparison_corrections": f"SELECT *, a1 + a2 + a3 AS total1, b1 + b2 + b3 AS total2, if(a1 + a2 + a3 > b1 + b2 + b3, d2, d1) AS stronger, if(a1 + a2 + a3 > b1 + b2 + b3, d1, d2) AS weaker FROM ({_FULL_PAIR}) ORDER BY season, circuit, d1, d2 LIMIT 200",
    "b1_strategy_examples": _scene(8, 28, 600, "'boost', "),
    "b2_corner_type_examples": _FORMS,
    "b3_sparse_comparison_examples": f"""
WITH r AS (SELECT * FROM quali_race_delta WHERE quali_lap + avg_race_pace IS NOT NULL)
SELECT p.*, x.quali_lap AS q1, y.quali_lap AS q2, x.avg_race_pace AS r1, y.avg_race_pace AS r2 FROM ({_FULL_PAIR}) AS p, r AS x, r AS y
WHERE (x.driver, x.circuit, x.season) = (p.d1, p.circuit, p.season) AND (y.driver, y.circuit, y.season) = (p.d2, p.circuit, p.season) ORDER BY p.season, p.circuit, d1, d2 LIMIT 400""",
    "m2a_tyre_behaviour": f"SELECT {_TYRE}, track_temp_sensitivity FROM tyre_stats ORDER BY md5(concat_ws('|', season, circuit, compound)) LIMIT 200",
    "m2b_undercut_strategy": f"""
SELECT {_TYRE}, (SELECT arg_min(fuel_effect_per_10kg, driver) FROM fuel_stats AS f WHERE f.circuit = t.circuit AND f.season = t.season) AS fuel,
  (SELECT arg_min(avg_race_pace, driver) FROM quali_race_delta AS q WHERE q.circuit = t.circuit AND q.season = t.season) AS pace
FROM tyre_stats AS t ORDER BY md5(concat_ws('|', season, circuit, compound)) LIMIT 200""",
    "m2c_driver_characteristics": f"""
SELECT driver, circuit, season, {_DELTA}, avg_top_speed, rank_in_field, quali_lap, avg_race_pace, delta
FROM driver_sector_stats NATURAL LEFT JOIN speed_trap_stats NATURAL LEFT JOIN quali_race_delta WHERE avg_sector1_delta IS NOT NULL
ORDER BY md5(concat_ws('|', season, circuit, driver)) LIMIT 200""",
    "m2d_circuit_strategy": """
SELECT circuit, season, string_agg(compound || ':' || CAST(round(avg_deg_per_lap, 4) AS DECIMAL(9, 4)) || ':' || coalesce(CAST(max_viable_laps AS VARCHAR), 'N/A'), ' | ' ORDER BY compound) AS summary, min(avg_deg_per_lap) AS deg,
  (SELECT round(avg(fuel_effect_per_10kg), 9) FROM fuel_stats AS f WHERE f.circuit = t.circuit AND f.season = t.season) AS fuel, (SELECT min(avg_race_pace) FROM quali_race_delta AS q WHERE q.circuit = t.circuit AND q.season = t.season) AS pace
FROM tyre_stats AS t GROUP BY circuit, season ORDER BY md5(season || '|' || circuit) LIMIT 200""",
    "m2e_driver_comparison": f"""
SELECT p.*, x.avg_top_speed AS v1, x.rank_in_field AS r1, y.avg_top_speed AS v2, y.rank_in_field AS r2 FROM ({_PAIR}) AS p
LEFT JOIN speed_trap_stats AS x ON (x.driver, x.circuit, x.season) = (p.d1, p.circuit, p.season) LEFT JOIN speed_trap_stats AS y ON (y.driver, y.circuit, y.season) = (p.d2, p.circuit, p.season)
WHERE a1 IS NOT NULL AND b1 IS NOT NULL ORDER BY md5(concat_ws('|', p.season, p.circuit, d1, d2)) LIMIT 200""",
    "m3_race_moments": """
SELECT season, circuit, driver, lap_number, tyre_age, compound, avg_deg_per_lap, cliff_lap, max_viable_laps, round(lap_time, 9) AS lap_time, round(sector1, 9) AS sector1, round(sector2, 9) AS sector2, round(sector3, 9) AS sector3, fuel_effect_per_10kg, avg_race_pace
FROM raced JOIN tyre_stats USING (season, circuit, compound) LEFT JOIN fuel_stats USING (season, circuit, driver) LEFT JOIN (SELECT season, circuit, driver, avg_race_pace FROM quali_race_delta) USING (season, circuit, driver)
WHERE session_type = 'Race' AND tyre_age >= 8 AND tyre_age <= 25 AND lap_number >= 20 AND lap_number <= 50 AND lap_time IS NOT NULL AND compound IS NOT NULL
ORDER BY md5(concat_ws('|', 'moment', season, circuit, driver, lap_number)) LIMIT 600""",
    "stay_out": """
WITH c AS (SELECT * FROM raced JOIN tyre_stats USING (season, circuit, compound)
  WHERE session_type = 'Race' AND NOT list_contains(['Bahrain', 'Bahraini', 'Monaco', 'Monegasque', 'Belgium', 'Belgian', 'Hungary', 'Hungarian', 'Italy', 'Italian', 'Singapore'], circuit)
  AND lap_time IS NOT NULL AND avg_deg_per_lap >= 0.01 AND avg_deg_per_lap <= 0.12 AND cliff_lap >= 12 AND cliff_lap <= 35 AND max_viable_laps >= 12 AND max_viable_laps <= 45
  AND tyre_age + 3 <= cliff_lap AND tyre_age + 3 <= max_viable_laps ORDER BY md5(concat_ws('|', 'stay', season, circuit, driver, lap_number)) LIMIT 1000),
g AS (SELECT c.*, (SELECT min(o.lap_time) FROM laps AS o WHERE o.session_id = c.session_id AND o.lap_number = c.lap_number AND o.driver <> c.driver AND o.is_valid = 1 AND o.lap_time > c.lap_time) - c.lap_time AS gap FROM c)
SELECT season, circuit, driver, lap_number, tyre_age, compound, avg_deg_per_lap, cliff_lap, max_viable_laps, gap, cliff_lap - tyre_age AS margin FROM g WHERE gap >= 0.1 AND gap <= 5""",
}


def _named(code: str) -> str:
    """A driver's name, looked up in a map of all of them."""
    pairs = ", ".join(f"'{c}': '{n}'" for c, n in FULL_NAMES.items())
    return f"coalesce(map_extract(MAP {{{pairs}}}, {code})[1], {code})"


_COMP = "upper(compound[1]) || lower(compound[2:])"
#: Questions worded apart from the templates' own text.
QUESTIONS = {
    "k1_tyre_corrections": f"printf('The %s at %s in %d is basically unusable after %d laps, right?', {_COMP}, circuit, season, wrong_max)",
    "k2_corner_type_corrections": "printf('%s is mainly a %s circuit, isn''t it?', circuit, wrong)",
    "k3_driver_comparison_corrections": f"printf('%s clearly had the edge over %s at %s in %d, right?', {_named('weaker')}, {_named('stronger')}, circuit, season)",
    "b1_strategy_examples": f"printf('%s is on lap %d at %s in %d on %s tyres aged %d laps. What matters most for the strategy call?', {_named('driver')}, lap_number, circuit, season, {_COMP}, tyre_age)",
    "b2_corner_type_examples": "printf('What setup story does the corner mix tell us for %s?', circuit)",
    "b3_sparse_comparison_examples": f"printf('Give me a compact comparison of %s vs %s at %s in %d.', {_named('d1')}, {_named('d2')}, circuit, season)",
    "e07_sector_attack_plan": f"printf('What sector should %s focus on at %s in %d?', {_named('driver')}, circuit, season)",
    "e09_head_to_head_sector_edge": f"printf('Compare %s and %s by sector at %s in %d.', {_named('d1')}, {_named('d2')}, circuit, season)",
    "e12_corner_attack": f"printf('What should %s change through Turn %d at %s?', {_named('driver')}, corner_number, circuit)",
    "e16_quali_to_race_setup": f"printf('What does %s''s quali-to-race delta say at %s in %d?', {_named('driver')}, circuit, season)",
    "t06_driver_sector_strengths": f"printf('Where does %s gain or lose time at %s in %d?', {_named('driver')}, circuit, season)",
    "t10_corner_min_speed": f"printf('How does %s handle Turn %d at %s?', {_named('driver')}, corner_number, circuit)",
}
