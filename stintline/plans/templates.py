"""Question templates over the statistics: each yields the facts, a question and an answer per row.

A template is a relation in SQL, its facts, and two texts with {fact:format} fields. The same template makes
a Spark plan and a DuckDB query. Formats: .N (N decimals), +.N (with a sign), lap (M:SS.mmm), cap
(capitalised), abs.N, name (a driver's full name), pair and surname (the same where such questions spell them
out). Questions and the bounds of relations are fixed values, since corpora are deduplicated by them; answers
state the same facts in this engine's own words. What checks a template's facts is written apart, in templates_sql.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions import constants as K
from ..sources.fixtures import run_sql
from .stats import tables
from .stats_sql import with_stats
from .templates_sql import FACTS, QUESTIONS

#: The tyre filter that strategy templates share.
TYRE_FILTER = "avg_deg_per_lap BETWEEN 0.010 AND 0.250 AND cliff_lap BETWEEN 8 AND 35 AND max_viable_laps BETWEEN 10 AND 45"
TYRE, SECTOR, TRAP, CORNER, FUEL, RACE, TYPED = "tyre_stats", "driver_sector_stats", "speed_trap_stats", "corner_stats", "fuel_stats", "quali_race_delta", "corners_typed"
SECTORS_KNOWN = "avg_sector1_delta IS NOT NULL AND avg_sector2_delta IS NOT NULL AND avg_sector3_delta IS NOT NULL"
D1, D2, D3 = "avg_sector1_delta", "avg_sector2_delta", "avg_sector3_delta"
#: Seeded order instead of an arbitrary one where the reference draws a sample.
DRAW = "md5(concat_ws('|', {keys}))"


@dataclass(frozen=True)
class Template:
    relation: str
    facts: tuple[str, ...]
    question: str
    answer: str
    order: str = ""
    limit: int = 0

    def sql(self) -> str:
        names = [f.rsplit(" AS ", 1)[-1].strip() for f in self.facts]
        inner = f"SELECT {', '.join(self.facts)} FROM {self.relation}"
        if self.limit:
            inner = f"SELECT {', '.join(names)} FROM {drawn(f'({inner}) AS found', self.order, self.limit)}"
        return f"SELECT {', '.join(names)}, {render(self.question)} AS question, {render(self.answer)} AS answer FROM ({inner}) AS facts"


def drawn(relation: str, order: str, limit: int) -> str:
    """The first rows of a relation by an order. Its key is a column, so that it is computed once a row, and texts are
    made of these rows alone."""
    return f"(SELECT * FROM (SELECT *, struct({order}) AS _draw FROM {relation}) AS keyed ORDER BY _draw LIMIT {limit}) AS drawn"


def _spelled(column: str, names: dict[str, str]) -> str:
    return f"CASE {column} {' '.join(f'WHEN {chr(39)}{c}{chr(39)} THEN {chr(39)}{n}{chr(39)}' for c, n in names.items())} ELSE {column} END"


NAMES = {"name": K.FULL_NAMES, "pair": {c: K.FULL_NAMES[c] for c in K.PAIR_CODES}, "surname": {c: K.FULL_NAMES[c].split(" ")[-1] for c in K.STAY_OUT_CODES}}


def _field(name: str, form: str) -> str:
    if form in NAMES:
        return _spelled(name, NAMES[form])
    if form == "cap":
        return f"concat(upper(substr({name}, 1, 1)), lower(substr({name}, 2)))"
    if form == "lap":
        minutes = f"CAST(floor(round({name}, 3) / 60) AS INT)"
        return f"concat(CAST({minutes} AS STRING), ':', lpad(CAST(CAST(round(round({name}, 3) - 60 * {minutes}, 3) AS DECIMAL(9, 3)) AS STRING), 6, '0'))"
    if m := re.fullmatch(r"(\+|abs)?\.(\d)", form):
        value = f"abs({name})" if m[1] == "abs" else name
        number = f"CAST(round({value}, {m[2]}) AS DECIMAL(18, {m[2]}))"
        text = f"CAST({number} AS STRING)"
        return f"concat(CASE WHEN {number} >= 0 THEN '+' ELSE '' END, {text})" if m[1] == "+" else text
    return f"CAST({name} AS STRING)"


def render(text: str) -> str:
    """An SQL expression that fills the text's fields."""
    parts = []
    for i, piece in enumerate(re.split(r"\{([^{}]+)\}", text)):
        if i % 2:
            name, _, form = piece.partition(":")
            parts.append(_field(name, form))
        elif piece:
            parts.append("'" + piece.replace("'", "''") + "'")
    return f"concat({', '.join(parts)})"


def first(table: str, keys: str, order: str, where: str) -> str:
    """The first row of each key by an order, as a relation."""
    return f"(SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn FROM {table} WHERE {where}) AS ranked WHERE rn = 1"


def top(table: str, value: str, n: int, where: str) -> str:
    """Groups of at least three drivers with their n lowest values, as one row of names and values."""
    pick = ", ".join(f"max(CASE WHEN rn = {i} THEN driver END) AS d{i}, max(CASE WHEN rn = {i} THEN {value} END) AS v{i}" for i in range(1, n + 1))
    return f"(SELECT circuit, season, count(*) AS n, {pick} FROM (SELECT *, row_number() OVER (PARTITION BY circuit, season ORDER BY {value}, driver) AS rn FROM {table} WHERE {where}) AS r GROUP BY circuit, season HAVING count(*) >= 3) AS tops"


AT = "At {circuit} in {season}, "
TYRE_FACTS = ("circuit", "season", "compound", "avg_deg_per_lap", "cliff_lap", "max_viable_laps")
TYRE_TAIL = "degradation {avg_deg_per_lap:.3} s/lap, cliff at lap {cliff_lap}, viable for {max_viable_laps} laps."
WHERE_TYPED = f"{CORNER} AS cs JOIN {TYPED} AS c ON c.circuit = cs.circuit AND c.corner_number = cs.corner_number"
DELTAS = "S1 {avg_sector1_delta:+.3}s, S2 {avg_sector2_delta:+.3}s, S3 {avg_sector3_delta:+.3}s"
WORST = f"CASE WHEN {D1} >= {D2} AND {D1} >= {D3} THEN 1 WHEN {D2} >= {D3} THEN 2 ELSE 3 END"
BEST = f"CASE WHEN {D1} <= {D2} AND {D1} <= {D3} THEN 1 WHEN {D2} <= {D3} THEN 2 ELSE 3 END"
BY_TYPE = "sum(CASE WHEN corner_type = 'slow' THEN 1 ELSE 0 END) AS n_slow, sum(CASE WHEN corner_type = 'medium' THEN 1 ELSE 0 END) AS n_med, sum(CASE WHEN corner_type = 'high' THEN 1 ELSE 0 END) AS n_high, count(*) AS total"
PIVOT = f"(SELECT circuit, {BY_TYPE} FROM {TYPED} WHERE corner_type IS NOT NULL GROUP BY circuit HAVING count(*) >= 5) AS p"
DOMINANT = "CASE WHEN n_slow >= n_med AND n_slow >= n_high THEN 'slow' WHEN n_med >= n_high THEN 'medium' ELSE 'high' END"
PIVOT_FACTS = ("circuit", "CAST(n_slow AS BIGINT) AS n_slow", "CAST(n_med AS BIGINT) AS n_med", "CAST(n_high AS BIGINT) AS n_high", "total", f"{DOMINANT} AS dominant")


def _typed_means(kind: str) -> str:
    return f"(SELECT cs.driver, cs.circuit, round(avg(cs.avg_min_speed), 9) AS speed, round(avg(cs.delta_vs_field), 9) AS avg_delta, count(*) AS n_corners FROM {WHERE_TYPED} WHERE c.corner_type = '{kind}' GROUP BY cs.driver, cs.circuit HAVING count(*) >= 2) AS t"


def _pairs(table: str, on: str, columns: str, where: str) -> str:
    return f"(SELECT a.circuit, {columns} FROM {table} AS a JOIN {table} AS b ON a.circuit = b.circuit AND {on} WHERE {where}) AS pairs"


def _strategy(where: str, question: str, answer: str, *more: str) -> Template:
    return Template(f"{TYRE} WHERE {TYRE_FILTER}{where}", (*TYRE_FACTS, *more), question, answer + " " + AT + "{compound:cap}: " + TYRE_TAIL)


SECTOR_PAIR = _pairs(SECTOR, "a.season = b.season AND a.driver < b.driver", f"a.season, a.driver AS d1, b.driver AS d2, a.{D1} AS a1, a.{D2} AS a2, a.{D3} AS a3, b.{D1} AS b1, b.{D2} AS b2, b.{D3} AS b3", " AND ".join(f"{x}.{c} IS NOT NULL" for x in "ab" for c in (D1, D2, D3)))
PAIR_FACTS = ("circuit", "season", "d1", "d2", "a1", "a2", "a3", "b1", "b2", "b3")
LAP_JOIN = f"(SELECT l.driver, l.lap_number, l.tyre_age, l.compound, l.lap_time, s.circuit, s.season, ts.avg_deg_per_lap, ts.cliff_lap, ts.max_viable_laps FROM laps AS l JOIN sessions AS s ON s.id = l.session_id JOIN {TYRE} AS ts ON ts.circuit = s.circuit AND ts.season = s.season AND ts.compound = l.compound WHERE s.session_type = 'Race' AND l.is_valid = 1 AND l.tyre_age BETWEEN {{low}} AND {{high}} AND {TYRE_FILTER.replace('avg_deg', 'ts.avg_deg').replace('cliff_lap', 'ts.cliff_lap').replace('max_viable', 'ts.max_viable')}) AS j"
LAP_KEYS = "CAST(season AS STRING), circuit, driver, CAST(lap_number AS STRING)"
LAP_FACTS = ("season", "circuit", "driver", "lap_number", "tyre_age", "compound", "avg_deg_per_lap", "cliff_lap", "max_viable_laps", "cliff_lap - tyre_age AS margin")

#: A thousand race laps that may stay out, and the time to the next slower lap of that number in the session: laps meet
#: these thousand alone.
STAYING = f"(SELECT l.id, l.session_id, l.driver, l.lap_number, l.tyre_age, l.compound, l.lap_time, s.circuit, s.season, t.avg_deg_per_lap, t.cliff_lap, t.max_viable_laps FROM laps AS l JOIN sessions AS s ON s.id = l.session_id JOIN {TYRE} AS t ON t.circuit = s.circuit AND t.season = s.season AND t.compound = l.compound WHERE s.session_type = 'Race' AND s.circuit NOT IN ({', '.join(repr(c) for c in K.HELD_OUT)}) AND l.is_valid = 1 AND l.tyre_age IS NOT NULL AND l.lap_time IS NOT NULL AND t.avg_deg_per_lap BETWEEN 0.010 AND 0.120 AND t.cliff_lap BETWEEN 12 AND 35 AND t.max_viable_laps BETWEEN 12 AND 45 AND l.tyre_age <= t.cliff_lap - 3 AND l.tyre_age <= t.max_viable_laps - 3) AS staying"
STAYING_FACTS = ", ".join(f"drawn.{c}" for c in ("id", "session_id", "driver", "lap_number", "tyre_age", "compound", "lap_time", "circuit", "season", "avg_deg_per_lap", "cliff_lap", "max_viable_laps"))
STAYING_DRAW = DRAW.format(keys="'stay', " + LAP_KEYS)
BEHIND = f"(SELECT {STAYING_FACTS}, min(n.lap_time) - drawn.lap_time AS gap FROM {drawn(STAYING, STAYING_DRAW, 1000)} JOIN laps AS n ON n.session_id = drawn.session_id AND n.lap_number = drawn.lap_number AND n.lap_time > drawn.lap_time WHERE n.is_valid = 1 GROUP BY {STAYING_FACTS} HAVING min(n.lap_time) - drawn.lap_time BETWEEN 0.1 AND 5.0) AS g"

#: Rows drawn of those below, before what each of them alone is joined to: a row of TRAP, RACE or FUEL, or none.
TYRE_DRAW = drawn(f"(SELECT {', '.join(TYRE_FACTS)} FROM {TYRE} WHERE avg_deg_per_lap IS NOT NULL AND max_viable_laps IS NOT NULL) AS t", DRAW.format(keys="CAST(season AS STRING), circuit, compound"), 200)
DRIVER_DRAW = drawn(f"(SELECT driver, circuit, season, {D1}, {D2}, {D3} FROM {SECTOR} WHERE {D1} IS NOT NULL) AS d", DRAW.format(keys="CAST(season AS STRING), circuit, driver"), 200)
PAIR_DRAW = drawn(_pairs(SECTOR, "a.season = b.season AND a.driver < b.driver", f"a.season, a.driver AS d1, b.driver AS d2, {', '.join(f'{t}.{c} AS {t}{i}' for t in 'ab' for i, c in enumerate((D1, D2, D3), 1))}", f"a.{D1} IS NOT NULL AND b.{D1} IS NOT NULL"), DRAW.format(keys="CAST(season AS STRING), circuit, d1, d2"), 200)
MOMENT_DRAW = drawn(f"(SELECT l.driver, l.lap_number, l.tyre_age, l.compound, l.lap_time, l.sector1, l.sector2, l.sector3, s.circuit, s.season, t.avg_deg_per_lap, t.cliff_lap, t.max_viable_laps FROM laps AS l JOIN sessions AS s ON s.id = l.session_id JOIN {TYRE} AS t ON t.circuit = s.circuit AND t.season = s.season AND t.compound = l.compound WHERE s.session_type = 'Race' AND l.is_valid = 1 AND l.tyre_age BETWEEN 8 AND 25 AND l.lap_number BETWEEN 20 AND 50 AND l.lap_time IS NOT NULL AND l.compound IS NOT NULL AND t.avg_deg_per_lap IS NOT NULL) AS m", DRAW.format(keys="'moment', " + LAP_KEYS), 600)

TEMPLATES: dict[str, Template] = {
    "t01_tyre_deg_rate": Template(f"{TYRE} WHERE avg_deg_per_lap > 0 AND max_viable_laps IS NOT NULL", TYRE_FACTS, "How do {compound:cap} tyres degrade at {circuit} in {season}?", AT + "{compound:cap} tyres lost {avg_deg_per_lap:.3} s per lap and lasted about {max_viable_laps} laps."),
    "t02_tyre_cliff": Template(f"{TYRE} WHERE cliff_lap IS NOT NULL", ("circuit", "season", "compound", "cliff_lap", "max_viable_laps"), "When do {compound:cap} tyres hit the cliff at {circuit} in {season}?", "{compound:cap} tyres fall off near lap {cliff_lap}; stints over {max_viable_laps} laps rarely paid."),
    "t03_compound_compare": Template(_pairs(TYRE, "a.season = b.season AND a.compound < b.compound", "a.season, a.compound AS c1, a.avg_deg_per_lap AS d1, a.max_viable_laps AS m1, b.compound AS c2, b.avg_deg_per_lap AS d2, b.max_viable_laps AS m2", "a.avg_deg_per_lap IS NOT NULL AND b.avg_deg_per_lap IS NOT NULL"), ("circuit", "season", "c1", "d1", "m1", "c2", "d2", "m2", "CASE WHEN d1 < d2 THEN c1 ELSE c2 END AS durable"), "How do {c1:cap} and {c2:cap} tyres compare at {circuit} in {season}?", "{c1:cap}: {d1:.3} s/lap, {m1} laps. {c2:cap}: {d2:.3} s/lap, {m2} laps. {durable:cap} lasts longer."),
    "t04_best_long_stint": Template(first(TYRE, "circuit, season", "avg_deg_per_lap, compound", "avg_deg_per_lap IS NOT NULL AND max_viable_laps IS NOT NULL"), TYRE_FACTS, "What compound works best for a long stint at {circuit} in {season}?", "{compound:cap}, at {avg_deg_per_lap:.3} s/lap for up to {max_viable_laps} laps."),
    "t05_temp_sensitivity": Template(f"{TYRE} WHERE abs(track_temp_sensitivity) > 0.005", ("circuit", "season", "compound", "track_temp_sensitivity", "avg_deg_per_lap", "CASE WHEN track_temp_sensitivity > 0 THEN 'worse' ELSE 'better' END AS direction"), "How does track temperature affect {compound:cap} tyre performance at {circuit} in {season}?", "By {track_temp_sensitivity:.4} s per degree: heat makes it {direction}, on top of {avg_deg_per_lap:.3} s/lap."),
    "t06_driver_sector_strengths": Template(f"{SECTOR} WHERE {SECTORS_KNOWN}", ("driver", "circuit", "season", D1, D2, D3, f"{BEST} AS best", f"{WORST} AS worst"), "Where does {driver:name} gain or lose time at {circuit} in {season}?", DELTAS + " to the fastest qualifying lap; best in sector {best}, weakest in sector {worst}."),
    "t07_driver_sector_vs_field": Template(f"{SECTOR} WHERE {SECTORS_KNOWN} AND (abs({D1}) > 0.05 OR abs({D2}) > 0.05 OR abs({D3}) > 0.05)", ("driver", "circuit", "season", D1, D2, D3, f"concat_ws(' and ', {', '.join(f'CASE WHEN {c} > 0.05 THEN ' + chr(39) + f'Sector {i}' + chr(39) + ' END' for i, c in enumerate((D1, D2, D3), 1))}) AS lost", f"concat_ws(' and ', {', '.join(f'CASE WHEN {c} < -0.05 THEN ' + chr(39) + f'Sector {i}' + chr(39) + ' END' for i, c in enumerate((D1, D2, D3), 1))}) AS gained"), "What are {driver:name}'s sector time weaknesses at {circuit} in {season}?", "Lost: {lost}. Gained: {gained}. " + DELTAS + "."),
    "t08_speed_trap_leader": Template(f"{TRAP} WHERE rank_in_field = 1", ("circuit", "season", "driver", "avg_top_speed"), "Who had the best straight-line speed at {circuit} in {season}?", "{driver:name}, at {avg_top_speed:.1} km/h on average."),
    "t09_driver_speed_rank": Template(f"{TRAP} WHERE rank_in_field <= 3", ("driver", "circuit", "season", "avg_top_speed", "rank_in_field", "CASE rank_in_field WHEN 1 THEN 'fastest' WHEN 2 THEN 'second fastest' ELSE 'third fastest' END AS place"), "How fast is {driver:name} through the speed trap at {circuit} in {season}?", "The {place}, at {avg_top_speed:.1} km/h."),
    "t10_corner_min_speed": Template(f"(SELECT cs.driver, cs.circuit, cs.corner_number, cs.avg_min_speed, cs.delta_vs_field, coalesce(c.corner_type, 'unknown') AS corner_type FROM {CORNER} AS cs LEFT JOIN {TYPED} AS c ON c.circuit = cs.circuit AND c.corner_number = cs.corner_number WHERE cs.avg_min_speed IS NOT NULL) AS t", ("driver", "circuit", "corner_number", "avg_min_speed", "delta_vs_field", "corner_type"), "How does {driver:name} handle Turn {corner_number} at {circuit}?", "At {avg_min_speed:.1} km/h through a {corner_type}-speed corner, {delta_vs_field:+.1} km/h to the field's mean."),
    "t11_high_speed_corners": Template(_typed_means("high"), ("driver", "circuit", "speed", "avg_delta", "n_corners"), "How does {driver:name} handle high-speed corners at {circuit}?", "Over {n_corners} corners {speed:.1} km/h, {avg_delta:+.1} km/h to the field."),
    "t12_slow_speed_corners": Template(_typed_means("slow"), ("driver", "circuit", "speed", "avg_delta", "n_corners"), "How does {driver:name} perform in slow-speed corners at {circuit}?", "Over {n_corners} corners {speed:.1} km/h, {avg_delta:+.1} km/h to the field."),
    "t13_circuit_corner_types": Template(PIVOT, PIVOT_FACTS, "What kind of corners make {circuit} challenging?", "{total} corners: {n_slow} slow, {n_med} medium, {n_high} high-speed; mostly {dominant}."),
    "t14_fuel_effect_circuit": Template(f"(SELECT circuit, season, round(avg(fuel_effect_per_10kg), 9) AS effect, count(*) AS n_drivers FROM {FUEL} WHERE fuel_effect_per_10kg IS NOT NULL GROUP BY circuit, season HAVING count(*) >= 3) AS t", ("circuit", "season", "effect", "n_drivers"), "How much does fuel load affect lap time at {circuit} in {season}?", "10 kg cost {effect:.3} s per lap, over {n_drivers} drivers."),
    "t15_driver_fuel_sensitivity": Template(f"{FUEL} WHERE fuel_effect_per_10kg IS NOT NULL", ("driver", "circuit", "season", "fuel_effect_per_10kg", "CASE WHEN fuel_effect_per_10kg > 0.25 THEN 'large' ELSE 'modest' END AS size"), "How fuel-sensitive is {driver:name}'s car at {circuit} in {season}?", "{fuel_effect_per_10kg:.3} s per lap for 10 kg, a {size} penalty."),
    "t16_quali_race_converts": Template(f"{RACE} WHERE delta IS NOT NULL AND quali_lap IS NOT NULL AND avg_race_pace IS NOT NULL", ("driver", "circuit", "season", "quali_lap", "avg_race_pace", "delta"), "Does {driver:name} convert qualifying pace to race pace at {circuit} in {season}?", "Qualifying {quali_lap:lap}, race {avg_race_pace:lap}: {delta:+.3}s."),
    "t17_best_quali_at_circuit": Template(first(RACE, "circuit, season", "quali_lap, driver", "quali_lap IS NOT NULL"), ("circuit", "season", "driver", "quali_lap"), "Who set the best qualifying lap at {circuit} in {season}?", "{driver:name}, with {quali_lap:lap}."),
    "t18_best_race_pace": Template(first(RACE, "circuit, season", "avg_race_pace, driver", "avg_race_pace IS NOT NULL"), ("circuit", "season", "driver", "avg_race_pace"), "Who had the best race pace at {circuit} in {season}?", "{driver:name}, with {avg_race_pace:lap} per lap."),
    "t19_large_quali_race_gap": Template(f"{RACE} WHERE delta > 5.0 AND quali_lap IS NOT NULL AND avg_race_pace IS NOT NULL", ("driver", "circuit", "season", "quali_lap", "avg_race_pace", "delta"), "Why is {driver:name}'s race pace so different from qualifying at {circuit} in {season}?", "Qualifying {quali_lap:lap}, race {avg_race_pace:lap}, a gap of {delta:.3} s: set up for one lap."),
    "t20_sector1_specialist": Template(first(SECTOR, "circuit, season", f"{D1}, driver", f"{D1} IS NOT NULL"), ("circuit", "season", "driver", D1), "Who is the strongest driver in Sector 1 at {circuit} in {season}?", "{driver:name}, at {avg_sector1_delta:+.3}s to the fastest lap."),
    "t21_sector3_specialist": Template(first(SECTOR, "circuit, season", f"{D3}, driver", f"{D3} IS NOT NULL"), ("circuit", "season", "driver", D3), "Who dominates Sector 3 at {circuit} in {season}?", "{driver:name}, at {avg_sector3_delta:+.3}s to the fastest lap."),
    "t22_speed_trap_range": Template(f"(SELECT circuit, season, max(avg_top_speed) AS fastest, min(avg_top_speed) AS slowest, count(DISTINCT driver) AS n_drivers FROM {TRAP} GROUP BY circuit, season HAVING count(DISTINCT driver) >= 5) AS t", ("circuit", "season", "fastest", "slowest", "n_drivers", "fastest - slowest AS spread"), "What is the speed trap range at {circuit} in {season}?", "{slowest:.1} to {fastest:.1} km/h over {n_drivers} drivers, a spread of {spread:.1}."),
    "t23_tyre_deg_season_delta": Template(_pairs(TYRE, "a.compound = b.compound AND a.season < b.season", "a.compound, a.season AS s1, a.avg_deg_per_lap AS d1, b.season AS s2, b.avg_deg_per_lap AS d2", "a.avg_deg_per_lap IS NOT NULL AND b.avg_deg_per_lap IS NOT NULL"), ("circuit", "compound", "s1", "d1", "s2", "d2", "abs(d2 - d1) AS change", "CASE WHEN d2 < d1 THEN s2 ELSE s1 END AS kinder"), "How did {compound:cap} tyre degradation at {circuit} change from {s1} to {s2}?", "From {d1:.3} to {d2:.3} s/lap, by {change:.3}; {kinder} was kinder."),
    "t24_driver_corner_profile": Template(f"(SELECT driver, circuit, min(delta_vs_field) AS min_delta, max(delta_vs_field) AS max_delta, count(DISTINCT corner_number) AS n_corners, max(CASE WHEN lo = 1 THEN corner_number END) AS min_corner, max(CASE WHEN hi = 1 THEN corner_number END) AS max_corner FROM (SELECT *, row_number() OVER (PARTITION BY driver, circuit ORDER BY round(delta_vs_field, 6), corner_number) AS lo, row_number() OVER (PARTITION BY driver, circuit ORDER BY round(delta_vs_field, 6) DESC, corner_number) AS hi FROM {CORNER}) AS r GROUP BY driver, circuit HAVING count(DISTINCT corner_number) >= 4) AS t", ("driver", "circuit", "min_delta", "max_delta", "n_corners", "min_corner", "max_corner"), "Which corners are {driver:name}'s strongest and weakest at {circuit}?", "Over {n_corners} corners from {min_delta:+.1} km/h at Turn {min_corner} to {max_delta:+.1} km/h at Turn {max_corner}; positive is faster."),
    "t25_best_race_converters": Template(first(RACE, "circuit, season", "delta, driver", "delta > 0"), ("circuit", "season", "driver", "delta", "quali_lap", "avg_race_pace"), "Which driver best converts qualifying pace to race pace at {circuit} in {season}?", "{driver:name}: {delta:.3} s between {quali_lap:lap} and {avg_race_pace:lap}."),
    "t26_compound_viability": Template(first(TYRE, "circuit, season", "max_viable_laps DESC, compound", "max_viable_laps IS NOT NULL AND avg_deg_per_lap IS NOT NULL"), TYRE_FACTS, "What is the maximum viable stint length at {circuit} in {season}?", "{max_viable_laps} laps on {compound:cap}, at {avg_deg_per_lap:.3} s/lap."),
    "t27_field_corner_speed_by_type": Template(f"(SELECT cs.circuit, c.corner_type, round(avg(cs.avg_min_speed), 9) AS field_avg, count(DISTINCT cs.corner_number) AS n_corners FROM {WHERE_TYPED} WHERE c.corner_type IS NOT NULL GROUP BY cs.circuit, c.corner_type HAVING count(DISTINCT cs.corner_number) >= 2) AS t", ("circuit", "corner_type", "field_avg", "n_corners"), "What is the typical minimum speed through {corner_type}-speed corners at {circuit}?", "{field_avg:.1} km/h over {n_corners} corners."),
    "t28_speed_trap_top5": Template(f"(SELECT circuit, season, count(*) AS n, {', '.join(f'max(CASE WHEN rank_in_field = {i} THEN driver END) AS d{i}, max(CASE WHEN rank_in_field = {i} THEN avg_top_speed END) AS v{i}' for i in range(1, 6))} FROM {TRAP} WHERE rank_in_field <= 5 GROUP BY circuit, season HAVING count(*) >= 3) AS t", ("circuit", "season", "n", *(f"{x}{i}" for i in range(1, 6) for x in "dv")), "Who are the top straight-line speed performers at {circuit} in {season}?", "{n} drivers, led by {d1:name} ({v1:.1} km/h), {d2:name} ({v2:.1}) and {d3:name} ({v3:.1})."),
    "t29_quali_summary": Template(first(SECTOR, "circuit, season", f"round({D1} + {D2} + {D3}, 9), driver", SECTORS_KNOWN), ("circuit", "season", "driver", D1, D2, D3, f"{D1} + {D2} + {D3} AS total"), "Who had the most complete qualifying performance at {circuit} in {season}?", "{driver:name}: " + DELTAS + ", together {total:+.3}s."),
    "t30_tyre_deg_vs_speed": Template(f"(SELECT ts.circuit, ts.season, ts.compound, ts.avg_deg_per_lap, ts.max_viable_laps, sts.avg_top_speed FROM {TYRE} AS ts JOIN (SELECT * FROM {TRAP} WHERE rank_in_field = 1) AS sts ON sts.circuit = ts.circuit AND sts.season = ts.season WHERE ts.avg_deg_per_lap IS NOT NULL AND sts.avg_top_speed IS NOT NULL) AS t", ("circuit", "season", "compound", "avg_deg_per_lap", "max_viable_laps", "avg_top_speed"), "What is the strategic picture for {compound:cap} tyres at {circuit} in {season}?", "{avg_deg_per_lap:.3} s/lap for {max_viable_laps} laps, with {avg_top_speed:.1} km/h on the straight."),
    "e01_pit_window_open": _strategy("", "When should we start watching the pit window for {compound:cap} tyres at {circuit} in {season}?", "From tyre age {open_lap}.", "greatest(1, cliff_lap - 3) AS open_lap"),
    "e02_extend_or_box": _strategy("", "{compound:cap} tyres are {age} laps old at {circuit} in {season}. Do we extend or box?", "I would {decision}.", "greatest(8, cliff_lap - 2) AS age", "CASE WHEN greatest(8, cliff_lap - 2) >= max_viable_laps - 2 THEN 'box soon' ELSE 'extend' END AS decision"),
    "e03_low_deg_stretch": _strategy(" AND avg_deg_per_lap <= 0.040", "Can we stretch the {compound:cap} stint at {circuit} in {season}?", "Yes, if the last third isn't pushed."),
    "e04_high_deg_protect": _strategy(" AND avg_deg_per_lap >= 0.080", "How should the driver manage {compound:cap} tyres at {circuit} in {season}?", "Protect them from the start."),
    "e05_best_compound_for_offset": Template(first(TYRE, "circuit, season", "max_viable_laps DESC, avg_deg_per_lap, compound", TYRE_FILTER), TYRE_FACTS, "Which tyre is best for an offset strategy at {circuit} in {season}?", "{compound:cap}: " + TYRE_TAIL),
    "e07_sector_attack_plan": Template(f"{SECTOR} WHERE {SECTORS_KNOWN}", ("driver", "circuit", "season", D1, D2, D3, f"{WORST} AS worst"), "What sector should {driver:name} focus on at {circuit} in {season}?", "Sector {worst}: " + DELTAS + "."),
    "e08_sector_strength_defend": Template(f"{SECTOR} WHERE {SECTORS_KNOWN}", ("driver", "circuit", "season", D1, D2, D3, f"{BEST} AS best"), "Where can {driver:name} defend lap time at {circuit} in {season}?", "In sector {best}: " + DELTAS + "."),
    "e09_head_to_head_sector_edge": Template(SECTOR_PAIR, (*PAIR_FACTS, *(f"CASE WHEN a{i} <= b{i} THEN d1 ELSE d2 END AS w{i}" for i in (1, 2, 3)), *(f"abs(b{i} - a{i}) AS m{i}" for i in (1, 2, 3))), "Compare {d1:name} and {d2:name} by sector at {circuit} in {season}.", "Sector 1: {w1:name} by {m1:.3} s; sector 2: {w2:name} by {m2:.3} s; sector 3: {w3:name} by {m3:.3} s."),
    "e10_top_speed_vs_sector_loss": Template(f"(SELECT d.driver, d.circuit, d.season, {D1}, {D2}, {D3}, s.avg_top_speed, s.rank_in_field FROM {SECTOR} AS d JOIN {TRAP} AS s ON s.driver = d.driver AND s.circuit = d.circuit AND s.season = d.season WHERE s.avg_top_speed BETWEEN 280 AND 370 AND s.rank_in_field <= 5 AND {SECTORS_KNOWN}) AS t", ("driver", "circuit", "season", D1, D2, D3, "avg_top_speed", "rank_in_field", f"{D1} + {D2} + {D3} AS total"), "Is {driver:name}'s top speed translating into lap time at {circuit} in {season}?", "P{rank_in_field} at {avg_top_speed:.1} km/h, but " + DELTAS + ", together {total:+.3}s."),
    "e11_speed_setup_signal": Template(f"(SELECT circuit, season, max(avg_top_speed) AS fastest, min(avg_top_speed) AS slowest, round(avg(avg_top_speed), 9) AS avg_speed, count(*) AS n FROM {TRAP} WHERE avg_top_speed BETWEEN 280 AND 370 GROUP BY circuit, season HAVING count(*) >= 8) AS t", ("circuit", "season", "fastest", "slowest", "avg_speed", "n", "fastest - slowest AS spread"), "What does the speed trap spread say about setup at {circuit} in {season}?", "{slowest:.1} to {fastest:.1} km/h, mean {avg_speed:.1}, over {n} drivers: a spread of {spread:.1}."),
    "e12_corner_attack": Template(f"{CORNER} WHERE avg_min_speed BETWEEN 60 AND 320 AND abs(delta_vs_field) >= 3.0", ("driver", "circuit", "corner_number", "avg_min_speed", "delta_vs_field"), "What should {driver:name} change through Turn {corner_number} at {circuit}?", "{avg_min_speed:.1} km/h is {delta_vs_field:+.1} km/h to the field."),
    "e13_corner_type_setup": Template(f"(SELECT cs.driver, cs.circuit, c.corner_type, round(avg(cs.avg_min_speed), 9) AS avg_speed, round(avg(cs.delta_vs_field), 9) AS avg_delta, count(*) AS n FROM {WHERE_TYPED} WHERE c.corner_type IS NOT NULL AND cs.avg_min_speed BETWEEN 60 AND 320 GROUP BY cs.driver, cs.circuit, c.corner_type HAVING count(*) >= 2) AS t", ("driver", "circuit", "corner_type", "avg_speed", "avg_delta", "n"), "What does {driver:name}'s {corner_type}-corner profile look like at {circuit}?", "{avg_speed:.1} km/h over {n} corners, {avg_delta:+.1} km/h to the field."),
    "e14_corner_consistency": Template(f"(SELECT driver, circuit, min(delta_vs_field) AS min_delta, max(delta_vs_field) AS max_delta, count(*) AS n FROM {CORNER} WHERE avg_min_speed BETWEEN 60 AND 320 GROUP BY driver, circuit HAVING count(*) >= 6) AS t", ("driver", "circuit", "min_delta", "max_delta", "n", "max_delta - min_delta AS spread"), "How consistent is {driver:name} across corners at {circuit}?", "From {min_delta:+.1} to {max_delta:+.1} km/h over {n} corners, a spread of {spread:.1}."),
    "e15_fuel_phase_strategy": Template(f"{FUEL} WHERE fuel_effect_per_10kg IS NOT NULL", ("driver", "circuit", "season", "fuel_effect_per_10kg"), "How should {driver:name} adjust driving as fuel burns off at {circuit} in {season}?", "Each 10 kg burned gives {fuel_effect_per_10kg:.3} s per lap; attack later."),
    "e16_quali_to_race_setup": Template(f"{RACE} WHERE delta BETWEEN 2.0 AND 15.0 AND quali_lap IS NOT NULL AND avg_race_pace IS NOT NULL", ("driver", "circuit", "season", "quali_lap", "avg_race_pace", "delta"), "What does {driver:name}'s quali-to-race delta say at {circuit} in {season}?", "{quali_lap:lap} against {avg_race_pace:lap}: {delta:+.3}s."),
    "e17_race_pace_order": Template(top(RACE, "avg_race_pace", 3, "avg_race_pace IS NOT NULL"), ("circuit", "season", "d1", "v1", "d2", "v2", "d3", "v3"), "Who were the top three race-pace drivers at {circuit} in {season}?", "{d1:name} ({v1:lap}), {d2:name} ({v2:lap}) and {d3:name} ({v3:lap})."),
    "e18_quali_pace_order": Template(top(RACE, "quali_lap", 3, "quali_lap IS NOT NULL"), ("circuit", "season", "d1", "v1", "d2", "v2", "d3", "v3"), "Who were the top three qualifying benchmarks at {circuit} in {season}?", "{d1:name} ({v1:lap}), {d2:name} ({v2:lap}) and {d3:name} ({v3:lap})."),
    "e19_strategy_snapshot": Template(f"(SELECT ts.circuit, ts.season, ts.compound, ts.avg_deg_per_lap, ts.cliff_lap, ts.max_viable_laps, sp.fastest_speed FROM {TYRE} AS ts LEFT JOIN (SELECT circuit, season, max(avg_top_speed) AS fastest_speed FROM {TRAP} WHERE avg_top_speed BETWEEN 280 AND 370 GROUP BY circuit, season) AS sp ON sp.circuit = ts.circuit AND sp.season = ts.season WHERE {TYRE_FILTER}) AS t", (*TYRE_FACTS, "fastest_speed"), "Give me a race-engineer strategy snapshot for {circuit} {season} on {compound:cap}.", "{compound:cap}: " + TYRE_TAIL),
    "e20_lap_query_from_real_laps": Template(LAP_JOIN.format(low=6, high=30), LAP_FACTS, "{driver:name} is on lap {lap_number} at {circuit} in {season}, {compound:cap} tyres age {tyre_age}. What is the tyre risk?", "{margin} laps to the cliff: " + TYRE_TAIL, DRAW.format(keys=LAP_KEYS), 500),
    "e21_clean_air_priority": _strategy(" AND avg_deg_per_lap >= 0.050", "How important is clean air for {compound:cap} tyre management at {circuit} in {season}?", "Very: dirty air heats them."),
    "e22_push_lap_timing": _strategy("", "When is the latest safe push lap on {compound:cap} tyres at {circuit} in {season}?", "At tyre age {push_age}.", "greatest(1, cliff_lap - 1) AS push_age"),
    "e23_undercut_pressure": _strategy(" AND avg_deg_per_lap >= 0.035", "Is the undercut threat strong on {compound:cap} tyres at {circuit} in {season}?", "Yes, fresh tyres pay at once."),
    "e24_overcut_case": _strategy(" AND avg_deg_per_lap <= 0.035", "Can the overcut work on {compound:cap} tyres at {circuit} in {season}?", "Yes, with clean air."),
    "k1_tyre_corrections": _strategy("", "The {compound:cap} at {circuit} in {season} is basically unusable after {wrong_max} laps, right?", "No.", "greatest(3, max_viable_laps - 6) AS wrong_max"),
    "k2_corner_type_corrections": Template(PIVOT, (*PIVOT_FACTS, f"CASE WHEN {DOMINANT} = 'slow' THEN 'high-speed' ELSE 'slow-speed' END AS wrong"), "{circuit} is mainly a {wrong} circuit, isn't it?", "No, mostly {dominant}-speed: {n_slow} slow, {n_med} medium, {n_high} high of {total}."),
    "k3_driver_comparison_corrections": Template(SECTOR_PAIR, (*PAIR_FACTS, "a1 + a2 + a3 AS total1", "b1 + b2 + b3 AS total2", "CASE WHEN a1 + a2 + a3 <= b1 + b2 + b3 THEN d1 ELSE d2 END AS stronger", "CASE WHEN a1 + a2 + a3 <= b1 + b2 + b3 THEN d2 ELSE d1 END AS weaker"), "{weaker:name} clearly had the edge over {stronger:name} at {circuit} in {season}, right?", "No, {stronger:name} did: {d1:name} {total1:+.3}s, {d2:name} {total2:+.3}s to the fastest lap.", "season, circuit, d1, d2", 200),
    "b1_strategy_examples": Template(LAP_JOIN.format(low=8, high=28), LAP_FACTS, "{driver:name} is on lap {lap_number} at {circuit} in {season} on {compound:cap} tyres aged {tyre_age} laps. What matters most for the strategy call?", "{margin} laps to the cliff: " + TYRE_TAIL, DRAW.format(keys="'boost', " + LAP_KEYS), 600),
    "b2_corner_type_examples": Template(PIVOT, PIVOT_FACTS, "What setup story does the corner mix tell us for {circuit}?", "{n_slow} slow, {n_med} medium and {n_high} high-speed corners of {total}: set up for the {dominant} ones first."),
    "b3_sparse_comparison_examples": Template(f"(SELECT p.*, x.quali_lap AS q1, x.avg_race_pace AS r1, y.quali_lap AS q2, y.avg_race_pace AS r2 FROM {SECTOR_PAIR.replace(' AS pairs', ' AS p')} JOIN {RACE} AS x ON x.driver = p.d1 AND x.circuit = p.circuit AND x.season = p.season JOIN {RACE} AS y ON y.driver = p.d2 AND y.circuit = p.circuit AND y.season = p.season WHERE x.quali_lap IS NOT NULL AND y.quali_lap IS NOT NULL AND x.avg_race_pace IS NOT NULL AND y.avg_race_pace IS NOT NULL) AS t", (*PAIR_FACTS, "q1", "q2", "r1", "r2"), "Give me a compact comparison of {d1:name} vs {d2:name} at {circuit} in {season}.", "{d1:name}: sectors {a1:+.3}s, {a2:+.3}s, {a3:+.3}s, qualifying {q1:lap}, race {r1:lap}. {d2:name}: sectors {b1:+.3}s, {b2:+.3}s, {b3:+.3}s, qualifying {q2:lap}, race {r2:lap}.", "season, circuit, d1, d2", 400),
    "m2a_tyre_behaviour": Template(f"{TYRE} WHERE avg_deg_per_lap IS NOT NULL AND max_viable_laps IS NOT NULL", (*TYRE_FACTS, "track_temp_sensitivity"), "How do {compound:cap} tyres behave at {circuit} in {season}? Include degradation profile, stint strategy, and any temperature sensitivity.", TYRE_TAIL, DRAW.format(keys="CAST(season AS STRING), circuit, compound"), 200),
    "m2b_undercut_strategy": Template(f"(SELECT drawn.*, f.fuel, q.pace FROM {TYRE_DRAW} LEFT JOIN (SELECT circuit, season, min_by(fuel_effect_per_10kg, driver) AS fuel FROM {FUEL} GROUP BY circuit, season) AS f ON f.circuit = drawn.circuit AND f.season = drawn.season LEFT JOIN (SELECT circuit, season, min_by(avg_race_pace, driver) AS pace FROM {RACE} GROUP BY circuit, season) AS q ON q.circuit = drawn.circuit AND q.season = drawn.season) AS m", (*TYRE_FACTS, "fuel", "pace"), "What is the undercut and overcut opportunity at {circuit} in {season} on {compound:cap} tyres? When should a team trigger the undercut?", TYRE_TAIL),
    "m2c_driver_characteristics": Template(f"(SELECT drawn.*, s.avg_top_speed, s.rank_in_field, q.quali_lap, q.avg_race_pace, q.delta FROM {DRIVER_DRAW} LEFT JOIN {TRAP} AS s ON s.driver = drawn.driver AND s.circuit = drawn.circuit AND s.season = drawn.season LEFT JOIN {RACE} AS q ON q.driver = drawn.driver AND q.circuit = drawn.circuit AND q.season = drawn.season) AS t", ("driver", "circuit", "season", D1, D2, D3, "avg_top_speed", "rank_in_field", "quali_lap", "avg_race_pace", "delta"), "Describe {driver:name}'s driving characteristics and strengths at {circuit} in {season}. Where does he gain and lose time?", DELTAS + "."),
    "m2e_driver_comparison": Template(f"(SELECT drawn.*, x.avg_top_speed AS v1, x.rank_in_field AS r1, y.avg_top_speed AS v2, y.rank_in_field AS r2 FROM {PAIR_DRAW} LEFT JOIN {TRAP} AS x ON x.driver = drawn.d1 AND x.circuit = drawn.circuit AND x.season = drawn.season LEFT JOIN {TRAP} AS y ON y.driver = drawn.d2 AND y.circuit = drawn.circuit AND y.season = drawn.season) AS t", (*PAIR_FACTS, "v1", "r1", "v2", "r2"), "How do {d1:pair} and {d2:pair} compare at {circuit} in {season}? Who has the edge in each sector and who is stronger overall?", "Sector 1 {a1:+.3}s and {b1:+.3}s."),
    "m3_race_moments": Template(f"(SELECT drawn.*, f.fuel_effect_per_10kg, q.avg_race_pace FROM {MOMENT_DRAW} LEFT JOIN {FUEL} AS f ON f.driver = drawn.driver AND f.circuit = drawn.circuit AND f.season = drawn.season LEFT JOIN {RACE} AS q ON q.driver = drawn.driver AND q.circuit = drawn.circuit AND q.season = drawn.season) AS m", (*LAP_FACTS[:-1], *(f"round({c}, 9) AS {c}" for c in ("lap_time", "sector1", "sector2", "sector3")), "fuel_effect_per_10kg", "avg_race_pace"), "{driver} on lap {lap_number} at {circuit} in {season}: what now?", "{compound:cap} of age {tyre_age}: " + TYRE_TAIL),
    "stay_out": Template(BEHIND, ("season", "circuit", "driver", "lap_number", "tyre_age", "compound", "avg_deg_per_lap", "cliff_lap", "max_viable_laps", "gap", "cliff_lap - tyre_age AS margin"), "{driver:surname} is on lap {lap_number} at {circuit} in {season}. Tyres are {tyre_age} laps old on the {compound:cap} compound, deg rate is {avg_deg_per_lap:.3} s/lap, cliff is at lap {cliff_lap}. Gap behind is {gap:.1} seconds. Recommend stay out with reasoning based on margin to cliff and traffic cost of pitting.", "Stay out: {margin} laps to the cliff, and a stop at a gap of {gap:.1} s costs the place to traffic. " + TYRE_TAIL),
}

#: Where the engines spell a concatenating aggregate differently.
CONCAT = {
    "e06_compound_risk_rank": (
        f"SELECT circuit, season, {{concat}} AS summary, count(*) AS n FROM {TYRE} WHERE {TYRE_FILTER} GROUP BY circuit, season HAVING count(*) >= 2",
        "concat_ws(':', compound, CAST(CAST(round(avg_deg_per_lap, 3) AS DECIMAL(9, 3)) AS STRING), CAST(max_viable_laps AS STRING))",
        ("circuit", "season", "summary", "n"),
        "How do the tyre options rank for stint risk at {circuit} in {season}?",
        "compound:deg:max_laps = {summary}.",
    ),
    "m2d_circuit_strategy": (
        f"SELECT t.*, f.fuel, q.pace FROM (SELECT circuit, season, {{concat}} AS summary, min(avg_deg_per_lap) AS deg FROM {TYRE} WHERE avg_deg_per_lap IS NOT NULL GROUP BY circuit, season) AS t LEFT JOIN (SELECT circuit, season, round(avg(fuel_effect_per_10kg), 9) AS fuel FROM {FUEL} GROUP BY circuit, season) AS f ON f.circuit = t.circuit AND f.season = t.season LEFT JOIN (SELECT circuit, season, min(avg_race_pace) AS pace FROM {RACE} GROUP BY circuit, season) AS q ON q.circuit = t.circuit AND q.season = t.season ORDER BY {DRAW.format(keys='CAST(t.season AS STRING), t.circuit')} LIMIT 200",
        "concat_ws(':', compound, CAST(CAST(round(avg_deg_per_lap, 4) AS DECIMAL(9, 4)) AS STRING), coalesce(CAST(max_viable_laps AS STRING), 'N/A'))",
        ("circuit", "season", "summary", "deg", "fuel", "pace"),
        "What does an optimal race strategy look like at {circuit} in {season}? Consider compound choices, stint lengths, and fuel effect.",
        "{summary}; least degradation {deg:.4} s/lap.",
    ),
}


def _concat_sql(name: str, dialect: str) -> str:
    inner, item, facts, question, answer = CONCAT[name]
    joined = f"listagg({item}, ' | ') WITHIN GROUP (ORDER BY {item})" if dialect == "spark" else f"string_agg({item}, ' | ' ORDER BY {item})"
    return f"SELECT {', '.join(facts)}, {render(question)} AS question, {render(answer)} AS answer FROM ({inner.format(concat=joined)}) AS facts"


SPARK_SQL = {name: t.sql() for name, t in TEMPLATES.items()} | {name: _concat_sql(name, "spark") for name in CONCAT}


def checked(name: str) -> str:
    """The facts that templates_sql finds, with its question, if it words that apart, and the template's texts."""
    question, answer = CONCAT[name][3:] if name in CONCAT else (TEMPLATES[name].question, TEMPLATES[name].answer)
    asked = QUESTIONS.get(name) or render(question)
    return f"SELECT *, {asked} AS question, {render(answer)} AS answer FROM ({FACTS[name]}) AS facts"


ORACLE_SQL = {name: with_stats(checked(name)) for name in SPARK_SQL}
_TABLES = (TYRE, SECTOR, TRAP, CORNER, FUEL, RACE, TYPED, "laps", "sessions")


def template(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Facts, question and answer of every row that the template yields."""
    sql = SPARK_SQL[name]
    return run_sql(spark, sql, tables(spark, sf_dir, *(s for s in _TABLES if re.search(rf"\b{s}\b", sql))))


def _query(name: str):
    return lambda spark, sf_dir: template(spark, sf_dir, name)


QUERIES = {name: _query(name) for name in SPARK_SQL}
