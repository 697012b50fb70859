"""Registered queries of questions in bulk: what each message of a table fetches, and how it is answered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import routing
from ..sources.fixtures import run_sql
from .laps import _FULL
from .stats import tables
from .stats_sql import with_stats
from .texts import _AVERAGE, _CIRCUIT, _DOUBT, _LAP, _MODE, _SESSION, _YEAR, ORACLE_SQL as TEXT_SQL, MESSAGES, _has, _orders, _q

#: Circuits as sessions store them, in the place of the fixtures' own.
PLACES = "Italian,Belgian,British,Japanese,Bahrain,Dutch,Austrian,Las Vegas"
_PLACE = f"CASE WHEN circuit IN ('Monaco', 'Singapore') THEN circuit ELSE split_part('{PLACES}', ',', CAST((length(circuit) * 3 + TRY_CAST(right(circuit, 1) AS INT)) % 8 AS INT) + 1) END"

#: Laps of which some miss sectors, some are not valid, and some of a qualifying are equal or nearly so.
NAMED_LAPS = f"""
SELECT id, session_id, driver, lap_number, CASE WHEN session_id LIKE '%Q' AND driver IN ('NOR', 'SAI') AND lap_number < 9 THEN CAST(70 + lap_number AS DOUBLE) WHEN session_id LIKE '%Q' AND driver IN ('VER', 'HAM') AND lap_number = 5 AND length(session_id) % 2 = 0 THEN CASE WHEN driver = 'VER' THEN 70e0 ELSE 70.03e0 END
    WHEN driver = 'ALO' AND lap_number = 11 THEN 150e0 ELSE lap_time END AS lap_time,
  sector1, CASE WHEN lap_number % 23 = 7 THEN NULL ELSE sector2 END AS sector2, sector3, CASE WHEN lap_number % 19 = 4 THEN 0 ELSE is_valid END AS is_valid
FROM laps"""
NAMED_SESSIONS = f"SELECT id, season, {_PLACE} AS circuit, session_type FROM sessions"

#: Questions of twelve wordings, some of them follow-ups that leave things out.
QUESTIONS = """
SELECT o_orderkey AS id, concat('s', CAST(o_custkey % 97 AS STRING)) AS sid, CASE o_orderkey % 12
  WHEN 0 THEN concat('Compare VER vs HAM at ', c, ' in ', y, ' qualifying') WHEN 1 THEN concat('Show me the fastest lap of Leclerc in the race at ', c, ' ', y)
  WHEN 2 THEN concat('Compare the average race pace of Norris vs Sainz in the race at ', c) WHEN 3 THEN concat('lap ', n, ' of the race at ', c, ', ', y, '?')
  WHEN 4 THEN 'You are wrong, check again' WHEN 5 THEN concat('And lap ', n, '?') WHEN 6 THEN concat('compare NOR vs SAI in quali at ', c, ' ', y)
  WHEN 7 THEN concat('Telemetry of FP2 at ', c, ' in ', y) WHEN 8 THEN 'Does rain change the braking at this corner?'
  WHEN 9 THEN concat('Compare VER vs BOT vs ANT on lap ', n) WHEN 10 THEN concat('fastest lap of Antonelli vs Gasly at ', c, '?')
  ELSE concat('sector 2 of Alonso, lap ', n, ', race at ', c, ' ', y) END AS text
FROM (SELECT *, CAST(2021 + o_custkey % 6 AS STRING) AS y, CAST(1 + o_custkey % 75 AS STRING) AS n,
  split_part('Monza,Spa,Silverstone,Suzuka,Bahrain,Zandvoort,Las Vegas,Monaco,Singapore,Imola', ',', CAST((o_custkey + o_orderkey) % 10 AS INT) + 1) AS c FROM orders) AS o"""


def bulk_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question with its mode, source, branch, session, rejection and rows as text, one part for each driver."""
    t = tables(spark, sf_dir, "laps", "sessions")
    asked = _orders(spark, sf_dir, QUESTIONS)
    told = routing.answered(asked, run_sql(spark, NAMED_LAPS, t), run_sql(spark, NAMED_SESSIONS, t))
    number = lambda x: F.coalesce(F.round(x, 6).cast("decimal(12,6)").cast("string"), F.lit("-"))
    row = lambda r: F.concat_ws(" ", r["driver"], F.coalesce(r["lap_number"].cast("string"), F.lit("-")), *(number(r[c]) for c in routing.ROW[2:]))
    return told.select("id", "sid", "mode", "source", "branch", "session_id", "rejection", F.size("rows").cast("long").alias("n_rows"), F.array_join(F.transform("rows", row), ";").alias("rows"))


#: Seasons that can be brought in.
SEASONS = [2020, 2021, 2022, 2023, 2024, 2025]


def missing_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that the questions ask for and that are not stored."""
    sessions = run_sql(spark, NAMED_SESSIONS, tables(spark, sf_dir, "sessions"))
    return routing.missing_sessions(_orders(spark, sf_dir, QUESTIONS), sessions, SEASONS)


QUERIES = {"bulk_answers": bulk_answers, "missing_sessions": missing_sessions}

_FIELDS = ("circuit", "year", "session", "lap", "d")


def _bulk_sql() -> str:
    """The same, one step after the other, over tables of laps instead of arrays."""
    drivers = TEXT_SQL["intent_drivers"].replace(MESSAGES, QUESTIONS)
    stored = f"coalesce(map_extract(MAP {{{', '.join(f'{_q(a)}: {_q(b)}' for a, b in K.STORED_NAMES.items())}}}, c.circuit)[1], c.circuit)"
    num = lambda c: f"coalesce(CAST(CAST(round({c}, 6) AS DECIMAL(12, 6)) AS VARCHAR), '-')"
    text = " || ' ' || ".join(["driver", "coalesce(CAST(lap_number AS VARCHAR), '-')", *(num(c) for c in ("lap_time", "sector1", "sector2", "sector3", "d1", "d2", "d3"))])
    times, full = "lap_time, sector1, sector2, sector3", f"{_FULL} AND lap_time > 0"
    return with_stats(
        f""", nl AS MATERIALIZED ({NAMED_LAPS}), ns AS MATERIALIZED ({NAMED_SESSIONS}), r AS MATERIALIZED (SELECT nl.*, session_type FROM nl JOIN ns ON ns.id = nl.session_id),
m AS MATERIALIZED ({QUESTIONS}), dd AS ({drivers}),
i AS (SELECT id, sid, {_CIRCUIT} AS circuit, {_YEAR} AS year, {_SESSION} AS session, coalesce(CAST({_LAP} AS VARCHAR), CASE WHEN {_has(K.FASTEST)} THEN 'fastest' END) AS lap, nullif(drivers, '') AS d,
  {_AVERAGE} AS mean, {_DOUBT} AS doubts, {_MODE} = 'telemetry' OR {_DOUBT} AS asks FROM m JOIN dd USING (id)),
k AS (SELECT *, asks AND coalesce(bool_or(asks AND circuit IS NOT NULL) OVER (PARTITION BY sid ORDER BY id ROWS UNBOUNDED PRECEDING), false) AS leaves FROM i),
c AS MATERIALIZED (SELECT id, sid, mean, doubts, asks, {', '.join(f"coalesce({f}, last_value(CASE WHEN leaves THEN {f} END IGNORE NULLS) OVER w) AS {f}" for f in _FIELDS)} FROM k
  WINDOW w AS (PARTITION BY sid ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
q AS MATERIALIZED (SELECT *, asks AND circuit IS NOT NULL AS ready, string_split(coalesce(d, ''), ',') AS ds, CASE WHEN session = 'Q' THEN 'Q' WHEN session LIKE 'FP%' THEN session ELSE 'Race' END AS kind,
  (SELECT arg_min(ns.id, struct_pack(s := -ns.season, i := ns.id)) FROM ns WHERE ns.circuit = {stored} AND ns.session_type = CASE WHEN session = 'Q' THEN 'Q' WHEN session LIKE 'FP%' THEN session ELSE 'Race' END AND (year IS NULL OR ns.season = year) AND asks) AS sess,
  TRY_CAST(lap AS INTEGER) AS n FROM c),
f AS MATERIALIZED (SELECT *, sector1 - first_value(sector1) OVER w AS d1, sector2 - first_value(sector2) OVER w AS d2, sector3 - first_value(sector3) OVER w AS d3 FROM (
    SELECT session_id, driver, lap_number, {times} FROM r WHERE {full} QUALIFY row_number() OVER (PARTITION BY session_id, driver ORDER BY lap_time, lap_number) = 1) WINDOW w AS (PARTITION BY session_id ORDER BY lap_time, driver)),
o AS MATERIALIZED (SELECT *, sector1 - first_value(sector1) OVER w AS d1, sector2 - first_value(sector2) OVER w AS d2, sector3 - first_value(sector3) OVER w AS d3 FROM (
    SELECT session_id, driver, lap_number, {times} FROM r WHERE {_FULL}) WINDOW w AS (PARTITION BY session_id, lap_number ORDER BY lap_time, driver)),
a AS MATERIALIZED (SELECT *, sector1 - avg(sector1) OVER w AS d1, sector2 - avg(sector2) OVER w AS d2, sector3 - avg(sector3) OVER w AS d3 FROM (
    SELECT session_id, driver, CAST(NULL AS INTEGER) AS lap_number, avg(lap_time) AS lap_time, avg(sector1) AS sector1, avg(sector2) AS sector2, avg(sector3) AS sector3 FROM r WHERE {full} GROUP BY ALL) WINDOW w AS (PARTITION BY session_id)),
x AS MATERIALIZED (SELECT q.id, f.* FROM q JOIN f ON f.session_id = sess WHERE ready AND n IS NULL AND NOT mean AND (d IS NULL OR list_contains(ds, f.driver))
  UNION ALL SELECT q.id, o.* FROM q JOIN o ON o.session_id = sess AND o.lap_number = n WHERE ready AND (d IS NULL OR list_contains(ds, o.driver))
  UNION ALL SELECT q.id, a.* FROM q JOIN a ON a.session_id = sess WHERE ready AND n IS NULL AND mean AND (d IS NULL OR list_contains(ds, a.driver))),
y AS (SELECT id, count(*) AS k, max(lap_time) - min(lap_time) AS gap, count(DISTINCT round(lap_time, 3)) AS times, bool_and(round(lap_time, 3) BETWEEN 60 AND 145 AND round(sector1, 3) BETWEEN 10 AND 60 AND round(sector2, 3) BETWEEN 10 AND 60 AND round(sector3, 3) BETWEEN 10 AND 60) AS sound,
  string_agg({text}, ';' ORDER BY lap_time, driver) AS rows FROM x GROUP BY id),
z AS (SELECT q.*, k, rows, CASE WHEN NOT ready THEN NULL WHEN sess IS NULL THEN '{routing.UNAVAILABLE}' WHEN k IS NULL THEN NULL WHEN len(ds) = 2 AND k = 1 THEN '{routing.MISSING}'
  WHEN len(ds) = 2 AND times = 1 THEN '{routing.IDENTICAL}' WHEN len(ds) = 2 AND kind = 'Q' AND NOT mean AND gap < 0.05 THEN '{routing.SUSPECT}' WHEN NOT sound THEN '{routing.IMPLAUSIBLE}' END AS rejection FROM q LEFT JOIN y USING (id))
SELECT id, sid, CASE WHEN asks AND (circuit IS NOT NULL OR doubts) THEN 'telemetry' ELSE 'general' END AS mode,
  CASE WHEN NOT asks OR (circuit IS NULL AND NOT doubts) THEN '{routing.MODEL}' WHEN circuit IS NULL THEN '{routing.NOT_FOUND}' WHEN rejection IS NOT NULL THEN '{routing.NOT_AVAILABLE}' WHEN k IS NULL THEN '{routing.NOT_FOUND}' ELSE '{routing.STORED}' END AS source,
  CASE WHEN NOT ready OR sess IS NULL THEN NULL WHEN n IS NOT NULL THEN 'lap_n' WHEN mean THEN 'avg_lap' ELSE 'fastest_per_driver' END AS branch, CASE WHEN ready THEN sess END AS session_id, rejection,
  CASE WHEN ready AND sess IS NOT NULL AND rejection IS NULL THEN coalesce(k, 0) ELSE 0 END AS n_rows, CASE WHEN ready AND rejection IS NULL THEN coalesce(rows, '') ELSE '' END AS rows FROM z"""
    )


_BULK = _bulk_sql()
_MERGED = _BULK[: _BULK.rindex(",\nf AS MATERIALIZED")]
ORACLE_SQL = {
    "bulk_answers": _BULK,
    "missing_sessions": f"""{_MERGED}
SELECT coalesce(map_extract(MAP {{{', '.join(f'{_q(a)}: {_q(b)}' for a, b in K.STORED_NAMES.items())}}}, circuit)[1], circuit) AS circuit, y AS season, kind AS session_type, CAST(if(year IS NULL, {max(SEASONS)} - y + 1, 1) AS INTEGER) AS place, count(*) AS messages
FROM q, (SELECT unnest(range(2000, 2100))::INTEGER AS y) WHERE ready AND sess IS NULL AND kind IN ('Q', 'Race') AND (y = year OR (year IS NULL AND y BETWEEN {min(SEASONS)} AND {max(SEASONS)})) GROUP BY ALL""",
}
