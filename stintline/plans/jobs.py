"""Registered queries of the jobs: session load, corner maps, the corpus, checks and texts of telemetry, dialogues, the report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import metrics, render
from ..functions import text as X
from ..operators import corpus as C
from ..operators import lap_query, session_load
from ..operators.statistics import tyre_stats
from ..sources.fixtures import run_sql, spread
from ..streaming import state
from . import templates, texts
from .laps import KEPT, RAW_LAPS, TRACE, _laps
from .stats import rounded, tables
from .stats_sql import with_stats

#: Sources of the corpus, in the order in which they win, and the templates of each.
SOURCES = {"templates": "t", "expanded": "e", "corrections": "k", "boost": "b", "generated": "m", "stay_out": "stay_out"}

#: A schedule: the circuits of each season by name; the first one is a test, round 0.
SCHEDULE = "SELECT season, circuit AS EventName, CAST(row_number() OVER (PARTITION BY season ORDER BY circuit) - 1 AS INT) AS RoundNumber FROM (SELECT DISTINCT season, circuit FROM sessions) AS held"

#: Maps that sessions could give, numbered and placed otherwise than the corners that are held.
MAPS = "SELECT s.id AS session_id, corner_number AS Number, CASE WHEN corner_number % 7 = 3 THEN NULL ELSE distance_from_start + s.season END AS Distance FROM sessions AS s JOIN corners AS c ON c.circuit = s.circuit"

#: Blocks of telemetry and claims about it, right and wrong, made from orders.
BLOCKS = """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 23 = 0 THEN 'No valid lap data after filters, cliff lap 99' WHEN o_orderkey % 29 = 0 THEN ' ' ELSE concat('=== TELEMETRY DATA ===', chr(10),
  '(1:59.000 99.000 99.000 99.000)', chr(10), 'VER     ', n, '  ', CAST(1 + o_orderkey % 3 AS STRING), ':', s, '.', m, '   ', CAST(30 + o_orderkey % 40 AS STRING), '.125   28.250   27.500', chr(10),
  'HAM     ', n, '  1:20.500  20.125', chr(10), CASE o_orderkey % 7 WHEN 0 THEN concat('Sector delta of -', CAST(o_orderkey % 4 AS STRING), '.5 s')
    WHEN 1 THEN concat('Top speed was ', CAST(255 + o_orderkey % 140 AS STRING), ' km/h') WHEN 2 THEN concat('Minimum speed of ', CAST(30 + o_orderkey % 320 AS STRING), ' km/h')
    WHEN 3 THEN concat('Degradation 0.', m, ' s/lap, max viable stint ', n, ' laps, cliff lap ', n) WHEN 4 THEN concat('Quali to race ', n, '.5 s') WHEN 5 THEN concat('rank #', n)
    ELSE 'nothing else' END) END AS text
FROM (SELECT *, CAST(1 + o_custkey % 60 AS STRING) AS n, lpad(CAST(10 + o_orderkey % 49 AS STRING), 2, '0') AS s, lpad(CAST(o_custkey % 1000 AS STRING), 3, '0') AS m FROM orders) AS o"""

#: Talk between a driver and an engineer, made from orders.
TALKS = """
SELECT o_orderkey AS id, concat('Scene', chr(10), 'ENG: Box, ', CASE o_orderkey % 3 WHEN 0 THEN 'Hamilton' WHEN 1 THEN 'VER' ELSE 'mate' END, ', lap ', CAST(1 + o_orderkey % 70 AS STRING), CASE WHEN o_orderkey % 2 = 0 THEN ' on Soft' ELSE '' END, chr(10),
  ' DRV: ', CAST(2 + o_orderkey % 30 AS STRING), ' laps old, track temp is fine, the gap grows', chr(10), 'ENG: Degradation is 0.', CAST(10 + o_orderkey % 90 AS STRING), ', cliff lap is ', CAST(8 + o_orderkey % 25 AS STRING), chr(10),
  CASE WHEN o_orderkey % 5 = 0 THEN 'Noise' ELSE concat('DRV: Max viable stint of ', CAST(10 + o_orderkey % 30 AS STRING), ' laps on this tyre') END) AS text
FROM orders"""


def _orders(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return run_sql(spark, sql, {"orders": spread(spark.read.parquet(f"{sf_dir}/orders.parquet"))})


def season_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sessions of all rounds of the schedule."""
    return session_load.events(run_sql(spark, SCHEDULE, tables(spark, sf_dir, "sessions")))


def session_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laps and telemetry rows that each session of 2024 and 2025 adds where those up to 2024 are stored,
    one session without any lap among them."""
    t = tables(spark, sf_dir, "sessions", "laps", "telemetry")
    named = t["sessions"].select(F.col("id").alias("session_id"), *session_load.KEY)
    raw = run_sql(spark, RAW_LAPS, t).join(named, "session_id").drop("session_id")
    held = t["laps"].select(F.col("id").alias("lap_id"), "session_id", F.col("driver").alias("Driver"), F.col("lap_number").alias("LapNumber")).join(named, "session_id")
    traces = run_sql(spark, TRACE.replace('"', "`"), t).join(held.drop("session_id"), "lap_id").drop("lap_id")
    nowhere = spark.range(1).select(F.lit(2025).alias("season"), F.lit("NOWHERE 1").alias("circuit"), F.lit("Race").alias("session_type"))
    landed = named.where("season >= 2024").drop("session_id").unionByName(nowhere)
    new = session_load.load(landed, raw, traces, named.where("season <= 2024"))
    laps = new.laps.groupBy(F.col("session_id").alias("id")).agg(F.count(F.lit(1)).alias("laps"))
    rows = new.telemetry.groupBy(F.split_part("lap_id", F.lit("|"), F.lit(1)).alias("id")).agg(F.count(F.lit(1)).alias("rows"))
    counted = new.sessions.join(laps, "id", "left").join(rows, "id", "left")
    return counted.select(*session_load.KEY, F.coalesce("laps", F.lit(0)).alias("n_laps"), F.coalesce("rows", F.lit(0)).alias("n_telemetry"))


def corners_populated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corner map where only circuits of Africa were mapped before, and some others had rows without distance."""
    t = tables(spark, sf_dir, "sessions", "corners")
    known = F.when(F.col("circuit").like("AFRICA%"), F.col("distance_from_start"))
    held = t["corners"].where("NOT circuit LIKE 'ASIA%'").select("circuit", "corner_number", known.alias("distance_from_start"))
    return session_load.populate_corners(t["sessions"], held, run_sql(spark, MAPS, t))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus of all templates."""
    held = {}
    for source, prefix in SOURCES.items():
        names = [n for n in templates.QUERIES if n == prefix or prefix != "stay_out" and n.startswith(prefix) and n != "stay_out"]
        parts = [templates.template(spark, sf_dir, n).select("question", "answer") for n in names]
        held[source] = parts[0]
        for p in parts[1:]:
            held[source] = held[source].unionByName(p)
    return C.assemble(held)


def telemetry_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = X.implausible(F.col("text"))
    told = _orders(spark, sf_dir, BLOCKS).select("id", bad.alias("bad"))
    return told.select("id", F.array_join(F.transform("bad", lambda b: F.concat(b["field"], F.lit("="), F.round(b["value"], 3).cast("decimal(9,3)").cast("string"))), ",").alias("failures"), (F.size("bad") == 0).alias("ok"))


def _fastest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fastest laps with sector deltas, compound and tyre age."""
    laps = _laps(spark, sf_dir)
    rows = lap_query.sector_deltas(lap_query.fastest_per_driver(laps))
    return rows.join(laps.select("session_id", "driver", "lap_number", "compound", "tyre_age"), ["session_id", "driver", "lap_number"])


def lap_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["lap_number", "sector1", "sector2", "sector3", "compound", "tyre_age"]
    return render.by_session(_fastest(spark, sf_dir), columns).select("session_id", render.lap_table(F.col("rows")).alias("text"))


def lap_bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two fastest drivers of each session; all three in qualifying."""
    n = F.when(F.col("session_id").endswith("|Q"), 3).otherwise(2)
    rows = render.by_session(_fastest(spark, sf_dir), ["lap_number"]).withColumn("rows", F.slice("rows", F.lit(1), n))
    return rows.select("session_id", render.lap_bullets(F.col("rows")).alias("text"))


def delta_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sector deltas of three drivers in races, of all in qualifying."""
    wanted = F.when(F.col("session_id").endswith("|Race"), F.array(*map(F.lit, ("VER", "HAM", "LEC")))).otherwise(F.array().cast("array<string>"))
    rows = render.by_session(_fastest(spark, sf_dir), ["delta1", "delta2", "delta3"])
    return rows.select("session_id", render.delta_text(F.col("rows"), wanted).alias("text"))


def replies_without_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark, said = F.lit(render.BLOCK), F.col("generated")
    reply = F.when(F.col("id") % 3 == 0, F.concat(mark, said, F.lit("  "), mark, said)).when(F.col("id") % 3 == 1, F.concat(said, mark)).otherwise(said)
    return texts.answers(spark, sf_dir).select("id", render.without_repeat(reply).alias("text"))


def driver_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.get(X.drivers(F.col("text")), F.lit(0))
    return texts.messages(spark, sf_dir).select("id", X.driver_name(F.coalesce(first, F.lit("D00"))).alias("name"))


def dialogue_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = X.dialogue(F.col("text"))
    return _orders(spark, sf_dir, TALKS).select("id", F.size(talk).cast("long").alias("n"), F.array_join(F.transform(talk, lambda m: m["role"]), ",").alias("roles"), F.get(talk, F.lit(1))["content"].alias("second"), X.rewrite_is_valid(F.col("text")).alias("valid"))


def dialogue_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, TALKS).select("id", X.dialogue_facts(F.col("text")).alias("f")).select("id", "f.*")


def tyre_stats_by_lap_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tyre_stats with the weather held by session and lap number."""
    t = tables(spark, sf_dir, "laps", "sessions", "weather")
    by_lap = t["weather"].join(t["laps"].select(F.col("id").alias("lap_id"), "session_id", "lap_number"), "lap_id").select("session_id", "lap_number", "track_temp").distinct()
    return rounded(tyre_stats(t["laps"], t["sessions"], by_lap))


def history_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last fifty events of each user since the last one that clears them."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts", "event_type")
    return state.kept_messages(events, "user_id", ["ts", "event_id"], F.col("event_id") % 97 == 0).select("event_id", "user_id", "event_type")


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.report_lines(metrics.score(texts.answers(spark, sf_dir)))


QUERIES = {
    f.__name__: f
    for f in (season_sessions, session_loads, corners_populated, corpus, telemetry_checks, lap_tables, lap_bullets, delta_texts, replies_without_repeats, driver_names, dialogue_turns, dialogue_facts, tyre_stats_by_lap_weather, history_cleared, report_lines)
}

_q, _O = texts._q, "'orders'"


def _corpus_sql() -> str:
    parts = []
    for i, (source, prefix) in enumerate(SOURCES.items()):
        for name in templates.QUERIES:
            if name == prefix or prefix != "stay_out" and name.startswith(prefix) and name != "stay_out":
                parts.append(f"SELECT {i} AS place, '{source}' AS source, question, answer FROM ({templates.checked(name)})")
    union = " UNION ALL ".join(parts)
    tag = texts._alias(K.corpus_aliases(), "concat(question, ' ', answer)")
    split = "CASE WHEN circuit IN ('Italy', 'Monaco', 'Bahrain') THEN 'test' WHEN circuit IN ('Belgium', 'Singapore', 'Hungary') THEN 'val' ELSE 'train' END"
    return with_stats(f", every AS ({union}), kept AS (SELECT *, {tag} AS circuit FROM every QUALIFY row_number() OVER (PARTITION BY question ORDER BY place, answer) = 1) SELECT question, answer, source, circuit, {split} AS split FROM kept")


def _checks_sql() -> str:
    """Failures in order: cells of the table's lines, then labelled values."""
    seconds = "CASE WHEN contains(x, ':') THEN 60 * CAST(split_part(x, ':', 1) AS DOUBLE) + CAST(split_part(x, ':', 2) AS DOUBLE) ELSE CAST(x AS DOUBLE) END"
    names = "['lap_time', 'sector1', 'sector2', 'sector3']"
    line = f"CASE WHEN NOT starts_with(trim(l), '(') AND NOT contains(l, '===') AND len(regexp_extract_all(l, {_q(K.TIME_CELL)})) >= 4 THEN list_transform(regexp_extract_all(l, {_q(K.TIME_CELL)})[1:4], lambda x, i: struct_pack(f := {names}[i], v := {seconds}, lo := CASE WHEN i = 1 THEN 60.0 ELSE 10.0 END, hi := CASE WHEN i = 1 THEN 145.0 ELSE 60.0 END)) ELSE [] END"
    labelled = " || ".join(f"list_transform(list_filter(regexp_extract_all(text, {_q('(?i)' + p)}, 1), lambda x: x <> ''), lambda x: struct_pack(f := '{f}', v := CAST(x AS DOUBLE), lo := CAST({low} AS DOUBLE), hi := CAST({high} AS DOUBLE)))" for f, p, low, high in K.LABELLED)
    return f"""WITH b AS ({BLOCKS}), c AS (SELECT id, CASE WHEN trim(text) = '' OR (contains(lower(text), 'no valid lap') AND contains(lower(text), 'after filters')) THEN []
  ELSE list_filter(flatten(list_transform(string_split(text, chr(10)), lambda l: {line})) || {labelled}, lambda s: s.v < s.lo OR s.v > s.hi) END AS bad FROM b)
SELECT id, coalesce(array_to_string(list_transform(bad, lambda s: s.f || '=' || CAST(CAST(round(s.v, 3) AS DECIMAL(9, 3)) AS VARCHAR)), ','), '') AS failures, len(bad) = 0 AS ok FROM c"""


_FULL = "is_valid = 1 AND lap_time > 0 AND sector1 IS NOT NULL AND sector2 IS NOT NULL AND sector3 IS NOT NULL AND (session_type <> 'Race' OR lap_number > 1)"
_BEST = f"f AS (SELECT * FROM raced WHERE {_FULL} QUALIFY row_number() OVER (PARTITION BY session_id, driver ORDER BY lap_time, lap_number) = 1)"


def _time(c: str) -> str:
    return f"(CASE WHEN round({c} * 1000) >= 60000 THEN printf('%d:%02d.%03d', CAST(round({c} * 1000) AS BIGINT) // 60000, CAST(round({c} * 1000) AS BIGINT) % 60000 // 1000, CAST(round({c} * 1000) AS BIGINT) % 1000) ELSE printf('%d.%03d', CAST(round({c} * 1000) AS BIGINT) // 1000, CAST(round({c} * 1000) AS BIGINT) % 1000) END)"


def _signed(c: str) -> str:
    return f"printf('%+.3fs', {c})"


ORACLE_SQL = {
    "season_sessions": with_stats("SELECT season, circuit, unnest(['Q', 'Race']) AS session_type FROM (SELECT season, circuit FROM sessions GROUP BY ALL) QUALIFY dense_rank() OVER (PARTITION BY season ORDER BY circuit) > 1"),
    "session_loads": with_stats(
        f""", r AS (SELECT r.*, season, circuit, session_type FROM ({RAW_LAPS}) AS r JOIN sessions ON sessions.id = r.session_id WHERE season = 2025 AND {KEPT}),
n AS (SELECT season, circuit, session_type, count(*) AS n_laps FROM r GROUP BY ALL),
t AS (SELECT lap_id, max("Distance") AS last_d, count("Distance") AS k FROM ({TRACE}) GROUP BY lap_id),
m AS (SELECT season, circuit, session_type, sum(CAST(ceil(last_d / 50) AS BIGINT)) AS n_telemetry FROM t JOIN laps ON laps.id = lap_id JOIN r ON r.session_id = laps.session_id AND r."Driver" = laps.driver AND r."LapNumber" = laps.lap_number WHERE k > 1 GROUP BY ALL)
SELECT season, circuit, session_type, coalesce(n_laps, 0) AS n_laps, CAST(coalesce(n_telemetry, 0) AS BIGINT) AS n_telemetry
FROM (SELECT season, circuit, session_type FROM sessions WHERE season = 2025 UNION ALL SELECT 2025, 'NOWHERE 1', 'Race') LEFT JOIN n USING (season, circuit, session_type) LEFT JOIN m USING (season, circuit, session_type)"""
    ),
    "corners_populated": with_stats("SELECT circuit, corner_number, distance_from_start FROM corners WHERE circuit LIKE 'AFRICA%' UNION ALL SELECT circuit, corner_number, distance_from_start + (SELECT max(season) FROM sessions AS s WHERE s.circuit = c.circuit) FROM corners AS c WHERE circuit NOT LIKE 'AFRICA%' AND corner_number % 7 <> 3"),
    "corpus": _corpus_sql(),
    "telemetry_checks": _checks_sql(),
    "lap_tables": with_stats(f", {_BEST} SELECT session_id, {_q(render.HEADING)} || chr(10) || string_agg(printf('%-4s  %4d  %9s  %7s  %7s  %7s  %10s  %7s', driver, lap_number, {_time('lap_time')}, {_time('sector1')}, {_time('sector2')}, {_time('sector3')}, compound, CAST(tyre_age AS VARCHAR)), chr(10) ORDER BY lap_time, driver) AS text FROM f GROUP BY session_id"),
    "lap_bullets": with_stats(
        f""", {_BEST}, p AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY lap_time, driver) AS rn FROM f QUALIFY rn <= CASE WHEN session_type = 'Q' THEN 3 ELSE 2 END)
SELECT session_id, string_agg('- ' || driver || ' - lap ' || lap_number || ', ' || {_time('lap_time')}, chr(10) ORDER BY rn) || CASE WHEN count(*) = 2 THEN chr(10) || printf('- Overall gap: **%.3fs** (%s faster).', max(lap_time) - min(lap_time), arg_min(driver, rn)) ELSE '' END AS text FROM p GROUP BY session_id"""
    ),
    "delta_texts": with_stats(
        f""", {_BEST}, d AS (SELECT *, sector1 - first_value(sector1) OVER w AS d1, sector2 - first_value(sector2) OVER w AS d2, sector3 - first_value(sector3) OVER w AS d3 FROM f WINDOW w AS (PARTITION BY session_id ORDER BY lap_time, driver))
SELECT session_id, coalesce(string_agg(driver || ' S1: ' || {_signed('d1')} || ' S2: ' || {_signed('d2')} || ' S3: ' || {_signed('d3')}, chr(10) ORDER BY lap_time, driver) FILTER (session_type = 'Q' OR driver IN ('VER', 'HAM', 'LEC')), '') AS text FROM d GROUP BY session_id"""
    ),
    "replies_without_repeats": f"{texts._A} SELECT id, CASE id % 3 WHEN 0 THEN {_q(render.BLOCK)} || rtrim(generated) WHEN 1 THEN generated || {_q(render.BLOCK)} ELSE generated END AS text FROM a",
    "driver_names": f"WITH d AS ({texts.ORACLE_SQL['intent_drivers']}), n AS (SELECT unnest(map_entries(MAP {{{', '.join(f'{_q(c)}: {_q(n)}' for c, n in K.FULL_NAMES.items())}}})) AS e) SELECT id, coalesce(e.value, nullif(split_part(drivers, ',', 1), ''), 'D00') AS name FROM d LEFT JOIN n ON e.key = split_part(drivers, ',', 1)",
    "dialogue_turns": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(4 AS BIGINT) END AS n, CASE WHEN o_orderkey % 5 <> 0 THEN 'user,assistant,user,assistant' END AS roles, CASE WHEN o_orderkey % 5 <> 0 THEN concat(2 + o_orderkey % 30, ' laps old, track temp is fine, the gap grows') END AS second, o_orderkey % 5 <> 0 AS valid FROM orders",
    "dialogue_facts": "SELECT o_orderkey AS id, ['HAM', 'VER', NULL][o_orderkey % 3 + 1] AS driver, CAST(1 + o_orderkey % 70 AS INTEGER) AS lap_number, CAST(2 + o_orderkey % 30 AS INTEGER) AS tyre_age, if(o_orderkey % 2 = 0, 'soft', NULL) AS compound, CAST(10 + o_orderkey % 90 AS DOUBLE) / 100 AS deg_rate, CAST(8 + o_orderkey % 25 AS INTEGER) AS cliff_lap, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(10 + o_orderkey % 30 AS INTEGER) END AS max_viable_laps FROM orders",
    "tyre_stats_by_lap_weather": with_stats("SELECT * FROM tyre_stats"),
    "history_cleared": "SELECT event_id, user_id, event_type FROM (SELECT *, max(CASE WHEN event_id % 97 = 0 THEN struct_pack(ts := ts, e := event_id) END) OVER (PARTITION BY user_id) AS cleared FROM events) WHERE cleared IS NULL OR ts > cleared.ts OR (ts = cleared.ts AND event_id > cleared.e) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 50",
    "report_lines": texts.SCORED
    + """, z AS (SELECT *, least(CAST(floor(rouge_l * 5) AS INTEGER), 4) AS rb, least(CAST(floor(bleu * 5) AS INTEGER), 4) AS bb FROM scored),
sums AS (SELECT count(*) AS n, avg(rouge_l) AS rouge_l, avg(bleu) AS bleu, avg(CAST(factual AS INTEGER)) AS factual, avg(halluc) AS halluc, count(*) FILTER (NOT factual) AS wrong FROM z)
SELECT 0 AS place, 'examples ' || n AS line FROM sums UNION ALL SELECT 1, 'rouge_l ' || CAST(round(rouge_l, 4) AS DECIMAL(18, 4)) FROM sums UNION ALL SELECT 2, 'bleu ' || CAST(round(bleu, 4) AS DECIMAL(18, 4)) FROM sums
UNION ALL SELECT 3, 'factual ' || CAST(round(factual, 4) AS DECIMAL(18, 4)) FROM sums UNION ALL SELECT 4, 'halluc ' || CAST(round(halluc, 4) AS DECIMAL(18, 4)) FROM sums
UNION ALL SELECT 100 + rb, 'rouge_l ' || ['0.0-0.2', '0.2-0.4', '0.4-0.6', '0.6-0.8', '0.8-1.0'][rb + 1] || ' ' || count(*) FROM z GROUP BY rb
UNION ALL SELECT 200 + bb, 'bleu ' || ['0.0-0.2', '0.2-0.4', '0.4-0.6', '0.6-0.8', '0.8-1.0'][bb + 1] || ' ' || count(*) FROM z GROUP BY bb
UNION ALL SELECT 400, 'wrong numbers in ' || wrong || ' of ' || n FROM sums
UNION ALL (SELECT CAST(300 + row_number() OVER (ORDER BY round(rouge_l, 9), id) AS INTEGER), 'low ' || id || ' ' || CAST(round(rouge_l, 3) AS DECIMAL(18, 3)) || ' ' || CAST(round(bleu, 3) AS DECIMAL(18, 3)) FROM z ORDER BY 1 LIMIT 10)
UNION ALL (SELECT CAST(400 + row_number() OVER (ORDER BY id) AS INTEGER), 'wrong ' || id FROM z WHERE NOT factual ORDER BY 1 LIMIT 10)""",
}
