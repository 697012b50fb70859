"""Questions in bulk: every message is parsed, merged with those before it, routed, fetched and checked in one plan.

The same rules as lap_query.answer() and chat.reply(), for a table of messages instead of one: the newest fitting
session is an equi-join on a small table of sessions, and laps are only fetched once for each different request
(session, branch, lap), however many messages make it. What a request fetches is a session's field, some
twenty drivers, as one array, so that the checks of a message work within its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..streaming import state
from .lap_query import IDENTICAL, MISSING, SUSPECT, SUSPECT_GAP, average_pace, fastest_per_driver, numbered_lap_of, sector_deltas

UNAVAILABLE, IMPLAUSIBLE = "session unavailable", "values out of bounds"
STORED, NOT_AVAILABLE, NOT_FOUND, MODEL = "stored_valid", "data_unavailable", "no_data_found", "model_knowledge"
ROW = ["driver", "lap_number", "lap_time", "sector1", "sector2", "sector3", "delta1", "delta2", "delta3"]
REQUEST = ["session_id", "branch", "lap"]


def parsed(messages: DataFrame) -> DataFrame:
    """messages (id, sid, text and any clear) with what they name, and asks: whether stored laps are asked for.

    A message that doubts an answer asks for laps, whatever else it says.
    """
    t = F.col("text")
    lap = F.coalesce(X.lap_number(t).cast("string"), F.when(X.lap_fastest(t), F.lit("fastest")))
    parts = {"circuit": X.circuit(t), "year": X.year(t), "session": X.session(t), "lap": lap, "drivers": X.drivers(t), "wants_average": X.wants_average(t), "doubts": X.pushback(t)}
    told = messages.withColumns({**parts, "asks": X.mode(t) == "telemetry"})
    return told.withColumn("asks", F.col("asks") | F.col("doubts"))


def merged(told: DataFrame, key: str = "sid", order: tuple[str, ...] = ("id",)) -> DataFrame:
    """Parsed messages with what they leave out taken from earlier ones of their conversation that fetched laps.

    A message fetches laps if it asks for them and a circuit is known by then, its own or an earlier one's.
    """
    clear = F.col("clear") if "clear" in told.columns else F.lit(False)
    since = state.since_clear(told, key, list(order), clear)
    upto = Window.partitionBy(key, "_since").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    since = since.withColumn("telemetry", F.col("asks") & F.max(F.col("asks") & F.col("circuit").isNotNull()).over(upto))
    out = state.carry_intent(since.drop("_since"), key, list(order)).drop("telemetry")
    return out.withColumn("drivers", F.coalesce("drivers", F.array().cast("array<string>")))


def session_lookup(sessions: DataFrame) -> DataFrame:
    """found by stored circuit, session type and season, season 0 standing for the newest one; ties go to the lower id."""
    by_season = sessions.groupBy(F.col("circuit").alias("stored"), F.col("session_type").alias("kind"), "season").agg(F.min("id").alias("found"))
    newest = by_season.groupBy("stored", "kind").agg(F.max_by("found", "season").alias("found"), F.max("season").alias("found_season"))
    return by_season.withColumn("found_season", F.col("season")).unionByName(newest.withColumn("season", F.lit(0)).select("stored", "kind", "season", "found", "found_season"))


def _kind(session: Column) -> Column:
    """The session type as stored: parts of qualifying are one session, and what isn't named is the race."""
    return F.when(session.isin("Q", "Q1", "Q2", "Q3"), "Q").when(session.startswith("FP"), session).otherwise("Race")


def routed(told: DataFrame, sessions: DataFrame) -> DataFrame:
    """Merged messages with mode, the session found, its season and kind, and the branch that fetches its laps."""
    ready = F.col("asks") & F.col("circuit").isNotNull()
    mode = F.when(F.col("asks") & (F.col("circuit").isNotNull() | F.col("doubts")), "telemetry").otherwise("general")
    asked = told.withColumns({"mode": mode, "_stored": F.when(ready, X.stored_circuit(F.col("circuit"))), "_kind": _kind(F.col("session")), "_season": F.coalesce("year", F.lit(0))})
    look = session_lookup(sessions)
    same = (F.col("_stored") == look["stored"]) & (F.col("_kind") == look["kind"]) & (F.col("_season") == look["season"])
    number = F.col("lap").try_cast("int")
    branch = F.when(F.col("wants_average") & number.isNull(), "avg_lap").when(number.isNotNull(), "lap_n").otherwise("fastest_per_driver")
    found = asked.join(look, same, "left").withColumn("branch", F.when(F.col("found").isNotNull(), branch))
    lap = F.when(F.col("branch") == "lap_n", number).otherwise(F.when(F.col("branch").isNotNull(), 0))
    return found.withColumns({"lap_asked": lap, "session_id": F.col("found")}).drop("stored", "season", "kind", "found")


def fetched(requests: DataFrame, laps: DataFrame, sessions: DataFrame) -> DataFrame:
    """REQUEST and field, the rows of its whole session by time, for each different request (and found_season).

    Only laps of sessions asked for are read on, and, where laps lie in folders by season, only of their seasons.
    """
    wanted = requests.groupBy(*REQUEST).agg(F.max("found_season").alias("season"))
    kinds = sessions.select(F.col("id").alias("session_id"), "session_type")
    held = wanted.select("session_id", *(["season"] if "season" in laps.columns else [])).distinct()
    mine = laps.join(held, held.columns, "left_semi").join(kinds, "session_id")
    of = lambda branch: wanted.where(F.col("branch") == branch)
    means = of("avg_lap").join(sector_deltas(average_pace(mine), average=True), "session_id").withColumn("lap_number", F.lit(None).cast("int"))
    best = of("fastest_per_driver").join(sector_deltas(fastest_per_driver(mine)), "session_id")
    one = of("lap_n").join(sector_deltas(numbered_lap_of(mine, of("lap_n").select("session_id", "lap").distinct()), by=("session_id", "lap")), ["session_id", "lap"])
    rows = means.select(*REQUEST, *ROW).unionByName(best.select(*REQUEST, *ROW)).unionByName(one.select(*REQUEST, *ROW))
    ordered = F.array_sort(F.collect_list(F.struct("lap_time", "driver", *(c for c in ROW if c not in ("lap_time", "driver")))))
    return rows.groupBy(*REQUEST).agg(ordered.alias("field"))


def answered(messages: DataFrame, laps: DataFrame, sessions: DataFrame) -> DataFrame:
    """id, sid, mode, source, branch, session_id, rejection and rows of every message; nothing runs until it is read.

    Of a message without a circuit, only one that doubts stays a question of laps, and finds nothing. Two drivers'
    times are compared; times out of bounds reject the whole answer. rows are those of the drivers named, or of
    all, by time. Null texts are general talk.
    """
    asked = routed(merged(parsed(messages)), sessions).withColumn("lap", F.col("lap_asked"))
    field = fetched(asked.where("branch IS NOT NULL").select(*REQUEST, "found_season"), laps, sessions)
    told = asked.join(field, REQUEST, "left")
    none = F.size("drivers") == 0
    rows = F.filter(F.coalesce("field", F.array()), lambda r: none | F.array_contains("drivers", r["driver"]))
    told = told.withColumn("rows", rows)
    pair = (F.size("drivers") == 2) & (F.size("rows") > 0)
    first, second = F.get("rows", F.lit(0)), F.get("rows", F.lit(1))
    gap = F.abs(first["lap_time"] - second["lap_time"])
    suspect = (F.col("_kind") == "Q") & ~F.col("wants_average") & (gap < SUSPECT_GAP)
    unequal = F.when(F.size("rows") < 2, MISSING).when(F.round(first["lap_time"], 3) == F.round(second["lap_time"], 3), IDENTICAL).when(suspect, SUSPECT)
    odd = F.exists("rows", lambda r: ~X.plausible_times(*(F.round(r[c], 3) for c in ("lap_time", "sector1", "sector2", "sector3"))))
    ready = (F.col("mode") == "telemetry") & F.col("circuit").isNotNull()
    rejection = F.when(ready & F.col("session_id").isNull(), UNAVAILABLE).when(ready & pair, F.coalesce(unequal, F.when(odd, IMPLAUSIBLE))).when(ready & odd, IMPLAUSIBLE)
    told = told.withColumn("rejection", rejection)
    source = (
        F.when(F.col("mode") != "telemetry", MODEL)
        .when(F.col("circuit").isNull(), NOT_FOUND)
        .when(F.col("rejection").isNotNull(), NOT_AVAILABLE)
        .when(F.size("rows") == 0, NOT_FOUND)
        .otherwise(STORED)
    )
    shown = F.when(source == STORED, F.col("rows")).otherwise(F.array().cast(told.schema["rows"].dataType))
    return told.select("id", "sid", "mode", source.alias("source"), "branch", "session_id", "rejection", shown.alias("rows"))


def missing_sessions(messages: DataFrame, sessions: DataFrame, seasons: list[int], kinds: tuple[str, ...] = ("Q", "Race")) -> DataFrame:
    """What an ingest should bring in: circuit, season and session_type that messages ask for and that aren't stored,
    with place, the order in which seasons are tried where none was named (the newest first), and the number of messages.

    Practice isn't landed, and so never asked for.
    """
    asked = routed(merged(parsed(messages)), sessions).where(F.col("asks") & F.col("_stored").isNotNull() & F.col("session_id").isNull() & F.col("_kind").isin(*kinds))
    tried = F.array(*(F.struct(F.lit(y).alias("season"), F.lit(i + 1).alias("place")) for i, y in enumerate(sorted(seasons, reverse=True))))
    one = F.array(F.struct(F.col("year").alias("season"), F.lit(1).alias("place")))
    rows = asked.withColumn("t", F.explode(F.when(F.col("year").isNull(), tried).otherwise(one)))
    return rows.groupBy(F.col("_stored").alias("circuit"), "t.season", F.col("_kind").alias("session_type"), "t.place").agg(F.count(F.lit(1)).alias("messages"))
