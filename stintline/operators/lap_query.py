"""The interactive lap query: fastest, numbered or average laps of a session, with deltas and checks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FULL = "is_valid = 1 AND lap_time IS NOT NULL AND sector1 IS NOT NULL AND sector2 IS NOT NULL AND sector3 IS NOT NULL"
TIMES = ["lap_time", "sector1", "sector2", "sector3"]
MISSING, IDENTICAL, SUSPECT, SUSPECT_GAP = "missing driver", "identical lap times", "suspiciously close", 0.05


@dataclass
class Answer:
    """What a question fetched: rows, how they were found, and why they can't be trusted, if so."""

    rows: DataFrame | None
    source: str
    branch: str = ""
    session_id: str | None = None
    rejection: str | None = None
    meta: dict = field(default_factory=dict)


def without_first(laps: DataFrame) -> DataFrame:
    """Race laps but the first; laps must carry session_type."""
    return laps.where("session_type <> 'Race' OR lap_number > 1")


def fastest_per_driver(laps: DataFrame, by: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """The fastest full lap of each driver (the earlier on ties)."""
    w = Window.partitionBy(*by, "driver").orderBy("lap_time", "lap_number")
    full = without_first(laps).where(f"{FULL} AND lap_time > 0")
    return full.withColumn("rn", F.row_number().over(w)).where("rn = 1").select(*by, "driver", "lap_number", *TIMES)


def numbered_lap(laps: DataFrame, number: int, by: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """That lap of each driver; lap 1 of a race is none."""
    return without_first(laps).where(f"{FULL} AND lap_number = {int(number)}").select(*by, "driver", "lap_number", *TIMES)


def numbered_lap_of(laps: DataFrame, asked: DataFrame) -> DataFrame:
    """The laps (session_id, lap) that are asked for, of each driver, with lap; lap 1 of a race is none."""
    full = without_first(laps).where(FULL).withColumn("lap", F.col("lap_number"))
    return full.join(asked, ["session_id", "lap"]).select("session_id", "lap", "driver", "lap_number", *TIMES)


def average_pace(laps: DataFrame, by: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Mean lap and sector times of each driver."""
    full = without_first(laps).where(f"{FULL} AND lap_time > 0")
    return full.groupBy(*by, "driver").agg(*(F.avg(c).alias(c) for c in TIMES))


def sector_deltas(rows: DataFrame, average: bool = False, by: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """rows with each sector's delta to the reference: the fastest row, or the mean of all rows if average."""
    if average:
        base = rows.groupBy(*by).agg(*(F.avg(f"sector{i}").alias(f"base{i}") for i in (1, 2, 3)))
    else:
        best = F.min_by(F.struct("sector1", "sector2", "sector3"), F.struct("lap_time", "driver"))
        base = rows.groupBy(*by).agg(best.alias("b")).select(*by, *(F.col(f"b.sector{i}").alias(f"base{i}") for i in (1, 2, 3)))
    out = rows.join(base, list(by))
    return out.select(*rows.columns, *((F.col(f"sector{i}") - F.col(f"base{i}")).alias(f"delta{i}") for i in (1, 2, 3)))


def pair_check(rows: DataFrame, by: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Every pair of drivers of a session with its gap, and why the pair can't be trusted, if so.

    Pairs are of one session's field, some twenty drivers. Equal times at three decimals are called
    identical; a qualifying gap under 0.05 s is suspect.
    """
    a, b = rows.alias("a"), rows.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in by]
    gap = F.col("b.lap_time") - F.col("a.lap_time")
    equal = F.round("a.lap_time", 3) == F.round("b.lap_time", 3)
    quali = F.col("a.session_id").endswith("|Q")
    reason = F.when(equal, IDENTICAL).when(quali & (F.abs(gap) < SUSPECT_GAP), SUSPECT)
    pairs = a.join(b, [*same, F.col("a.driver") < F.col("b.driver")])
    return pairs.select(*(F.col(f"a.{c}") for c in by), F.col("a.driver").alias("d1"), F.col("b.driver").alias("d2"), gap.alias("gap"), reason.alias("reason"))


def latest_session(sessions: DataFrame, circuit: str, session_type: str, season: int | None = None) -> str | None:
    """The id of the newest session that fits, or None."""
    fits = sessions.where((F.col("circuit") == circuit) & (F.col("session_type") == session_type))
    if season is not None:
        fits = fits.where(F.col("season") == season)
    row = fits.orderBy(F.col("season").desc()).limit(1).select("id").first()
    return row["id"] if row else None


def answer(intent: dict, laps: DataFrame, sessions: DataFrame, ingest=None) -> Answer:
    """Fetch what a question names: the session, then one of three branches, then the checks.

    ingest(circuit, season, session_type), if given, may load a missing session and return the new
    (laps, sessions). The session filter reaches the scan of laps; where laps are laid out by season, so
    does the season's, and other seasons' folders aren't read.
    """
    kind = "Q" if intent.get("session") == "Q" else "Race"
    found = latest_session(sessions, intent["circuit"], kind, intent.get("year"))
    if found is None and ingest is not None:
        laps, sessions = ingest(intent["circuit"], intent.get("year"), kind)
        found = latest_session(sessions, intent["circuit"], kind, intent.get("year"))
    if found is None:
        return Answer(None, "data_unavailable")
    mine = laps.where(F.col("session_id") == found)
    if "season" in laps.columns:
        season = sessions.where(F.col("id") == found).select("season").first()["season"]
        mine = mine.where(F.col("season") == season)
    mine = mine.withColumn("session_type", F.lit(kind))
    drivers, number, average = intent.get("drivers") or [], intent.get("lap_number"), bool(intent.get("wants_average"))
    if average and number is None:
        field_rows, branch = average_pace(mine), "avg_lap"
    elif number is not None:
        field_rows, branch = numbered_lap(mine, number), "lap_n"
    else:
        field_rows, branch = fastest_per_driver(mine), "fastest_per_driver"
    rows = sector_deltas(field_rows, average=branch == "avg_lap")
    if drivers:
        rows = rows.where(F.col("driver").isin(*drivers))
    held = rows.select("driver", "lap_time").collect() if len(drivers) == 2 else []  # at most two rows
    out = Answer(rows, "stored_valid", branch, found)
    if len(drivers) == 2 and held:
        times = {r["driver"]: r["lap_time"] for r in held}
        if set(drivers) - set(times):
            out.rejection = MISSING
        elif round(times[drivers[0]], 3) == round(times[drivers[1]], 3):
            out.rejection = IDENTICAL
        elif kind == "Q" and branch != "avg_lap" and abs(times[drivers[0]] - times[drivers[1]]) < SUSPECT_GAP:
            out.rejection = SUSPECT
    if rows.isEmpty():
        out.source = "no_data_found"
    return out
