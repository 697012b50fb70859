"""From raw timing rows to laps and evenly spaced telemetry."""

from __future__ import annotations

from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import traces

STEP = 50.0
RAW_TIMES = ["LapTime", "Sector1Time", "Sector2Time", "Sector3Time"]


def seconds(raw: DataFrame, name: str) -> Column:
    """A column that holds day-time intervals, or numbers of seconds, as seconds."""
    c = F.col(name)
    if not isinstance(raw.schema[name].dataType, T.DayTimeIntervalType):
        return c.cast("double")
    parts = {"DAY": 86400, "HOUR": 3600, "MINUTE": 60, "SECOND": 1}
    return reduce(add, (F.extract(F.lit(p), c).cast("double") * n for p, n in parts.items()))


def clean_laps(raw: DataFrame, drop_null_status: bool = False) -> DataFrame:
    """Laps fit for analysis: all times there, no pit in or out, no safety car (status 4 or 6), not deleted.

    The test of a column that raw doesn't have is left out. A null status keeps the lap, unless
    drop_null_status.
    """
    tests = [F.col(c).isNotNull() for c in RAW_TIMES if c in raw.columns]
    tests += [F.col(c).isNull() for c in ("PitOutTime", "PitInTime") if c in raw.columns]
    if "TrackStatus" in raw.columns:
        tests.append(~F.coalesce(F.col("TrackStatus").cast("string").rlike("[46]"), F.lit(drop_null_status)))
    if "Deleted" in raw.columns:
        tests.append(~F.coalesce(F.col("Deleted"), F.lit(False)))
    return raw.where(reduce(and_, tests)) if tests else raw


def to_laps(raw: DataFrame, session_id: Column) -> DataFrame:
    """Raw laps as rows of the laps table, under a stable id; an empty compound is null."""
    named = raw.select(
        session_id.alias("session_id"),
        F.col("Driver").alias("driver"),
        F.col("LapNumber").cast("int").alias("lap_number"),
        *(seconds(raw, c).alias(n) for c, n in zip(RAW_TIMES, ("lap_time", "sector1", "sector2", "sector3"), strict=True)),
        F.nullif(F.col("Compound"), F.lit("")).alias("compound"),
        F.col("TyreLife").cast("int").alias("tyre_age"),
        F.lit(1).alias("is_valid"),
    )
    return named.withColumn("id", F.concat_ws("|", "session_id", "driver", F.col("lap_number").cast("string")))


def filled(value: str, by: list[str], order: str) -> Column:
    """The value, else the last one before, else the first one after; NaN counts as missing."""
    known = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    w = Window.partitionBy(*by).orderBy(order)
    before = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return F.coalesce(before, after)


def resample(trace: DataFrame, columns: dict[str, str], key: str = "lap_id", order: str = "i", distance: str = "Distance", step: float = STEP) -> DataFrame:
    """Each lap's trace on a grid of distances 0, step, ... below its last distance.

    columns maps source columns to results; a source that trace doesn't have gives zeros. Between
    samples values are interpolated, before the first one held. Laps with fewer than two samples of
    a known distance yield nothing. Each sample lays out the grid's points up to the next one, so a lap is
    sorted once and joins nothing. Packed traces, whose columns are arrays in the lap's row, aren't shuffled either.
    """
    if traces.is_packed(trace, distance):
        return traces.resampled(trace, columns, key, order, distance, step)
    known = trace.where(F.col(distance).isNotNull() & ~F.isnan(distance)).withColumn("_d", F.col(distance).cast("double"))
    there = {c: n for c, n in columns.items() if c in trace.columns}
    w = Window.partitionBy(key).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    points = known.select(key, order, "_d", *(filled(c, [key], order).alias(n) for c, n in there.items()))
    ahead = [F.lead(c).over(w).alias(f"_next_{c}") for c in ["_d", *there.values()]]
    segments = points.select("*", *ahead, F.row_number().over(w).alias("_n"), F.last("_d").over(whole).alias("_last"), F.count(F.lit(1)).over(whole).alias("_k"))

    def index(at):
        """The first point of the grid that isn't before a distance."""
        return F.greatest(F.lit(0), F.ceil(at / step)).cast("int")

    begin = F.when(F.col("_n") == 1, F.lit(0)).otherwise(index(F.col("_d")))
    end = F.least(index(F.coalesce("_next__d", "_last")), index(F.col("_last"))) - 1  # the last sample holds to the end
    end = F.when(F.col("_next__d").isNull(), index(F.col("_last")) - 1).otherwise(end)
    laid = segments.where("_k >= 2 AND _last > 0").withColumn("_from", begin).withColumn("_to", end).where("_from <= _to")
    near = laid.withColumn("_g", F.explode(F.sequence("_from", "_to"))).withColumn("distance", F.col("_g") * F.lit(step))
    share = F.when(F.col("distance") <= F.col("_d"), 0.0).otherwise(F.coalesce((F.col("distance") - F.col("_d")) / (F.col("_next__d") - F.col("_d")), F.lit(0.0)))
    out = []
    for c, n in columns.items():
        value = F.col(n) + share * (F.coalesce(F.col(f"_next_{n}"), F.col(n)) - F.col(n)) if c in there else F.lit(0.0)
        out.append(F.bround(value).cast("int").alias(n) if n == "gear" else value.alias(n))
    return near.select(key, "distance", *out)
