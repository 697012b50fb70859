"""Ground-truth statistics of laps and telemetry, each one DataFrame program.

Times are in seconds. Time deltas are driver minus reference (positive: slower), speeds in km/h (positive:
faster than the field). Every statistic is an aggregate or a window over a key; the small tables of
sessions and corners are broadcast by Spark's own size check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import traces

#: Bounds outside of which a statistic is rejected.
SLOPE, CLIFF, VIABLE = (0.010, 0.250), (8, 35), (10, 45)
SECTOR, TOP_SPEED, CORNER_SPEED, QUALI_RACE = (-2.0, 5.0), (280.0, 370.0), (60.0, 320.0), (2.0, 15.0)
TRAP_SPEED, TRACE_TOLERANCE = (250.0, 380.0), (60.0, 250.0)
LEAST_LAPS, LEAST_AGES, MOST_SLOPE, WORST_LOSS, LATEST_CLIFF = 15, 3, 0.300, 2.0, 40
VIABLE_RANGE, LEAST_RESIDUALS = (3, 35), 6
FUEL_RACE_LAPS, FUEL_SHORT, FUEL_EARLY, FUEL_LATE, FUEL_AGE_GAP, FUEL_LAP_GAP = 30, 3, (2, 6), 5, 2, 20
FUEL_KG_PER_LAP, FUEL_WORST, FUEL_LEAST_PAIRS = 1.7, 3.0, 3
RACE_FIRST, RACE_LAST_CUT = 5, 3

GROUP = ["season", "circuit", "compound"]
#: The same within a race: laps that lie in buckets by session are grouped where they lie.
IN_RACE = ["session_id", *GROUP]


def with_session(laps: DataFrame, sessions: DataFrame) -> DataFrame:
    """laps with the season, circuit and type of their session."""
    named = sessions.select(F.col("id").alias("session_id"), "season", "circuit", "session_type")
    return laps.join(named, "session_id")


def inlier(value: str, keys: list[str], least: int = 4) -> Column:
    """Whether a value lies within two population deviations of its group's mean; true in small or flat groups."""
    w = Window.partitionBy(*keys)
    spread = F.stddev_pop(value).over(w)
    return (F.count(value).over(w) < least) | (spread <= 0) | (F.abs(F.col(value) - F.avg(value).over(w)) <= 2 * spread)


def slope(y: str, x: str) -> Column:
    """Least-squares slope of y over x; null for fewer than two points or a constant x."""
    return F.when(F.min(x) < F.max(x), F.regr_slope(y, x))


def tyre_stats(laps: DataFrame, sessions: DataFrame, weather: DataFrame | None = None) -> DataFrame:
    """Degradation, cliff, viable stint and temperature sensitivity of each compound at a race.

    weather (optional) holds track_temp by lap_id, or by session_id and lap_number; laps may hold it themselves.
    """
    raced = with_session(laps, sessions).where("session_type = 'Race' AND is_valid = 1 AND lap_time > 0 AND tyre_age IS NOT NULL AND compound <> ''")
    clean = raced.withColumn("_in", inlier("lap_time", IN_RACE)).where("_in").drop("_in").withColumn("age", F.col("tyre_age").cast("double"))
    held = weather is None and "track_temp" in laps.columns
    fits = clean.groupBy(*IN_RACE).agg(F.count(F.lit(1)).alias("n"), slope("lap_time", "age").alias("deg"), (warmth() if held else F.lit(None).cast("double")).alias("warmth"))
    fits = fits.where((F.col("n") >= LEAST_LAPS) & (F.col("deg") > 0) & (F.col("deg") <= MOST_SLOPE))
    by_age = clean.groupBy(*IN_RACE, "tyre_age").agg(F.avg("lap_time").alias("mean"))
    w = Window.partitionBy(*IN_RACE).orderBy("tyre_age")
    steps = by_age.withColumn("step", (F.col("mean") - F.lag("mean").over(w)) / (F.col("tyre_age") - F.lag("tyre_age").over(w)))
    # a tyre's ages, of which there are some dozens at most, are one row: laps are read for these and for fits alone
    at = F.collect_list(F.struct("tyre_age", "step")).alias("at")
    ages = steps.groupBy(*IN_RACE).agg(F.count(F.lit(1)).alias("k"), F.count("step").alias("steps"), F.median("step").alias("middle"), F.min("tyre_age").alias("first"), F.max("tyre_age").alias("last"), at)
    found = ages.where(F.col("k") >= LEAST_AGES).join(fits, IN_RACE)
    trigger = F.greatest(F.lit(0.15), 1.75 * F.col("middle"))
    jumps = F.filter("at", lambda a: a["step"] > F.col("trigger"))
    cliff = F.when((F.col("k") >= 4) & (F.col("steps") >= 2), F.array_min(F.transform(jumps, lambda a: F.least(a["tyre_age"], F.lit(LATEST_CLIFF)))))
    too_old = F.filter("at", lambda a: (a["tyre_age"] - F.col("first")) * F.col("deg") > WORST_LOSS)
    found = found.withColumn("trigger", trigger).withColumns({"cliff": cliff, "over": F.array_min(F.transform(too_old, lambda a: a["tyre_age"]))})
    viable = F.when(F.col("over").isNotNull(), F.greatest(F.col("over") - 1, "first")).otherwise(F.col("last"))
    viable = F.when(F.col("cliff").isNotNull(), F.least(viable, F.greatest(F.lit(1), F.col("cliff") - 1))).otherwise(viable)
    found = found.withColumn("viable", viable).withColumn("viable", F.when(F.col("viable").between(*VIABLE_RANGE), F.col("viable")))
    found = found.where(F.col("deg").between(*SLOPE) & F.col("cliff").between(*CLIFF) & F.col("viable").between(*VIABLE))
    if weather is not None:
        found = found.drop("warmth").join(temperature_sensitivity(clean, weather), IN_RACE, "left")
    return found.select("circuit", "compound", "season", F.col("deg").alias("avg_deg_per_lap"), F.col("cliff").cast("int").alias("cliff_lap"), F.col("viable").cast("int").alias("max_viable_laps"), F.col("warmth").alias("track_temp_sensitivity"))


def warmth() -> Column:
    """Slope of lap time over track temperature, once the slope over tyre age is taken off, of a group of laps.

    Slopes are linear: that of lap time less a multiple of age is the difference of theirs.
    """
    warm = F.when(~F.isnan("track_temp"), F.col("track_temp"))
    time, age = (F.when(warm.isNotNull(), F.col(c)) for c in ("lap_time", "age"))
    per_age = F.coalesce(F.when(F.min(age) < F.max(age), F.regr_slope(time, age)), F.lit(0.0))
    told = (F.count(warm) >= LEAST_RESIDUALS) & (F.min(warm) < F.max(warm))
    return F.when(told, F.regr_slope(time, warm) - per_age * F.regr_slope(age, warm))


def temperature_sensitivity(clean: DataFrame, weather: DataFrame) -> DataFrame:
    """warmth() of each race's compounds, with temperatures by lap_id, or by session_id and lap_number."""
    if "lap_id" in weather.columns:
        warm = clean.drop("track_temp").join(weather.select(F.col("lap_id").alias("id"), "track_temp"), "id")
    else:
        warm = clean.drop("track_temp").join(weather.select("session_id", "lap_number", "track_temp"), ["session_id", "lap_number"])
    return warm.groupBy(*IN_RACE).agg(warmth().alias("warmth"))


def driver_sector_stats(laps: DataFrame, sessions: DataFrame) -> DataFrame:
    """Mean sector deltas of each driver in qualifying to the session's fastest lap (first on ties).

    A delta out of bounds counts as missing; a driver without any, or with a mean out of bounds, is left out.
    """
    quali = with_session(laps, sessions).where("session_type = 'Q' AND is_valid = 1 AND lap_time IS NOT NULL AND sector1 IS NOT NULL AND sector2 IS NOT NULL AND sector3 IS NOT NULL")
    fastest = F.min_by(F.struct("sector1", "sector2", "sector3"), F.struct("lap_time", "id"))
    best = quali.groupBy("session_id").agg(fastest.alias("best"))
    means = []
    for i in (1, 2, 3):
        delta = F.col(f"sector{i}") - F.col(f"best.sector{i}")
        means.append(F.avg(F.when(delta.between(*SECTOR), delta)).alias(f"avg_sector{i}_delta"))
    found = quali.join(best, "session_id").groupBy("driver", "circuit", "season").agg(*means)
    columns = [F.col(f"avg_sector{i}_delta") for i in (1, 2, 3)]
    within = [F.coalesce(c.between(*SECTOR), F.lit(True)) for c in columns]
    return found.where(F.coalesce(*columns).isNotNull() & within[0] & within[1] & within[2])


def speed_trap_stats(telemetry: DataFrame, laps: DataFrame, sessions: DataFrame) -> DataFrame:
    """Mean top speed of each driver's race laps, and its place in the field before the bounds apply."""
    if traces.is_packed(telemetry):
        fastest, high = F.array_max("speed"), TRAP_SPEED[1]
        top = F.when(fastest <= high, fastest).otherwise(F.array_max(F.filter("speed", lambda x: x <= high)))
        tops = traces.traced(telemetry, laps).withColumn("top", top).where(F.col("top") >= TRAP_SPEED[0])
    else:
        tops = telemetry.where(F.col("speed").between(*TRAP_SPEED)).groupBy("lap_id").agg(F.max("speed").alias("top"))
        tops = tops.join(laps.withColumnRenamed("id", "lap_id"), "lap_id")
    raced = with_session(tops, sessions).where("session_type = 'Race' AND is_valid = 1")
    means = raced.groupBy("driver", "circuit", "season").agg(F.avg("top").alias("avg_top_speed"))
    place = F.row_number().over(Window.partitionBy("circuit", "season").orderBy(F.round("avg_top_speed", 9).desc(), "driver"))
    return means.withColumn("rank_in_field", place).where(F.col("avg_top_speed").between(*TOP_SPEED))


def local_minima(telemetry: DataFrame) -> DataFrame:
    """Points not faster than the one before, slower than the next, and within the slowest 60 % of their lap.

    The first and the last point of a lap are none. Of packed telemetry nothing is shuffled.
    """
    return traces.minima(traces.packed(telemetry))


def corner_tolerances(corners: DataFrame) -> DataFrame:
    """corners with the distance within which a minimum counts as theirs: half of the nearest gap."""
    w = Window.partitionBy("circuit").orderBy("distance_from_start", "corner_number")
    at = F.col("distance_from_start")
    gaps = [F.coalesce(at - F.lag(at).over(w), F.lit(float("inf"))), F.coalesce(F.lead(at).over(w) - at, F.lit(float("inf")))]
    low, high = TRACE_TOLERANCE
    return corners.where(at.isNotNull()).withColumn("tolerance", F.greatest(F.lit(low), F.least(F.lit(high), F.least(*gaps) / 2)))


def mapped_laps(telemetry: DataFrame, laps: DataFrame, sessions: DataFrame, corners: DataFrame) -> DataFrame:
    """Valid laps with their trace and the map of their circuit.

    A circuit's corners are arrays, of some dozens at most, laid out once for each circuit. They join its sessions,
    and these the laps; all else is in the lap's row.
    """
    corner = F.struct(F.col("corner_number").alias("number"), F.col("tolerance").alias("reach"), F.col("distance_from_start").alias("place"))
    map_of = corner_tolerances(corners).groupBy("circuit").agg(F.array_sort(F.collect_list(corner)).alias("m")).select("circuit", "m.place", "m.number", "m.reach")
    mapped = sessions.select(F.col("id").alias("session_id"), "circuit").join(map_of, "circuit")
    return traces.traced(telemetry, laps).where("is_valid = 1").join(mapped, "session_id")


def corner_matches(telemetry: DataFrame, laps: DataFrame, sessions: DataFrame, corners: DataFrame, *more: str) -> DataFrame:
    """Slowest speed of each lap at each corner (with more of its columns): minima go to the nearest corner (the
    lower number on ties), and are dropped if that corner's tolerance doesn't reach them."""
    return traces.slowest_at_corners(mapped_laps(telemetry, laps, sessions, corners), "driver", "circuit", "lap_id", *more)


def matched_sums(telemetry: DataFrame, laps: DataFrame, sessions: DataFrame, corners: DataFrame, *more: str) -> DataFrame:
    """corner_sums() of corner_matches(), added up where the minima are found."""
    keys = [*more, "driver", "circuit"]
    parts = traces.sums_at_corners(mapped_laps(telemetry, laps, sessions, corners), *keys)
    return parts.groupBy(*keys, "corner_number").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def corner_sums(matches: DataFrame, *more: str) -> DataFrame:
    """Sum and number of the slowest speeds of each driver at each corner (and of each of more): sums of parts add up."""
    return matches.groupBy(*more, "driver", "circuit", "corner_number").agg(F.sum("speed").alias("total"), F.count("speed").alias("n"))


def corner_means(sums: DataFrame) -> DataFrame:
    """Mean slowest speed of each driver at each corner, and field, the mean of all drivers, from corner_sums()."""
    means = sums.groupBy("driver", "circuit", "corner_number").agg((F.sum("total") / F.sum("n")).alias("avg_min_speed"))
    return means.withColumn("field", F.avg("avg_min_speed").over(Window.partitionBy("circuit", "corner_number")))


def corner_stats(means: DataFrame) -> DataFrame:
    """Mean minimum speed of each driver at each corner, and its lead over the mean of all drivers."""
    found = means.where(F.col("avg_min_speed").between(*CORNER_SPEED))
    return found.select("driver", "circuit", "corner_number", "avg_min_speed", (F.col("avg_min_speed") - F.col("field")).alias("delta_vs_field"))


def corner_type(speed: Column) -> Column:
    """slow below 100 km/h, medium up to 180, else high."""
    return F.when(speed < 100, "slow").when(speed <= 180, "medium").otherwise("high")


def typed_corners(means: DataFrame, corners: DataFrame) -> DataFrame:
    """corners with their type, from the field's mean speed; null where no driver was measured."""
    fields = means.where(F.col("avg_min_speed").between(*CORNER_SPEED)).groupBy("circuit", "corner_number").agg(F.first("field").alias("_field"))
    typed = corners.select("circuit", "corner_number", "distance_from_start").join(fields, ["circuit", "corner_number"], "left")
    return typed.withColumn("corner_type", F.when(F.col("_field").isNotNull(), corner_type(F.col("_field")))).drop("_field")


def fuel_stats(laps: DataFrame, sessions: DataFrame) -> DataFrame:
    """Seconds per lap for 10 kg of fuel: early laps against late ones on the same compound at a like age.

    Sessions and drivers need FUEL_RACE_LAPS laps, a driver must finish near the end, and a session
    needs FUEL_LEAST_PAIRS pairs for its effects to count.
    """
    raced = with_session(laps, sessions).where("session_type = 'Race' AND is_valid = 1")
    by_session, by_driver = Window.partitionBy("session_id"), Window.partitionBy("session_id", "driver")
    raced = raced.withColumn("race_end", F.max("lap_number").over(by_session)).where("lap_time IS NOT NULL AND tyre_age IS NOT NULL AND compound <> ''")
    raced = raced.withColumn("own_end", F.max("lap_number").over(by_driver)).withColumn("own_laps", F.count(F.lit(1)).over(by_driver))
    raced = raced.where((F.col("race_end") >= FUEL_RACE_LAPS) & (F.col("own_laps") >= FUEL_RACE_LAPS) & (F.col("own_end") >= F.col("race_end") - FUEL_SHORT) & (F.col("lap_number") < F.col("own_end")))
    keys = ["session_id", "driver", "circuit", "season", "compound"]
    early = raced.where(F.col("lap_number").between(*FUEL_EARLY)).select(*keys, F.col("lap_number").alias("l0"), F.col("lap_time").alias("t0"), F.col("tyre_age").alias("a0"))
    late = raced.where(F.col("lap_number") >= F.col("own_end") - FUEL_LATE).select(*keys, "lap_number", "lap_time", "tyre_age")
    pairs = early.join(late, keys).where((F.abs(F.col("a0") - F.col("tyre_age")) <= FUEL_AGE_GAP) & (F.col("lap_number") - F.col("l0") >= FUEL_LAP_GAP))
    pairs = pairs.withColumn("effect", (F.col("t0") - F.col("lap_time")) * 10.0 / ((F.col("lap_number") - F.col("l0")) * FUEL_KG_PER_LAP)).where(F.abs("effect") <= FUEL_WORST)
    pairs = pairs.withColumn("_pairs", F.count(F.lit(1)).over(by_driver)).where(F.col("_pairs") >= FUEL_LEAST_PAIRS)
    return pairs.groupBy("driver", "circuit", "season").agg(F.median("effect").alias("fuel_effect_per_10kg"))


_EVENT = ["driver", "circuit", "season"]


def quali_best(laps: DataFrame, sessions: DataFrame) -> DataFrame:
    """Best qualifying lap of each driver at an event."""
    named = with_session(laps, sessions).where("is_valid = 1 AND lap_time IS NOT NULL AND session_type = 'Q'")
    return named.groupBy(*_EVENT).agg(F.min("lap_time").alias("quali_lap"))


def race_pace(laps: DataFrame, sessions: DataFrame) -> DataFrame:
    """Median race lap of each driver at an event, without the start and the end."""
    named = with_session(laps, sessions).where("is_valid = 1 AND lap_time IS NOT NULL AND session_type = 'Race'")
    race = named.withColumn("end", F.max("lap_number").over(Window.partitionBy("session_id", "driver")))
    race = race.where((F.col("lap_number") >= RACE_FIRST) & (F.col("lap_number") <= F.col("end") - RACE_LAST_CUT))
    return race.groupBy("session_id", *_EVENT).agg(F.median("lap_time").alias("avg_race_pace")).drop("session_id")


def quali_race(best: DataFrame, pace: DataFrame) -> DataFrame:
    """Both of the above and their difference; one that is out of bounds is null, the row stays."""
    gap = F.col("avg_race_pace") - F.col("quali_lap")
    return best.join(pace, _EVENT).withColumn("delta", F.when(gap.between(*QUALI_RACE), gap))


def quali_race_delta(laps: DataFrame, sessions: DataFrame) -> DataFrame:
    """Best qualifying lap, median race lap and their difference."""
    return quali_race(quali_best(laps, sessions), race_pace(laps, sessions))


def driver_session_counts(laps: DataFrame, sparse_below: int = 3) -> DataFrame:
    """Sessions in which each driver has a lap, and whether they are too few to rely on."""
    counts = laps.groupBy("driver").agg(F.countDistinct("session_id").alias("n_sessions"))
    return counts.withColumn("sparse", F.col("n_sessions") < sparse_below)


def _gate(value: Column, bounds: tuple, name: str) -> Column:
    return F.when(value.isNull(), F.lit(f"{name} missing")).when(~value.between(*bounds), F.lit(f"{name} out of bounds"))


def rejects(stats: DataFrame, gates: dict[str, tuple]) -> DataFrame:
    """Rows that a gate keeps out, with the first reason, for the log of a load."""
    reason = F.coalesce(*(_gate(F.col(c), bounds, c) for c, bounds in gates.items()))
    return stats.withColumn("reason", reason).where("reason IS NOT NULL")
