"""Laps as text: tables, bullets, and the upkeep of replies that show them. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import delta_lines, lap_time_text, let, signed_seconds

#: The table's heading, and the mark that begins a block of data in a reply.
HEADING = "Dr     Lap    LapTime       S1       S2       S3    Compound  TyreAge"
BLOCK = "=== TELEMETRY DATA ==="
NO_ROWS = "No valid lap data after filters (outlap/incomplete sectors excluded)."


def lap_line(r: Column) -> Column:
    """One row of the table: driver, lap, times, compound and tyre age."""
    times = (lap_time_text(r[c]) for c in ("lap_time", "sector1", "sector2", "sector3"))
    return F.format_string("%-4s  %4d  %9s  %7s  %7s  %7s  %10s  %7s", r["driver"], r["lap_number"], *times, F.coalesce(r["compound"], F.lit("N/A")), F.coalesce(r["tyre_age"].cast("string"), F.lit("N/A")))


def lap_table(rows: Column) -> Column:
    """An array of laps as a table, in its order."""
    return F.when(F.size(rows) == 0, NO_ROWS).otherwise(F.array_join(F.concat(F.array(F.lit(HEADING)), F.transform(rows, lap_line)), "\n"))


def lap_bullets(rows: Column) -> Column:
    """A line for each lap of an array in order of time, and the gap where there are two."""
    lines = F.transform(rows, lambda r: F.format_string("- %s - lap %d, %s", r["driver"], r["lap_number"], lap_time_text(r["lap_time"])))
    gap = F.format_string("- Overall gap: **%.3fs** (%s faster).", F.get(rows, F.lit(1))["lap_time"] - F.get(rows, F.lit(0))["lap_time"], F.get(rows, F.lit(0))["driver"])
    return F.array_join(F.concat(lines, F.when(F.size(rows) == 2, F.array(gap)).otherwise(F.array().cast("array<string>"))), "\n")


def delta_text(rows: Column, wanted: Column) -> Column:
    """A line of sector deltas for each wanted driver of an array; for all, if none is wanted."""
    shown = delta_lines(F.transform(rows, lambda r: r["driver"]), wanted)
    mine = let(shown, lambda s: F.filter(rows, lambda r: F.array_contains(s, r["driver"])))
    line = lambda r: F.concat_ws(" ", r["driver"], *(F.concat(F.lit(f"S{i}: "), signed_seconds(r[f"delta{i}"])) for i in (1, 2, 3)))
    return F.array_join(F.transform(mine, line), "\n")


def without_repeat(reply: Column) -> Column:
    """A reply up to where it begins its block of data for the second time."""
    return F.when(F.regexp_count(reply, F.lit(BLOCK)) < 2, reply).otherwise(F.rtrim(F.substring_index(reply, BLOCK, 2)))


def by_session(laps: DataFrame, columns: list[str]) -> DataFrame:
    """session_id and rows: its laps as an array in order of time; one for each driver, so a field of them."""
    return laps.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("lap_time", "driver", *columns))).alias("rows"))
