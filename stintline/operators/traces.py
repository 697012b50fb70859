"""Traces: the samples of a lap as arrays in its row, and what Arrow kernels find in them.

Telemetry is a row for each sample, or, packed, a row for each lap with arrays of one length. What is found within a
lap then needs no shuffle and no sort of samples: laps of equally many samples are the rows of a matrix. Comparisons
are Spark's: NaN equals itself and lies above all numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Share of a lap's speeds that a minimum must not lie above.
SLOW = 0.6


def is_packed(telemetry: DataFrame, column: str = "distance") -> bool:
    return isinstance(telemetry.schema[column].dataType, T.ArrayType)


def packed(telemetry: DataFrame) -> DataFrame:
    """lap_id, distance and speed, arrays of the lap's samples; packed telemetry as it is."""
    if is_packed(telemetry):
        return telemetry
    samples = telemetry.groupBy("lap_id").agg(F.collect_list(F.struct("distance", "speed")).alias("_t"))
    return samples.select("lap_id", F.col("_t.distance").alias("distance"), F.col("_t.speed").alias("speed"))


def unpacked(traces: DataFrame) -> DataFrame:
    """lap_id, distance and speed, a row for each sample."""
    rows = traces.select("lap_id", F.explode(F.arrays_zip("distance", "speed")).alias("_t"))
    return rows.select("lap_id", "_t.distance", "_t.speed")


def traced(telemetry: DataFrame, laps: DataFrame) -> DataFrame:
    """laps with lap_id, distance and speed. Packed telemetry that holds the laps' own columns joins nothing."""
    if is_packed(telemetry) and "is_valid" in telemetry.columns:
        return telemetry
    return packed(telemetry).select("lap_id", "distance", "speed").join(laps.withColumnRenamed("id", "lap_id"), "lap_id")


def _floats(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, values and known of a list column; unknown values are NaN."""
    values = lists.flatten()
    known = np.asarray(values.is_valid()) if values.null_count else np.ones(len(values), bool)
    sizes = np.asarray(lists.value_lengths().fill_null(0))
    return np.concatenate(([0], np.cumsum(sizes))).astype(np.int64), values.cast(pa.float64()).to_numpy(zero_copy_only=False), known


def _by_size(sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each size of a list with the rows of that size."""
    for n in np.unique(sizes):
        if n:
            yield int(n), np.flatnonzero(sizes == n)


def _lists(sizes: np.ndarray, columns: dict[str, pa.Array]) -> pa.ListArray:
    """Lists of structs of the sizes given, from their columns laid end to end."""
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(list(columns.values()), names=list(columns)))


def _above(x: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(x), np.inf, x)


def _usable(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the laps' traces, distances and speeds, of samples of which both are known."""
    starts, d, there = _floats(batch.column("distance"))
    _, s, known = _floats(batch.column("speed"))
    both = there & known
    row = np.repeat(np.arange(batch.num_rows), np.diff(starts))[both]
    return np.bincount(row, minlength=batch.num_rows), d[both], s[both]


def _minima(sizes: np.ndarray, d: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, distance and speed of the local minima, by row and distance."""
    starts = np.concatenate(([0], np.cumsum(sizes)))
    out = []
    for n, rows in _by_size(sizes):
        at = starts[rows][:, None] + np.arange(n)
        x, v = d[at], s[at]
        if not (x[:, 1:] > x[:, :-1]).all():
            order = np.lexsort((v, x), axis=-1)
            x, v = np.take_along_axis(x, order, 1), np.take_along_axis(v, order, 1)
        high = _above(v)
        ranked, place = np.sort(high, axis=1), (n - 1) * SLOW
        low, up = int(np.floor(place)), int(np.ceil(place))
        slow = ranked[:, low] if low == up else (up - place) * ranked[:, low] + (place - low) * ranked[:, up]
        mid = high[:, 1:-1]
        r, c = np.nonzero((mid <= high[:, :-2]) & (mid < high[:, 2:]) & (mid <= slow[:, None]))
        out.append((rows[r], x[r, c + 1], v[r, c + 1]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    row, x, v = map(np.concatenate, zip(*out, strict=True))
    order = np.argsort(row, kind="stable")
    return row[order], x[order], v[order]


def minima(traces: DataFrame) -> DataFrame:
    """lap_id, distance and speed of points not faster than the one before, slower than the next, and within the
    slowest 60 % of their lap; the first and the last point of a lap are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, x, v = _minima(*_usable(batch))
            found = _lists(np.bincount(row, minlength=batch.num_rows), {"distance": pa.array(x), "speed": pa.array(v)})
            yield pa.RecordBatch.from_arrays([batch.column("lap_id"), found], names=["lap_id", "m"])

    laps = traces.select("lap_id", F.col("distance").cast("array<double>").alias("distance"), F.col("speed").cast("array<double>").alias("speed"))
    kinds = f"lap_id {laps.schema['lap_id'].dataType.simpleString()}, m array<struct<distance: double, speed: double>>"
    return laps.mapInArrow(run, kinds).select("lap_id", F.explode("m").alias("m")).select("lap_id", "m.distance", "m.speed")


def _nearest(row: np.ndarray, x: np.ndarray, v: np.ndarray, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, corner and speed of the slowest minimum of each row at each corner in reach."""
    starts, place, _ = _floats(batch.column("place"))
    _, number, _ = _floats(batch.column("number"))
    _, reach, _ = _floats(batch.column("reach"))
    sizes, out = np.diff(starts), []
    for n, rows in _by_size(sizes[row]):  # of the minima, those whose map has n corners
        first, where = starts[row[rows]], x[rows]
        best, away = np.zeros(len(rows), np.int64), _above(np.abs(where - place[first]))
        for k in range(1, n):  # the map is by number: the lower one on ties
            there = np.abs(where - place[first + k])
            best = np.where(there < away, k, best)
            away = np.fmin(there, away)
        best += first
        near = away <= reach[best]
        out.append((row[rows][near], number[best][near].astype(np.int64), v[rows][near]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    row, corner, v = map(np.concatenate, zip(*out, strict=True))
    if not ((row[1:] > row[:-1]) | ((row[1:] == row[:-1]) & (corner[1:] >= corner[:-1]))).all():
        order = np.lexsort((corner, row))
        row, corner, v = row[order], corner[order], v[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (corner[1:] != corner[:-1])
    return row[first], corner[first], np.minimum.reduceat(v, np.flatnonzero(first)) if len(v) else v


def _mapped(held: DataFrame, *keys: str) -> DataFrame:
    return held.select(*keys, *(F.col(c).cast("array<double>").alias(c) for c in ("distance", "speed")), "place", "number", "reach")


def slowest_at_corners(held: DataFrame, *keys: str) -> DataFrame:
    """keys, corner_number and speed: the slowest minimum of each lap at each corner, from rows with distance, speed
    and the map of their circuit: place, number and reach, arrays of its corners by number."""
    rows = _mapped(held, *keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, corner, v = _nearest(*_minima(*_usable(batch)), batch)
            found = _lists(np.bincount(row, minlength=batch.num_rows), {"corner_number": pa.array(corner.astype(np.int32)), "speed": pa.array(v)})
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), found], names=[*keys, "x"])

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    found = rows.mapInArrow(run, f"{kinds}, x array<struct<corner_number: int, speed: double>>")
    return found.select(*keys, F.explode("x").alias("x")).select(*keys, "x.corner_number", "x.speed")


def sums_at_corners(held: DataFrame, *keys: str) -> DataFrame:
    """keys, corner_number, total and n: sums and numbers of slowest_at_corners() within each Arrow batch, to be added
    up by key, so that no row is made for each corner of each lap."""
    rows = _mapped(held, *keys)
    by = [*keys, "corner_number"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, corner, v = _nearest(*_minima(*_usable(batch)), batch)
            found = pa.table({k: batch.column(k).take(pa.array(row)) for k in keys} | {"corner_number": corner.astype(np.int32), "speed": v})
            sums = found.group_by(by, use_threads=False).aggregate([("speed", "sum"), ("speed", "count")])
            yield from sums.select([*by, "speed_sum", "speed_count"]).rename_columns([*by, "total", "n"]).combine_chunks().to_batches()

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInArrow(run, f"{kinds}, corner_number int, total double, n long")


def _filled(v: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Unknown values of each row as the last known one before, else the first one after; NaN if none is known."""
    n = v.shape[1]
    last = np.maximum.accumulate(np.where(known, np.arange(n), -1), axis=1)
    first = np.where(known.any(axis=1), known.argmax(axis=1), -1)[:, None]
    at = np.where(last >= 0, last, first)
    return np.where(at >= 0, np.take_along_axis(v, np.maximum(at, 0), 1), np.nan)


def resampled(trace: DataFrame, columns: dict[str, str], key: str, order: str, distance: str, step: float) -> DataFrame:
    """cleaning.resample() of packed traces: order, distance and the source columns are arrays."""
    there = {c: n for c, n in columns.items() if c in trace.columns}
    rows = trace.select(key, F.col(order).cast("array<double>").alias("_o"), F.col(distance).cast("array<double>").alias("_d"), *(F.col(c).cast("array<double>").alias(n) for c, n in there.items()))

    def laid(sizes, o, d, values):
        """Row, distance and columns on the grid of each row's trace."""
        starts = np.concatenate(([0], np.cumsum(sizes)))
        for n, at_rows in _by_size(sizes):
            if n < 2:
                continue
            at = starts[at_rows][:, None] + np.arange(n)
            if not (o[at][:, 1:] > o[at][:, :-1]).all():
                at = np.take_along_axis(at, np.argsort(_above(o[at]), axis=1, kind="stable"), 1)
            x = d[at]
            ceiled = np.maximum(0, np.ceil(x / step)).astype(np.int64)
            end = ceiled[:, -1:]
            begin = np.concatenate((np.zeros_like(end), ceiled[:, 1:]), axis=1)
            stop = np.concatenate((np.minimum(ceiled[:, 1:], end), end), axis=1)  # the last sample holds to the end
            count = np.where(x[:, -1:] > 0, np.maximum(0, stop - begin), 0)
            flat = count.ravel()
            place = np.repeat(np.arange(flat.size), flat)
            grid = (begin.ravel()[place] + np.arange(place.size) - np.repeat(np.cumsum(flat) - flat, flat)) * step
            ahead = np.concatenate((x[:, 1:], x[:, -1:]), axis=1).ravel()[place]
            here, tail = x.ravel()[place], place % n == n - 1
            with np.errstate(divide="ignore", invalid="ignore"):
                share = np.where((grid <= here) | tail, 0.0, (grid - here) / (ahead - here))
            found = {}
            for name, (v, known) in values.items():
                full = _filled(v[at], known[at])
                then = np.concatenate((full[:, 1:], full[:, -1:]), axis=1)
                found[name] = full.ravel()[place] + share * (then.ravel()[place] - full.ravel()[place])
            yield at_rows[place // n], grid, found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, d, at_place = _floats(batch.column("_d"))
            _, o, _ = _floats(batch.column("_o"))
            there_d = at_place & ~np.isnan(d)
            row = np.repeat(np.arange(batch.num_rows), np.diff(starts))[there_d]
            values = {}
            for name in there.values():
                _, v, known = _floats(batch.column(name))
                values[name] = v[there_d], (known & ~np.isnan(v))[there_d]
            parts = list(laid(np.bincount(row, minlength=batch.num_rows), o[there_d], d[there_d], values))
            row = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
            back = np.argsort(row, kind="stable")
            out = {"distance": pa.array((np.concatenate([p[1] for p in parts]) if parts else np.zeros(0))[back])}
            for name in columns.values():
                if name not in there.values():
                    out[name] = pa.array(np.zeros(len(row)), pa.int32() if name == "gear" else pa.float64())
                    continue
                v = (np.concatenate([p[2][name] for p in parts]) if parts else np.zeros(0))[back]
                lost = np.isnan(v)
                out[name] = pa.array(np.rint(np.where(lost, 0, v)).astype(np.int32), mask=lost) if name == "gear" else pa.array(v, mask=lost)
            found = _lists(np.bincount(row, minlength=batch.num_rows), out)
            yield pa.RecordBatch.from_arrays([batch.column(key), found], names=[key, "g"])

    fields = ", ".join(f"{n}: {'int' if n == 'gear' else 'double'}" for n in columns.values())
    on_grid = rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, g array<struct<distance: double, {fields}>>")
    return on_grid.select(key, F.explode("g").alias("g")).select(key, "g.distance", *(f"g.{n}" for n in columns.values()))
