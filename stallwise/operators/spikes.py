"""Readings that cannot be true, judged against how their source normally behaves.

Phase-space thresholding: a reading is a point of its deviation from the level around it, its first and its second
difference. For every source, robust half-axes from high quantiles span an ellipsoid; a point outside of it whose own
deviation is large is a spike, as is one beyond a bound that holds for all sources. Spikes are removed and the rest is
judged again, until a round finds none. Amounts of zero or less are impossible, and runs without any difference catch values that got stuck.

The readings are shuffled once, into one row with arrays for every listing (or slice of a hot one). A round is then two
map-only passes over these rows, vectorised over whole Arrow batches: one counts the sources' deviations on a fine grid,
the other holds the readings against the units that follow from the counts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import durable
from .sizes import broadcast_below
from .skew import micros, with_halo, with_slices

SIDE = 3  #: readings before and after that make the level around a reading; an excursion of up to two is brief
QUANTILE = 0.97  #: of a source's deviations and differences, to each side: the unit of the half-axes
LEAST = 0.0667  #: smallest unit, in logarithms
GRID = 0.0005  #: step of the grid on which deviations are counted, in logarithms
AXES = 3.0  #: half-axes of the ellipsoid in units
OWN = 2.5  #: units by which the deviation itself must exceed
BOUND = math.log(8)  #: a brief factor beyond this is impossible for any source
STUCK_CHANCE = 0.05  #: expected number of equally long runs in a source's readings, below which a run is stuck
STUCK_LEAST = 6
MOVES = 0.4  #: share of a source's readings in stock that must change the price for a run to be suspicious
HALO = 100  #: rows seen across the cuts of a hot listing: more than the longest run that can be needed for suspicion
ROWS_PER_SLICE = 50_000  #: readings of one listing in a row of arrays
MAX_SOURCES = 100_000  #: sources above which their units are joined by a shuffle

AXIS_NAMES = ("unit_up", "unit_down", "unit_1", "unit_2")
SERIES = "listing_id long, slice_no int, source long, fresh int, at_us array<long>, price array<double>, moving array<boolean>, own array<boolean>, spike array<boolean>"


class _Flat:
    """The readings of a batch of series one after the other, and the series each belongs to."""

    def __init__(self, batch: pa.RecordBatch):
        self.offsets = batch.column("at_us").offsets.to_numpy() - batch.column("at_us").offsets[0].as_py()
        self.row = np.repeat(np.arange(batch.num_rows), np.diff(self.offsets))
        self.values = {name: batch.column(name).flatten().to_numpy(zero_copy_only=False) for name in ("at_us", "price", "moving", "own", "spike")}

    def __getitem__(self, name: str) -> np.ndarray:
        return self.values[name]


def _neighbours(y: np.ndarray, row: np.ndarray, steps: range) -> np.ndarray:
    """The readings at the given distances, a column for each; NaN beyond the ends of a series."""
    out = np.full((len(y), len(steps)), np.nan)
    for column, step in enumerate(steps):
        here = slice(step, None) if step > 0 else slice(None, step)
        there = slice(None, -step) if step > 0 else slice(-step, None)
        same = row[here] == row[there]
        out[there, column] = np.where(same, y[here], np.nan)
    return out


def _medians(values: np.ndarray) -> np.ndarray:
    """Row-wise medians of what isn't NaN; NaN where nothing is."""
    ordered, n = np.sort(values, axis=1), (~np.isnan(values)).sum(axis=1)
    at = np.arange(len(values))
    return (ordered[at, np.maximum(n - 1, 0) // 2] + ordered[at, n // 2]) / 2


def _points(y: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each reading as a point: deviation to one side of the levels before and after, first and second difference; and
    whether it is a factor beyond the bound away from the level around it."""
    before, after = _neighbours(y, row, range(-SIDE, 0)), _neighbours(y, row, range(1, SIDE + 1))
    levels = np.stack([_medians(before), _medians(after)])
    with np.errstate(invalid="ignore"):
        up, down = y - levels.max(axis=0), levels.min(axis=0) - y
        u = np.where(up > 0, up, np.where(down > 0, -down, 0.0))
        beyond = np.abs(y - _medians(np.concatenate([before, after], axis=1))) > BOUND
    last, following = (np.where(np.isnan(v), y, v) for v in (before[:, -1], after[:, 0]))
    return u, y - last, following - 2 * y + last, beyond


def _series(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Readings in order become one row a listing and slice; a series may span batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in ("listing_id", "slice_no")])
        fresh = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        first = [batch.column(c)[0].as_py() for c in ("listing_id", "slice_no")]
        if held and first != [held[-1].column(c)[0].as_py() for c in ("listing_id", "slice_no")]:
            yield _gathered(held)
            held = []
        if len(fresh):
            yield _gathered([*held, batch.slice(0, int(fresh[-1]))])
            held = []
        last = batch.slice(int(fresh[-1]) if len(fresh) else 0)
        held.append(last)
    if held:
        yield _gathered(held)


def _gathered(pieces: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(pieces).combine_chunks().to_batches()[0]
    keys = np.stack([rows.column(c).to_numpy() for c in ("listing_id", "slice_no")])
    starts = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1])
    offsets = np.append(starts, rows.num_rows).astype(np.int32)
    source = np.maximum.reduceat(rows.column("merchant_id").to_numpy(), starts)
    listed = {name: rows.column(name) for name in ("at_us", "price", "moving", "own")} | {"spike": pa.array(np.zeros(rows.num_rows, dtype=bool))}
    columns = [pa.array(keys[0][starts]), pa.array(keys[1][starts].astype(np.int32)), pa.array(source), pa.array(np.zeros(len(starts), dtype=np.int32))]
    columns += [pa.ListArray.from_arrays(pa.array(offsets), values) for values in listed.values()]
    return pa.RecordBatch.from_arrays(columns, names=["listing_id", "slice_no", "source", "fresh", *listed])


def _over(batches: Iterator[pa.RecordBatch], work: Callable[[pa.RecordBatch, _Flat], pa.RecordBatch | None]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows and (made := work(batch, _Flat(batch))) is not None:
            yield made


def _counted(keys: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    found, n = np.unique(np.stack(keys), axis=1, return_counts=True) if len(keys[0]) else (np.zeros((len(keys), 0), dtype=np.int64), np.zeros(0, dtype=np.int64))
    return pa.RecordBatch.from_arrays([*map(pa.array, found.astype(np.int64)), pa.array(n.astype(np.int64))], names=names)


def _deviations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each source's readings in stock deviate by so many steps of the grid, on each axis."""

    def count(batch: pa.RecordBatch, flat: _Flat) -> pa.RecordBatch:
        alive = np.flatnonzero(~flat["spike"])
        u, d1, d2, _ = _points(np.log(flat["price"][alive]), flat.row[alive])
        ours = (flat["own"] & flat["moving"])[alive]
        source = batch.column("source").to_numpy()[flat.row[alive][ours]]
        sizes = [np.maximum(u, 0)[ours], np.maximum(-u, 0)[ours], np.abs(d1)[ours], np.abs(d2)[ours]]
        step = [np.where(s <= LEAST, 0, np.ceil(s / GRID)).astype(np.int64) for s in sizes]
        axis = np.repeat(np.arange(len(sizes)), len(source))
        return _counted([np.tile(source, len(sizes)), axis, np.concatenate(step)], ["source", "axis", "step", "n"])

    yield from _over(batches, count)


def _units(series: DataFrame) -> DataFrame:
    """A source's units, from its readings in stock; sources without any have none and take the smallest unit.

    The counts are summed map-side first; a source has at most as many steps as logarithms of prices span.
    """
    counts = series.mapInArrow(_deviations, "source long, axis long, step long, n long").groupBy("source", "axis", "step").agg(F.sum("n").alias("n"))
    axis = W.partitionBy("source", "axis")
    upto = F.sum("n").over(axis.orderBy("step").rowsBetween(W.unboundedPreceding, 0))
    reached = counts.withColumns({"upto": upto, "all": F.sum("n").over(axis)}).filter(F.col("upto") >= F.col("all") * QUANTILE)
    unit = [F.greatest(F.min(F.when(F.col("axis") == i, F.col("step"))) * GRID, F.lit(LEAST)).alias(name) for i, name in enumerate(AXIS_NAMES)]
    return reached.groupBy("source").agg(*unit)


def _with(series: DataFrame, by_source: DataFrame) -> DataFrame:
    """``series`` with what is known of their sources; each row is a whole series, so a shuffle may reorder them."""
    return series.join(broadcast_below(durable(by_source), MAX_SOURCES), "source", "left")


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The series with the readings marked that lie outside of their source's ellipsoid."""

    def judge(batch: pa.RecordBatch, flat: _Flat) -> pa.RecordBatch:
        alive = np.flatnonzero(~flat["spike"])
        row = flat.row[alive]
        u, d1, d2, beyond = _points(np.log(flat["price"][alive]), row)
        units = [np.nan_to_num(batch.column(name).to_numpy(zero_copy_only=False).astype(float), nan=LEAST)[row] for name in AXIS_NAMES]
        own_unit = np.where(u > 0, units[0], units[1])
        outside = ((u / own_unit) ** 2 + (d1 / units[2]) ** 2 + (d2 / units[3]) ** 2 > AXES**2) & (np.abs(u) > OWN * own_unit) | beyond
        spike = flat["spike"].copy()
        spike[alive[outside]] = True
        fresh = np.bincount(row[outside], minlength=batch.num_rows).astype(np.int32)
        kept = {name: batch.column(name) for name in ("listing_id", "slice_no", "source", "at_us", "price", "moving", "own")}
        columns = kept | {"fresh": pa.array(fresh), "spike": pa.ListArray.from_arrays(pa.array(flat.offsets.astype(np.int32)), pa.array(spike))}
        order = [part.split()[0] for part in SERIES.split(", ")]
        return pa.RecordBatch.from_arrays([columns[name] for name in order], names=order)

    yield from _over(batches, judge)


def _pairs(flat: _Flat) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the readings left, whether each and the one before are in stock, and whether the price moved."""
    alive = np.flatnonzero(~flat["spike"])
    row, price, moving = flat.row[alive], flat["price"][alive], flat["moving"][alive]
    joined = np.concatenate([[False], row[1:] == row[:-1]])[: len(alive)]
    pair = joined & moving & np.concatenate([[False], moving[:-1]])[: len(alive)]
    moved = ~joined | np.concatenate([[True], price[1:] != price[:-1]])[: len(alive)]
    return alive, pair, moved


def _moves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of neighbouring readings in stock by source and whether the price moved."""

    def count(batch: pa.RecordBatch, flat: _Flat) -> pa.RecordBatch:
        alive, pair, moved = _pairs(flat)
        ours = pair & flat["own"][alive]
        source = batch.column("source").to_numpy()[flat.row[alive][ours]]
        return _counted([source, moved[ours].astype(np.int64)], ["source", "moved", "n"])

    yield from _over(batches, count)


def _needed(series: DataFrame) -> DataFrame:
    """The length from which on a run without difference is stuck, for sources that move this often."""
    counts = series.mapInArrow(_moves, "source long, moved long, n long").groupBy("source")
    rates = counts.agg((F.sum(F.col("moved") * F.col("n")) / F.sum("n")).alias("rate"), F.sum("n").alias("pairs")).filter(F.col("rate") >= MOVES)
    still = F.log(F.greatest(1 - F.col("rate"), F.lit(0.02)))
    return rates.select("source", F.greatest(F.ceil(F.log(F.lit(STUCK_CHANCE) / F.col("pairs")) / still) + 1, F.lit(STUCK_LEAST)).alias("needed"))


def _faults(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spikes, and all readings but the first of runs in stock that are too long for their source."""

    def find(batch: pa.RecordBatch, flat: _Flat) -> pa.RecordBatch:
        alive, pair, moved = _pairs(flat)
        needed = np.nan_to_num(batch.column("needed").to_numpy(zero_copy_only=False).astype(float), nan=np.inf)[flat.row[alive]]
        starts = ~pair | moved
        run = np.cumsum(starts) - 1
        length = np.bincount(run)[run] if len(run) else run
        fault = flat["spike"].copy()
        fault[alive[flat["moving"][alive] & (length >= needed) & ~starts]] = True
        at = np.flatnonzero(fault & flat["own"])
        listing = batch.column("listing_id").to_numpy()[flat.row[at]]
        return pa.RecordBatch.from_arrays([pa.array(listing), pa.array(flat["at_us"][at]), pa.array(flat["price"][at])], names=["listing_id", "at_us", "price"])

    yield from _over(batches, find)


def impossible_readings(df: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Distinct ``snap_id`` of the readings whose price cannot be true.

    ``df`` has ``snap_id``, ``listing_id``, ``merchant_id``, ``price_kes``, ``in_stock``, ``last_checked_at`` and
    ``loaded_at``. A listing's series has one reading a time: of several the one loaded last, then the largest snap_id;
    every row with that reading's price is flagged with it. Without ``last_checked_at`` the time of loading stands in;
    rows with neither, or without listing, are only held against the bounds. Null prices are skipped; an unknown stock
    counts as in stock; a row without merchant belongs to its listing's. Repeated rows change nothing.
    """
    rows = df.select(
        "snap_id",
        "listing_id",
        "merchant_id",
        F.col("price_kes").cast("double").alias("price"),
        "in_stock",
        micros(F.coalesce("last_checked_at", "loaded_at")).alias("at_us"),
        micros(F.col("loaded_at")).alias("loaded_us"),
    ).filter(F.col("price").isNotNull())
    newest = F.struct(F.coalesce("loaded_us", F.lit(-(2**62))), F.col("snap_id"))
    readings = (
        rows.filter((F.col("price") > 0) & F.col("listing_id").isNotNull() & F.col("at_us").isNotNull())
        .groupBy("listing_id", "at_us")
        .agg(F.max_by(F.struct("price", "in_stock"), newest).alias("kept"), F.max("merchant_id").alias("merchant_id"))
        .select(
            "listing_id", "at_us", "kept.price", F.coalesce("kept.in_stock", F.lit(True)).alias("moving"), F.coalesce("merchant_id", F.lit(-1)).cast("long").alias("merchant_id")
        )
    )
    cut = with_halo(with_slices(readings, "listing_id", "at_us", rows_per_slice), "listing_id", "at_us", HALO)
    ordered = cut.select("listing_id", "slice_no", "merchant_id", "at_us", "price", "moving", "own").repartition("listing_id", "slice_no").sortWithinPartitions("listing_id", "slice_no", "at_us")
    series = durable(ordered.mapInArrow(_series, SERIES))
    while True:  # a round takes a reading out or is the last
        series = durable(_with(series, _units(series)).mapInArrow(_judged, SERIES))
        if series.filter("fresh > 0").isEmpty():
            break
    found = _with(series, _needed(series)).mapInArrow(_faults, "listing_id long, at_us long, price double")
    by_reading = rows.join(found, ["listing_id", "at_us", "price"], "left_semi").select("snap_id")
    return by_reading.unionByName(rows.filter(F.col("price") <= 0).select("snap_id")).distinct()
