"""Irregular readings onto an even grid, missing slots filled by iterative singular-spectrum imputation and marked."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOT_S = 300
#: So many missing slots in a row mean that the source was off; they are no part of the series.
OFF_SLOTS = 288
#: Window length, number of components kept and tolerance of the imputation; what hasn't settled after MOST_ROUNDS is reported. Rounds that the next guess is drawn from.
WINDOW, RANK, TOLERANCE, MOST_ROUNDS, MEMORY = 24, 3, 1e-3, 20_000, 5

SERIES_SCHEMA = "source long, slot long, value double, filled boolean"
_ARROW = pa.schema([("source", pa.int64()), ("slot", pa.int64()), ("value", pa.float64()), ("filled", pa.bool_())])


def ssa_impute(x: np.ndarray, missing: np.ndarray, name: str = "a series") -> np.ndarray:
    """Fill the missing places of an even series: embed it as a Hankel trajectory matrix, keep its leading singular vectors,
    average the anti-diagonals, replace the missing places by the outcome, until a round moves none of them by TOLERANCE of the series' deviation.

    Rounds can be hundreds, so they are accelerated (Anderson): the next guess is drawn from the last MEMORY rounds, and a plain round is taken instead where that guess leaves more outside
    the leading vectors. Should MOST_ROUNDS not do, the last outcome is given with a warning that has ``name``.

    The first guess is linear interpolation, which is also the result for series too short to embed (under 8 slots) or constant."""
    n = len(x)
    place = np.arange(n)
    y = np.where(missing, 0.0, x)
    y[missing] = np.interp(place[missing], place[~missing], x[~missing])
    width = min(WINDOW, n // 2)
    scale = y.std()
    if width < 4 or not scale:
        return y
    mean = y.mean()
    y = y - mean
    counts = np.minimum(np.minimum(place + 1, n - place), min(width, n - width + 1)).astype(float)
    rank = min(RANK, width)

    def one_round(filled: np.ndarray) -> tuple[np.ndarray, float]:
        """The outcome for the missing places, and what the leading vectors leave out."""
        y[missing] = filled
        trajectory = np.lib.stride_tricks.sliding_window_view(y, width)
        values, vectors = np.linalg.eigh(trajectory.T @ trajectory)
        leading = vectors[:, -rank:]
        scores = trajectory @ leading
        back = sum(np.convolve(scores[:, k], leading[:, k]) for k in range(rank))
        return (back / counts)[missing], values[:-rank].sum()

    guess = y[missing]
    new, left_out = one_round(guess)
    outcomes: list[np.ndarray] = []  # changes of the last rounds' outcomes, and of their steps
    steps: list[np.ndarray] = []
    rounds = 1
    while np.abs(new - guess).max() >= TOLERANCE * scale:
        if rounds >= MOST_ROUNDS:
            warnings.warn(f"imputation of {name} hasn't settled after {rounds} rounds", RuntimeWarning, stacklevel=2)
            break
        following = new
        if steps:
            following = new - np.array(outcomes).T @ np.linalg.lstsq(np.array(steps).T, new - guess, rcond=1e-10)[0]
        newer, leaves_out = one_round(following)
        rounds += 1
        if steps and not leaves_out <= left_out:
            outcomes, steps, following = [], [], new
            newer, leaves_out = one_round(following)
            rounds += 1
        outcomes = [*outcomes, newer - new][-MEMORY:]
        steps = [*steps, (newer - following) - (new - guess)][-MEMORY:]
        guess, new, left_out = following, newer, leaves_out
    y[missing] = new
    return y + mean


def _grid(source: int, slot: np.ndarray, value: np.ndarray) -> list[tuple]:
    """The even grid of one series, without the stretches where it was off."""
    cut = np.flatnonzero(np.diff(slot) - 1 >= OFF_SLOTS) + 1
    out = []
    for s, v in zip(np.split(slot, cut), np.split(value, cut), strict=True):
        grid = np.arange(s[0], s[-1] + 1)
        missing = np.ones(len(grid), bool)
        missing[s - s[0]] = False
        x = np.full(len(grid), np.nan)
        x[s - s[0]] = v
        if missing.any():
            x = ssa_impute(x, missing, f"source {source}, slots {grid[0] * SLOT_S} to {grid[-1] * SLOT_S}")
        out.append((np.full(len(grid), source), grid * SLOT_S, x, missing))
    return out


def _series(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (source, slot) to grids; a series may reach over batches."""
    held: list[pa.RecordBatch] = []  # of the last source only

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        source, slot, value = (table.column(i).to_numpy() for i in range(3))
        edge = np.flatnonzero(source[1:] != source[:-1]) + 1
        out = []
        for a, b in zip(np.r_[0, edge], np.r_[edge, len(source)], strict=True):
            out += _grid(source[a], slot[a:b], value[a:b])
        columns = [np.concatenate(c) for c in zip(*out, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_ARROW)

    for batch in batches:
        if not batch.num_rows:
            continue
        source = batch.column(0).to_numpy()
        last = int(np.searchsorted(source, source[-1]))
        if held and (last or source[-1] != held[-1].column(0)[0].as_py()):
            yield from work(pa.Table.from_batches([*held, batch.slice(0, last)]))
            held = []
        elif last:
            yield from work(pa.Table.from_batches([batch.slice(0, last)]))
        held.append(batch.slice(last))
    if held:
        yield from work(pa.Table.from_batches(held))


def regular_series(readings: DataFrame, source: str, at_us: str, value: str) -> DataFrame:
    """``source, slot, value, filled``: per source one row for each slot of SLOT_S seconds (``slot`` in epoch seconds) from its first to its last reading.
    ``value`` is the mean of the slot's readings, or imputed (``filled``) where there is none; stretches of OFF_SLOTS or more slots without a reading
    are left out, and nothing is imputed across them.

    Readings are averaged per slot before they are shuffled, so a series has at most one row per SLOT_S seconds of the time it covers however many readings it has, and is imputed as a whole in one task:
    ten years are a million slots, some hundred MB while they are worked on. Rows with a null or NaN in any of the three columns are no readings. An empty table gives an empty result."""
    slots = (
        readings.select(F.col(source).cast("long").alias("source"), F.floor(F.col(at_us) / (SLOT_S * 1_000_000)).cast("long").alias("slot"), F.col(value).cast("double").alias("v"))
        .where("source is not null and slot is not null and v is not null and not isnan(v)")
        .groupBy("source", "slot").agg(F.avg("v").alias("v"))
    )
    return slots.repartition("source").sortWithinPartitions("source", "slot").mapInArrow(_series, SERIES_SCHEMA)
