"""Exact order statistics of few series, counted in the tasks.

A round draws a bounded sample of every open interval, proposes a value on either side of each wanted rank, and counts in
one pass how many values lie below, at and between the proposed ones: a task adds up its batches and sends a number
for each cell. Intervals with few enough values left are counted by value in the tasks, then ordered by Spark. The
driver holds the ranks and at most `SAMPLE_VALUES` sampled values; a sample only proposes, so the result is exact.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Values sampled in a round, and of one interval: they decide on the number of rounds, not on the result.
SAMPLE_VALUES, INTERVAL_SAMPLE = 1_500_000, 50_000
#: So many values, of all intervals together, are ordered when no smaller bound is asked for.
GATHERED_VALUES = 4_000_000
#: Standard deviations between a rank's place in a sample and the proposed values.
MARGIN = 4.0


@dataclass(frozen=True)
class Rank:
    """A wanted rank, from 0, of a series, and the open interval that holds it (None: no bound): so many of the
    series' values lie at or below its lower end, so many inside."""

    group: int
    feature: int
    rank: int
    inside: int
    below: int = 0
    low: float | None = None
    high: float | None = None
    value: float | None = None

    @property
    def interval(self) -> tuple:
        return self.group, self.feature, self.low, self.high


def find_ranks(rows: DataFrame, wanted: Sequence[Rank], order_rows: int | None = None) -> list[Rank]:
    """`wanted` with their values. `rows` has `_g`, the group's number, and the columns `_x0`, `_x1` ...; nulls are skipped.

    Intervals of at most `order_rows` values are ordered (None: of `GATHERED_VALUES` in all).
    """
    state, turn = list(wanted), 0
    while True:
        left = [r for r in state if r.value is None]
        most = GATHERED_VALUES // max(len({r.interval for r in left}), 1) if order_rows is None else order_rows
        wide = [r for r in left if r.inside > most]
        if not wide:
            break
        done = [r for r in state if r.value is not None or r.inside <= most]
        state, turn = done + _located(rows, _proposed(rows, wide, turn)), turn + 1
    return [r for r in state if r.value is not None] + _ordered(rows, left)


def _within(x: np.ndarray, low: float | None, high: float | None) -> np.ndarray:
    if low is not None:
        x = x[x > low]
    return x if high is None else x[x < high]


def _series(batch: pa.RecordBatch, asked: Mapping[int, Mapping]) -> Iterator[tuple[np.ndarray, object]]:
    """The values of every asked series of a batch, without nulls, and what was asked of it. A minus zero is a zero."""
    group = batch["_g"].to_numpy()
    if not len(group):
        return
    order = np.argsort(group, kind="stable")
    columns: dict[int, np.ndarray] = {}
    for part in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
        for feature, what in asked.get(int(group[part[0]]), {}).items():
            if feature not in columns:
                columns[feature] = batch[f"_x{feature}"].to_numpy(zero_copy_only=False)
            x = columns[feature]
            x = x if len(part) == len(x) else x[part]
            yield x[~np.isnan(x)] + 0.0, what


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))


def _asked(items: Sequence[tuple[int, int, object]]) -> dict[int, dict[int, list]]:
    out: dict[int, dict[int, list]] = defaultdict(dict)
    for group, feature, what in items:
        out[group].setdefault(feature, []).append(what)
    return dict(out)


def _columns(rows: DataFrame, asked: Mapping[int, Mapping]) -> DataFrame:
    return rows.select("_g", *[f"_x{f}" for f in sorted({f for of in asked.values() for f in of})])


def _samples(rows: DataFrame, intervals: Sequence[Rank], turn: int) -> dict[int, np.ndarray]:
    """Sorted sampled values by the interval's number."""
    size = min(INTERVAL_SAMPLE, SAMPLE_VALUES // len(intervals))
    # Rows that no interval needs stay out of the Python workers.
    most = min(1.0, max(size / r.inside for r in intervals))
    asked = _asked([(r.group, r.feature, (i, r.low, r.high, size / r.inside / most)) for i, r in enumerate(intervals)])
    seen = _columns(rows, asked)
    seen = seen.sample(most, turn) if most < 1 else seen

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([turn, TaskContext.get().partitionId()])
        kept = defaultdict(list)
        for batch in batches:
            for x, wishes in _series(batch, asked):
                for i, low, high, share in wishes:
                    y = _within(x, low, high)
                    if share < 1 and len(y):
                        y = y[rng.integers(len(y), size=rng.binomial(len(y), share))]
                    kept[i].append(y)
        yield _batch(at=np.array(list(kept), np.int32), x=pa.array([np.concatenate(v).tobytes() for v in kept.values()], pa.binary()))

    found = defaultdict(list)
    for r in seen.mapInArrow(run, "at int, x binary").collect():
        found[r["at"]].append(np.frombuffer(r["x"]))
    return {i: np.sort(np.concatenate(parts)) for i, parts in found.items()}


def _proposed(rows: DataFrame, ranks: Sequence[Rank], turn: int) -> list[tuple[Rank, float | None, float | None]]:
    """Each rank with two values of its interval, one on either side as far as the sample knows (None: no value).

    Ranks next to each other get the same two.
    """
    intervals = list({r.interval: r for r in ranks}.values())
    number = {r.interval: i for i, r in enumerate(intervals)}
    samples = _samples(rows, intervals, turn)
    runs: list[list[Rank]] = []
    for r in sorted(ranks, key=lambda r: (number[r.interval], r.rank)):
        if runs and runs[-1][-1].interval == r.interval and r.rank <= runs[-1][-1].rank + 1:
            runs[-1].append(r)
        else:
            runs.append([r])
    out = []
    for run in runs:
        x = samples.get(number[run[0].interval], np.zeros(0))
        n = len(x)
        ends = []
        for r, side in ((run[0], -1), (run[-1], 1)):
            share = (r.rank - r.below) / r.inside
            ends.append(int(share * n + side * (MARGIN * (n * share * (1 - share)) ** 0.5 + 2)))
        a = float(x[ends[0]]) if 0 <= ends[0] < n else None
        b = float(x[ends[1]]) if 0 <= ends[1] < n else None
        if a is None and b is None and n:
            a = float(x[n // 2])
        out += [(r, a, b) for r in run]
    return out


def _located(rows: DataFrame, proposed: Sequence[tuple[Rank, float | None, float | None]]) -> list[Rank]:
    """Each rank at one of its two values, or in the open interval before, between or behind them."""
    bounds: dict[tuple[int, int], set] = defaultdict(set)
    for r, a, b in proposed:
        bounds[r.group, r.feature] |= {v for v in (a, b) if v is not None}
    bounds = {s: np.array(sorted(v)) for s, v in bounds.items() if v}
    number = {s: i for i, s in enumerate(bounds)}
    asked = _asked([(*s, (number[s], v)) for s, v in bounds.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[int, np.ndarray] = {}
        for batch in batches:
            for x, wishes in _series(batch, asked):
                for i, at in wishes:
                    place = np.searchsorted(at, x)
                    # Even cells lie between two values, odd ones are a value.
                    cell = 2 * place + (np.append(at, np.nan)[place] == x)
                    cells[i] = cells.get(i, 0) + np.bincount(cell, minlength=2 * len(at) + 1)
        for i, n in cells.items():
            cell = np.flatnonzero(n)
            yield _batch(series=np.full(len(cell), i, np.int32), cell=cell.astype(np.int32), n=n[cell])

    below = {s: np.zeros(2 * len(v) + 2, np.int64) for s, v in bounds.items()}
    names = list(bounds)
    if bounds:
        counted = _columns(rows, asked).mapInArrow(run, "series int, cell int, n bigint")
        for c in counted.groupBy("series", "cell").agg(F.sum("n").alias("n")).collect():
            below[names[c["series"]]][c["cell"] + 1] = c["n"]
    below = {s: np.cumsum(n) for s, n in below.items()}

    out = []
    for r, a, b in proposed:
        at = (r.group, r.feature)
        for v in sorted({v for v in (a, b) if v is not None}):
            i = 2 * int(np.searchsorted(bounds[at], v)) + 1
            before, upto = int(below[at][i]), int(below[at][i + 1])
            if r.rank < before:
                r = replace(r, high=v, inside=before - r.below)
                break
            if r.rank < upto:
                r = replace(r, value=v)
                break
            r = replace(r, low=v, below=upto, inside=r.inside - (upto - r.below))
        out.append(r)
    return out


def _ordered(rows: DataFrame, ranks: Sequence[Rank]) -> list[Rank]:
    """The values of ranks whose intervals hold few values: counted by value, then ordered."""
    if not ranks:
        return []
    intervals = list({r.interval: r for r in ranks}.values())
    number = {r.interval: i for i, r in enumerate(intervals)}
    asked = _asked([(r.group, r.feature, (i, r.low, r.high)) for i, r in enumerate(intervals)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, wishes in _series(batch, asked):
                for i, low, high in wishes:
                    value, n = np.unique(_within(x, low, high), return_counts=True)
                    if len(value):
                        yield _batch(at=np.full(len(n), i, np.int32), x=value, n=n)

    counted = _columns(rows, asked).mapInArrow(run, "at int, x double, n bigint").groupBy("at", "x").agg(F.sum("n").alias("n"))
    summed = counted.withColumn("upto", F.sum("n").over(Window.partitionBy("at").orderBy("x")))
    places = rows.sparkSession.createDataFrame(
        [(i, number[r.interval], r.rank - r.below) for i, r in enumerate(ranks)], "of int, at int, place bigint"
    )
    hit = summed.join(F.broadcast(places), "at").where("upto > place").groupBy("of").agg(F.min("x").alias("x"))
    found = {r["of"]: r["x"] for r in hit.collect()}
    return [replace(r, value=found[i]) for i, r in enumerate(ranks)]
