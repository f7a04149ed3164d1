"""Penalised change points of daily series: PELT with whole costs, so that every tie is kept.

A segment of ``n`` days with sum ``S`` and sum of squares ``Q`` costs ``n * floor(1000 * ln(V))``,
``V = 1 + floor((n * Q - S * S) / (n * n))``; every cut costs ``penalty`` more.  ``F(t)`` is the least
cost of the first ``t`` days, and a start ``s`` may be forgotten once it can't be best again.

Without the floors a segment never costs less than its two parts, for ln(1 + x) is concave and the
spread of the whole is at least the mean of its parts' spreads.  The floors lose a bounded part of
that.  Of a segment of ``n`` days with variance ``x`` the parts cost ``1000 n ln(1 + x)`` at most, and
``V > x``, so the whole costs more than ``n * (1000 ln(V) - 1)``: the loss is below
``n * (1000 ln((V + 1) / V) + 1)``.  A segment that begins at ``s`` has ``m = days - s`` days at most, and
its squared deviations are at least those of its beginning, ``W``; so ``V >= 1`` and ``V > W / n``, and as
``n ln(1 + min(1, n / W))`` grows with ``n`` the loss is below

    loss(s, t) = m * (1000 ln(1 + min(1, m / W)) + 1) + 1,

the last 1 for rounding in doubles.  If ``F(s) + C(s, t) - loss(s, t) > F(t)``, then cutting at ``t`` is
strictly better than any segment from ``s`` that ends ``least`` days or more behind ``t``; earlier ends
still need ``s``.  So ``s`` becomes a candidate ``least`` days behind itself and leaves ``least`` days
behind the ``t`` that refuted it.  The inequality is strict, so what ties stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, shuffle_width

LEAST = 14
PENALTY = 40_000
#: Days of series that a task solves together; longer series are solved alone.
TOGETHER = 200_000

_NEVER = np.iinfo("i8").max


def spreads(n: np.ndarray, total: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """V of segments, in whole numbers."""
    return 1 + (n * squares - total * total) // (n * n)


def costs(n: np.ndarray, spread: np.ndarray) -> np.ndarray:
    return n * np.floor(1000 * np.log(spread.astype("f8"))).astype("i8")


def prefix_sums(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each series' prefix sums begin, the sums and the sums of squares, a zero before each series.

    They are Python's unbounded integers where 64 bits might not hold ``n * Q`` or ``S * S``.
    """
    base = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    most = int(np.abs(values).max(initial=0)) * int(sizes.max(initial=1))
    kind = "i8" if most < 3_000_000_000 else object
    spaced = np.zeros(int((sizes + 1).sum()), kind)
    at = np.arange(len(values)) + np.repeat(np.arange(len(sizes)) + 1, sizes)
    spaced[at] = values
    total = np.add.accumulate(spaced)
    # of a run of series only differences inside one series are taken; they are exact in either kind
    return base, total, np.add.accumulate(spaced * spaced)


def solve(values: np.ndarray, sizes: np.ndarray, least: int = LEAST, penalty: int = PENALTY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments of several series that lie one behind another: (series, start, best cost of the series),
    ordered by series and start.  Of equal sums the fewest segments win, then the earliest start of the
    last segment, then of the one before it, and so on.

    All series take a step of one day together.  Candidates lie in flat arrays, ordered by series and start.
    """
    base, total, squares = prefix_sums(values, sizes)
    best = np.full(len(total), _NEVER, "i8")
    pieces = np.zeros(len(total), "i8")
    back = np.zeros(len(total), "i8")
    best[base] = -penalty
    who, start, gone = (np.zeros(0, "i8") for _ in range(3))
    # series shorter than two segments are one; they take a single step, at their end
    whole = np.flatnonzero(sizes < 2 * least)
    if len(whole):
        end, n = base[whole] + sizes[whole], sizes[whole]
        best[end] = costs(n, spreads(n, total[end] - total[base[whole]], squares[end] - squares[base[whole]]))
        pieces[end] = 1
    open_ = np.flatnonzero(sizes >= 2 * least)
    for t in range(least, int(sizes.max(initial=0)) + 1 if len(open_) else 0):
        open_ = open_[sizes[open_] >= t]
        stay = (gone > t) & (sizes[who] >= t)
        if not stay.all():
            who, start, gone = who[stay], start[stay], gone[stay]
        s = t - least
        if s == 0 or s >= least:
            ends = np.searchsorted(who, open_, side="right")
            who, start, gone = np.insert(who, ends, open_), np.insert(start, ends, s), np.insert(gone, ends, _NEVER)
        at, end = base[who] + start, base[who] + t
        n, squared = t - start, squares[end] - squares[at]
        summed = total[end] - total[at]
        cost = costs(n, spreads(n, summed, squared))
        sums = best[at] + cost + penalty
        first = np.flatnonzero(np.diff(who, prepend=-1))
        size = np.diff(first, append=len(who))
        least_sum = np.minimum.reduceat(sums, first)
        ties = np.where(sums == np.repeat(least_sum, size), pieces[at], _NEVER)
        fewest = np.minimum.reduceat(ties, first)
        earliest = np.minimum.reduceat(np.where(ties == np.repeat(fewest, size), start, _NEVER), first)
        now = base[open_] + t
        best[now], pieces[now], back[now] = least_sum, fewest + 1, earliest
        deviations = (squared - summed * summed / n).astype("f8") * (1 - 1e-9)
        left = (sizes[who] - start).astype("f8")
        loss = left * (1000 * np.log1p(np.minimum(1.0, left / np.maximum(deviations, 1e-9))) + 1) + 1
        refuted = sums - penalty - loss > np.repeat(least_sum, size)
        gone[refuted] = np.minimum(gone[refuted], t + least)
    # follow the starts back from the ends, all series a segment at a time
    series, starts = [], []
    todo, t = np.flatnonzero(sizes > 0), sizes[sizes > 0].copy()
    while len(todo):
        t = back[base[todo] + t]
        series.append(todo)
        starts.append(t)
        todo, t = todo[t > 0], t[t > 0]
    series, starts = np.concatenate(series or [np.zeros(0, "i8")]), np.concatenate(starts or [np.zeros(0, "i8")])
    order = np.lexsort((starts, series))
    return series[order], starts[order], best[base + sizes][series[order]]


_OUT = ["segment_no", "first_day", "n_days", "total", "spread", "cost", "n_segments", "best_cost"]


def _segments(keys: pa.Array, days: np.ndarray, sums: np.ndarray, least: int, penalty: int) -> Iterator[pa.RecordBatch]:
    """Segments of whole series, given as rows ordered by key and day; ``keys`` are run-end encoded."""
    ends = keys.run_ends.to_numpy()
    begins = np.concatenate([[0], ends[:-1]])
    spans = days[ends - 1] - days[begins] + 1
    part = 0
    while part < len(ends):
        # series go together until their days are too many
        upto = max(part + 1, int(np.searchsorted(np.cumsum(spans[part:]), TOGETHER, side="right")) + part)
        lo, hi, sizes = begins[part], ends[upto - 1], spans[part:upto]
        offset = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        values = np.zeros(int(sizes.sum()), "i8")
        values[days[lo:hi] - np.repeat(days[begins[part:upto]], ends[part:upto] - begins[part:upto]) + np.repeat(offset, ends[part:upto] - begins[part:upto])] = sums[lo:hi]
        series, start, best = solve(values, sizes, least, penalty)
        first = np.flatnonzero(np.diff(series, prepend=-1))
        count = np.diff(first, append=len(series))
        end = np.where(np.append(np.diff(series) != 0, True), sizes[series], np.append(start[1:], 0))
        base, total, squares = prefix_sums(values, sizes)
        n, a, b = end - start, base[series] + start, base[series] + end
        summed = total[b] - total[a]
        spread = spreads(n, summed, squares[b] - squares[a])
        no = np.arange(len(series)) - np.repeat(first, count) + 1
        columns = [no.astype("i4"), days[begins[part:upto]][series] + start, n, summed, spread, costs(n, spread), np.repeat(count, count), best]
        arrays = [pa.array(no.astype("i4")), *(pa.array(c.astype("i8")) for c in columns[1:])]
        yield pa.RecordBatch.from_arrays([keys.values.slice(part, upto - part).take(pa.array(series)), *arrays], ["key", *_OUT])
        part = upto


def change_points(rows: DataFrame, key: str, at: str, value: str, least: int = LEAST, penalty: int = PENALTY) -> DataFrame:
    """One row per segment of the daily series of each ``key``: ``key, segment_no, first_day, n_days, total,
    spread, cost, n_segments, best_cost``.

    A series is the sum of the whole number ``value`` per day of the date or timestamp ``at``, from the
    key's first to its last day; days without rows count 0.  Rows without ``at`` or ``value`` are left
    out, repeated rows count each time, rows with a null key are a series of their own, and a key without
    any rows left has no segment.  A series shorter than two segments is one segment.  An empty table gives
    no rows; other columns are neither read nor returned, whatever their names.

    Rows are summed by key and day before they are shuffled, so a key with many rows is no larger than
    its days; a task reads its keys in order and holds about ``TOGETHER`` days, or one longer series.  A
    series in which nothing changes is compared with all its starts, which is quadratic in its days.
    """
    day = F.unix_date(F.col(at).cast("date")).cast("long")
    taken = rows.where(F.col(at).isNotNull() & F.col(value).isNotNull())
    days = taken.groupBy(F.col(key).alias("key"), day.alias("day")).agg(F.sum(F.col(value).cast("long")).alias("n"))
    width = shuffle_width(rows.sparkSession)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        waiting = 0

        def solved(done: pa.Table) -> Iterator[pa.RecordBatch]:
            if len(done):
                runs = pc.run_end_encode(done["key"].combine_chunks())
                yield from _segments(runs, done["day"].to_numpy(), done["n"].to_numpy(), least, penalty)

        for b in batches:
            if not len(b):
                continue
            held.append(b)
            waiting += len(b)
            # the last key of what is here may go on in the next batch
            if waiting >= TOGETHER and not held[0]["key"][0].equals(b["key"][-1]):
                have = pa.Table.from_batches(held)
                last = pc.run_end_encode(have["key"].combine_chunks()).run_ends
                cut = last[-2].as_py()
                yield from solved(have.slice(0, cut))
                held, waiting = have.slice(cut).to_batches(), len(have) - cut
        if held:
            yield from solved(pa.Table.from_batches(held))

    kind = dict(days.dtypes)["key"]
    schema = f"key {kind}, segment_no int, " + ", ".join(f"{c} long" for c in _OUT[1:])
    out = days.repartition(width, "key").sortWithinPartitions("key", "day").mapInArrow(run, schema)
    return out.withColumnRenamed("key", key)
