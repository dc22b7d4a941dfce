"""Exact quantiles by counting, without holding the values anywhere.

``percentile`` keeps a map of every distinct value in one task. Here each pass is a grouped count: values
fall into at most a few thousand ordered cells, each with its count, minimum and maximum. The cell that
holds a wanted rank either gives the value at once (one distinct value, or the rank is its first or
last) or becomes the interval of the next pass. A sketch chooses the first intervals; it only saves
passes, the counts decide. Two or three scans of the needed columns answer all quantiles of all columns.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qualframe.functions.columns import as_number, micros, resolve, usable
from qualframe.types import is_time

CELLS = 1024
SKETCH_ACCURACY = 1000
# Columns per pass; a pass reads its own columns only.
BATCH = 12
_LARGEST = 1.7976931348623157e308


@dataclass
class _Wanted:
    """One column's order statistics: rank (from 0) to value."""

    ranks: set[int] = field(default_factory=set)
    found: dict[int, float] = field(default_factory=dict)

    def open_ranks(self) -> list[int]:
        return sorted(self.ranks - self.found.keys())


def _number(df: DataFrame, name: str) -> Column:
    c, dtype = resolve(df.schema, name)
    if isinstance(dtype, T.StringType):
        return usable(as_number(c, dtype), T.DoubleType())
    return as_number(usable(c, dtype), dtype)


def _mean(df: DataFrame, name: str) -> Column:
    c, dtype = resolve(df.schema, name)
    if is_time(dtype):  # a sum of whole microseconds is exact at any size
        return (F.sum(micros(c).cast("decimal(38,0)")) / F.count(c)).cast("double")
    return F.avg(_number(df, name))


def _finite(bound: float) -> float:
    return max(-_LARGEST, min(_LARGEST, bound))


def _merge(intervals: Sequence[tuple[float, float]]) -> list[tuple[float, float]]:
    """Disjoint, ordered and finite; an infinite value then falls into a stretch of its own kind."""
    merged: list[tuple[float, float]] = []
    for low, high in sorted((_finite(low), _finite(high)) for low, high in intervals):
        if merged and low <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
        else:
            merged.append((low, high))
    return merged


def _table(rows: Sequence[Sequence[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in rows])


def _keys(c: Column, v: Column, spans: Sequence[Sequence[tuple[float, float]]]) -> Column:
    """Ordered group key of a value of column number ``c``.

    Inside an interval it is one of CELLS cells, of which the two bounds never share one; every stretch
    between intervals is one group. Bounds are looked up in constant arrays, so the generated code stays
    equally short for any number of columns.
    """
    width = max(len(row) for row in spans)
    # Nothing but NaN, which is left out before, reaches a NaN bound.
    padded = [list(row) + [(math.nan, math.nan)] * (width - len(row)) for row in spans]
    # Halving keeps the span of two huge bounds finite; elsewhere nothing is scaled, to lose no tiny value.
    halves = [[0.5 if math.isinf(hi - lo) else 1.0 for lo, hi in row] for row in padded]
    lows = F.get(_table([[lo for lo, _ in row] for row in padded]), c)
    highs = F.get(_table([[hi for _, hi in row] for row in padded]), c)
    scales = F.get(_table(halves), c)
    widths = F.get(_table([[(hi * s - lo * s) or 1.0 for (lo, hi), s in zip(row, half)]
                           for row, half in zip(padded, halves)]), c)
    place = F.lit(0)
    for i in range(width):
        place = place + (v >= F.get(lows, F.lit(i))).cast("int")
    at = F.greatest(place - 1, F.lit(0))
    scale = F.get(scales, at)
    share = (v * scale - F.get(lows, at) * scale) / F.get(widths, at)
    cell = F.least(F.floor(share * F.lit(float(CELLS))), F.lit(CELLS - 1).cast("bigint"))
    inside = at.cast("bigint") * (CELLS + 1) + 1 + cell
    stretch = place.cast("bigint") * (CELLS + 1)
    return F.when((place > 0) & (v <= F.get(highs, at)), inside).otherwise(stretch)


def _count_cells(df: DataFrame, intervals: Mapping[str, Sequence[tuple[float, float]]]) -> dict[str, list]:
    """Per column, its cells in order as (rows, minimum, maximum); the number of groups is bounded by the request."""
    names = list(intervals)
    values = F.array(*[F.struct(F.lit(i).alias("c"), _number(df, name).alias("v")) for i, name in enumerate(names)])
    long = df.select(F.explode(values).alias("s")).select("s.*").where(F.col("v").isNotNull())
    key = _keys(F.col("c"), F.col("v"), [intervals[name] for name in names])
    counted = long.groupBy("c", key.alias("k")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    out: dict[str, list] = {name: [] for name in intervals}
    for row in sorted(counted.collect(), key=lambda r: r.k):
        out[names[row.c]].append((row.n, row.lo, row.hi))
    return out


def _settle(wanted: _Wanted, cells: Sequence[tuple[int, float, float]]) -> list[tuple[float, float]]:
    """Read off what the counts decide; return the cells that need another pass."""
    ranks, narrower, start = wanted.open_ranks(), [], 0
    for n, low, high in cells:
        for rank in [r for r in ranks if start <= r < start + n]:
            if low == high or rank == start:
                wanted.found[rank] = low
            elif rank == start + n - 1:
                wanted.found[rank] = high
            else:
                narrower.append((low, high))
        start += n
    return narrower


def order_statistics(df: DataFrame, ranks: Mapping[str, Sequence[int]],
                     first: Mapping[str, Sequence[tuple[float, float]]]) -> dict[str, dict[int, float]]:
    """The values at the given ranks (from 0, nulls and NaN left out) of several columns at once."""
    wanted = {name: _Wanted(set(places)) for name, places in ranks.items()}
    intervals = {name: _merge(spans) for name, spans in first.items() if wanted[name].ranks}
    while intervals:
        counted = _count_cells(df, intervals)
        intervals = {}
        for name, cells in counted.items():
            narrower = _settle(wanted[name], cells)
            if narrower:
                intervals[name] = _merge(narrower)
    return {name: target.found for name, target in wanted.items()}


@dataclass(frozen=True)
class ColumnRange:
    """Count, minimum and maximum of the usable values, the quantiles asked for, and moments where asked for."""

    count: int
    low: float | None
    high: float | None
    quantiles: dict[float, float | None]
    mean: float | None = None
    std: float | None = None


def exact_quantiles(df: DataFrame, wanted: Mapping[str, Sequence[float]], moments: bool = False) -> dict[str, ColumnRange]:
    """Linearly interpolated quantiles of numeric or time columns (time in microseconds since 1970).

    Nulls and NaN are left out. ``moments`` adds mean and deviation to the first pass. The result is a handful of
    numbers and belongs on the driver, where it sets bin edges and thresholds of later jobs.
    """
    names, found = list(wanted), {}
    for i in range(0, len(names), BATCH):
        found.update(_batch_quantiles(df, {name: wanted[name] for name in names[i:i + BATCH]}, moments))
    return found


def _batch_quantiles(df: DataFrame, wanted: Mapping[str, Sequence[float]], moments: bool) -> dict[str, ColumnRange]:
    slack = 2.0 / SKETCH_ACCURACY
    aggregates = []
    for i, (name, probabilities) in enumerate(wanted.items()):
        v = _number(df, name)
        aggregates += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
        if moments:
            aggregates += [_mean(df, name).alias(f"mean{i}"), F.stddev_samp(v).alias(f"std{i}")]
        edges = [min(1.0, max(0.0, p + s)) for p in probabilities for s in (-slack, slack)]
        if edges:
            aggregates.append(F.percentile_approx(v, edges, SKETCH_ACCURACY).alias(f"q{i}"))
    row = df.agg(*aggregates).first()

    ranks: dict[str, list[int]] = {}
    first: dict[str, list[tuple[float, float]]] = {}
    for i, (name, probabilities) in enumerate(wanted.items()):
        n = row[f"n{i}"]
        places = {place for p in probabilities if n for place in _places(p, n)[:2]}
        ranks[name] = sorted(places)
        sketch = row[f"q{i}"] if probabilities else None
        first[name] = list(zip(sketch[::2], sketch[1::2])) if sketch else []
    values = order_statistics(df, ranks, first)

    out = {}
    for i, (name, probabilities) in enumerate(wanted.items()):
        n = row[f"n{i}"]
        found = {p: _interpolate(values[name], p, n) if n else None for p in probabilities}
        mean, std = (row[f"mean{i}"], row[f"std{i}"]) if moments else (None, None)
        out[name] = ColumnRange(n, row[f"lo{i}"], row[f"hi{i}"], found, mean, std)
    return out


def _places(p: float, n: int) -> tuple[int, int, float]:
    place = p * (n - 1)
    below = math.floor(place)
    return below, min(below + 1, n - 1), place - below


def _interpolate(values: Mapping[int, float], p: float, n: int) -> float:
    below, above, share = _places(p, n)
    return values[below] + (values[above] - values[below]) * share if share else values[below]


def approximate_quantiles(df: DataFrame, wanted: Mapping[str, Sequence[float]], accuracy: int = 10_000) -> dict[str, ColumnRange]:
    """One scan, a sketch per column: ranks are off by at most ``rows / accuracy``."""
    aggregates = []
    for i, (name, probabilities) in enumerate(wanted.items()):
        v = _number(df, name)
        aggregates += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"),
                       F.avg(v).alias(f"mean{i}"), F.stddev_samp(v).alias(f"std{i}"),
                       F.percentile_approx(v, list(probabilities), accuracy).alias(f"q{i}")]
    row = df.agg(*aggregates).first()
    return {
        name: ColumnRange(row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"],
                          dict(zip(probabilities, row[f"q{i}"] or [None] * len(probabilities))),
                          row[f"mean{i}"], row[f"std{i}"])
        for i, (name, probabilities) in enumerate(wanted.items())
    }
