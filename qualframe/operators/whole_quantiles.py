"""Quantiles of whole numbers and decimals without leaving their own arithmetic.

``operators.quantiles`` bisects the range of doubles, which hold 53 bits. Here keys are whole numbers of up to 38 digits: ``bigint`` values as
they are, decimals without their point, times in microseconds. The interval of each wanted rank is cut into ``CELLS`` equal cells of whole
numbers, all cells of all columns are counted in one grouped aggregate, and the cell that holds the rank is the next interval,
until it holds a single number. 1,024 cells take a 64-bit range in at most seven scans, 38 digits in thirteen; usually the first or last value of a
cell is the wanted one much earlier. The groups are bounded by columns x ranks x cells, whatever the data.
"""

from __future__ import annotations

import math
from decimal import Context, Decimal
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qualframe.document import DocumentError
from qualframe.functions.columns import micros, resolve
from qualframe.types import is_time

CELLS = 1024
_WIDE = "decimal(38,0)"
_EXACT = Context(prec=60)  # the usual context rounds to 28 digits


def whole_number(c: Column, dtype: T.DataType) -> Column:
    """An order-preserving whole number for a value: its digits without the decimal point."""
    if isinstance(dtype, T.DecimalType):
        return (F.regexp_replace(c.cast("string"), r"\.", "") if dtype.scale else c).cast(_WIDE)
    if is_time(dtype):
        return micros(c).cast(_WIDE)
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return c.cast(_WIDE)
    raise DocumentError(f"no whole numbers in a column of type {dtype.simpleString()}")


def _restored(n: int, dtype: T.DataType) -> int | Decimal:
    return Decimal(n).scaleb(-dtype.scale, _EXACT) if isinstance(dtype, T.DecimalType) else n


def _number(n: int) -> Column:
    return F.lit(Decimal(n)).cast(_WIDE)


Interval = tuple[int, int]


def _cut(intervals: Sequence[Interval]) -> list[tuple[int, int, int]]:
    """Disjoint intervals in order with the width of their cells. One that is too wide for a difference of 38 digits is cut at zero."""
    merged: list[Interval] = []
    for low, high in sorted(intervals):
        if merged and low <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
        else:
            merged.append((low, high))
    parts = [p for low, high in merged for p in ([(low, -1), (0, high)] if high - low >= 10 ** 38 else [(low, high)])]
    return [(low, high, -(-(high - low + 1) // CELLS)) for low, high in parts]


def _counted(df: DataFrame, asked: Mapping[str, Sequence[tuple[int, int, int]]]) -> dict[str, list[tuple[int, int, int]]]:
    """Per column, its cells in order as (rows, least, greatest). What lies between intervals is one cell each."""
    cells = []
    for i, (name, spans) in enumerate(asked.items()):
        c, dtype = resolve(df.schema, name)
        key = F.lit(0)
        for k, (low, high, width) in enumerate(spans):
            v = F.col(f"_v{i}")
            inside = (2 * k + 1) * (CELLS + 1) + F.call_function("div", v - _number(low), _number(width))
            key = F.when(v > _number(high), F.lit((2 * k + 2) * (CELLS + 1))).when(v >= _number(low), inside).otherwise(key)
        cells.append((whole_number(c, dtype).alias(f"_v{i}"), F.struct(F.lit(i).alias("c"), F.col(f"_v{i}").alias("v"), key.cast("bigint").alias("k"))))
    long = df.select(*[v for v, _ in cells]).select(F.explode(F.array(*[s for _, s in cells])).alias("s")).select("s.*").where("v IS NOT NULL")
    counted = long.groupBy("c", "k").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    names, out = list(asked), {name: [] for name in asked}
    for row in sorted(counted.collect(), key=lambda r: (r.c, r.k)):
        out[names[row.c]].append((row.n, int(row.lo), int(row.hi)))
    return out


def whole_order_statistics(df: DataFrame, ranks: Mapping[str, Sequence[int]], bounds: Mapping[str, Interval]) -> dict[str, dict[int, int]]:
    """The whole numbers at the given ranks (from 0, nulls left out) of several columns at once."""
    found: dict[str, dict[int, int]] = {name: {} for name in ranks}
    asked = {name: _cut([bounds[name]]) for name in ranks if ranks[name]}
    while asked:
        narrower: dict[str, list[tuple[int, int, int]]] = {}
        for name, cells in _counted(df, asked).items():
            start, spans = 0, []
            for n, low, high in cells:
                for rank in (r for r in set(ranks[name]) - found[name].keys() if start <= r < start + n):
                    if low == high or rank in (start, start + n - 1):
                        found[name][rank] = low if rank == start else high
                    else:
                        spans.append((low, high))
                start += n
            if spans:
                narrower[name] = _cut(spans)
        asked = narrower
    return found


def discrete_quantiles(df: DataFrame, wanted: Mapping[str, Sequence[float]]) -> dict[str, dict[float, int | Decimal | None]]:
    """Values of the columns themselves: the least one that at least the share ``p`` of the values does not exceed."""
    names = list(wanted)
    aggregates = []
    for i, name in enumerate(names):
        v = whole_number(*resolve(df.schema, name))
        aggregates += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
    row = df.agg(*aggregates).first()
    counts = {name: row[f"n{i}"] for i, name in enumerate(names)}
    ranks = {name: sorted({_rank(p, counts[name]) for p in wanted[name]}) if counts[name] else [] for name in names}
    bounds = {name: (int(row[f"lo{i}"]), int(row[f"hi{i}"])) for i, name in enumerate(names) if counts[name]}
    found = whole_order_statistics(df, ranks, bounds)
    return {name: {p: _restored(found[name][_rank(p, counts[name])], resolve(df.schema, name)[1]) if counts[name] else None for p in wanted[name]}
            for name in names}


def _rank(p: float, n: int) -> int:
    return max(1, n - math.floor(n - p * n)) - 1
