"""Histograms and profiles: grouped counts over equal bins.

Bin 0 holds what lies below the range, bin n+1 what lies at or above its end (and NaN). Every result has as many rows
as the request has bins; a value or bin that fills a third of all rows is combined before the shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qualframe.functions.columns import as_number, dates_as_times, epoch_seconds, resolve, usable
from qualframe.operators.quantiles import exact_quantiles
from qualframe.types import is_time

DEFAULT_BINS = 40
PADDING = 0.05


@dataclass(frozen=True)
class Axis:
    """Equal bins over [low, high)."""

    bins: int
    low: float
    high: float

    def __post_init__(self):
        if self.bins < 1 or not self.low < self.high:
            raise ValueError(f"no bins between {self.low} and {self.high}")

    @property
    def width(self) -> float:
        return (self.high - self.low) / self.bins

    def bin_of(self, v: Column) -> Column:
        """Bin number; null only for null. NaN has no place on the axis and counts as overflow."""
        number = F.width_bucket(v, F.lit(float(self.low)), F.lit(float(self.high)), F.lit(self.bins).cast("bigint"))
        return F.when(v.isNotNull(), F.coalesce(number, F.lit(self.bins + 1).cast("bigint")))

    def edge(self, number: Column) -> Column:
        """Lower edge of a bin."""
        return F.lit(float(self.low)) + (number - 1) * F.lit(self.width)

    def centre(self, number: Column) -> Column:
        return F.lit(float(self.low)) + (number - F.lit(0.5)) * F.lit(self.width)

    def inside(self, v: Column) -> Column:
        return (v >= F.lit(float(self.low))) & (v < F.lit(float(self.high)))

    def spine(self, df: DataFrame, name: str = "bin") -> DataFrame:
        """Every bin number once."""
        return df.sparkSession.range(self.bins + 2).select(F.col("id").alias(name))


def number_column(df: DataFrame, column: str) -> Column:
    """The value binned: a double, or seconds since 1970 for time (a date counts as its midnight)."""
    c, dtype = resolve(df.schema, column)
    if isinstance(dtype, T.DateType):
        return epoch_seconds(c.cast("timestamp"))
    return epoch_seconds(c) if is_time(dtype) else as_number(c, dtype)


def make_axis(df: DataFrame, column: str, bins: int = DEFAULT_BINS, low: float | None = None,
              high: float | None = None, trim: float | None = None) -> Axis:
    """The range where the caller gives none: least to greatest value, 5 % wider on both sides if both bounds
    are open, or the quantiles ``trim`` and ``1 - trim``."""
    df = dates_as_times(df, column)
    c, dtype = resolve(df.schema, column)
    unit = 1e6 if is_time(dtype) else 1.0
    if trim is not None:
        found = exact_quantiles(df, {column: [trim, 1.0 - trim]})[column].quantiles
        return Axis(bins, found[trim] / unit, found[1.0 - trim] / unit)
    if low is None or high is None:
        v = as_number(usable(c, dtype), dtype) / F.lit(unit)
        row = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi")).first()
        pad = (row.hi - row.lo) * PADDING if low is None and high is None else 0.0
        low = row.lo - pad if low is None else low
        high = row.hi + pad if high is None else high
    return Axis(bins, low, high)


def hist1d(df: DataFrame, column: str, axis: Axis) -> DataFrame:
    """``bin, low_edge, count`` for every bin, empty ones too."""
    counted = df.select(axis.bin_of(number_column(df, column)).alias("bin")).where("bin IS NOT NULL")
    counted = counted.groupBy("bin").agg(F.count("*").alias("n"))
    return axis.spine(df).join(counted, "bin", "left").select(
        "bin", axis.edge(F.col("bin")).alias("low_edge"), F.coalesce("n", F.lit(0)).alias("count"))


def hist_weighted(df: DataFrame, column: str, weight: str, axis: Axis, label: str | None = None) -> DataFrame:
    """Sum of weights (and of their squares) per bin, with the label of a row in it.

    Rows with a null, NaN or infinite member are left out.
    """
    x, w = number_column(df, column), number_column(df, weight)
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    keep = finite(x) & finite(w)
    text = F.lit(None).cast("string")
    if label is not None:
        text, label_type = resolve(df.schema, label)
        keep = keep & (finite(text) if isinstance(label_type, T.FractionalType) else text.isNotNull())
    rows = df.where(keep).select(axis.bin_of(x).alias("bin"), w.alias("w"), text.cast("string").alias("label"))
    summed = rows.groupBy("bin").agg(
        F.sum("w").alias("s"), F.sum(F.col("w") * F.col("w")).alias("s2"), F.min("label").alias("label"))
    return axis.spine(df).join(summed, "bin", "left").select(
        "bin", "label", F.coalesce("s", F.lit(0.0)).alias("weight"), F.coalesce("s2", F.lit(0.0)).alias("weight2"))


def normalise(histogram: DataFrame, axis: Axis, total: float, content: str = "count") -> DataFrame:
    """Scale so that the bins in range add up to ``total``, then divide by the bin width."""
    in_range = F.when(F.col("bin").between(1, axis.bins), F.col(content))
    integral = histogram.agg(F.sum(in_range)).scalar()
    return histogram.withColumn(
        "density", F.col(content) * F.lit(float(total)) / F.nullif(integral, F.lit(0)) / F.lit(axis.width))


def hist_stats(df: DataFrame, column: str, axis: Axis) -> DataFrame:
    """Entries, those below and above the range, and the moments of those in range (kurtosis as excess)."""
    v = number_column(df, column)
    data = df.select(v.alias("v")).where(F.col("v").isNotNull())
    v = F.col("v")
    inside = F.when(axis.inside(v), v)
    return data.agg(
        F.count("*").alias("entries"), F.count_if(v < F.lit(float(axis.low))).alias("underflow"),
        F.count_if(v >= F.lit(float(axis.high))).alias("overflow"), F.count(inside).alias("in_range"),
        F.avg(inside).alias("mean"), F.stddev_pop(inside).alias("std"),
        F.skewness(inside).alias("skewness"), F.kurtosis(inside).alias("kurtosis"),
    )


def hist2d(df: DataFrame, x: str, y: str, x_axis: Axis, y_axis: Axis, weight: str | None = None) -> DataFrame:
    """Filled cells ``bin_x, bin_y`` with their content and, when weighted, the sum of squared weights."""
    w = number_column(df, weight) if weight else F.lit(1.0)
    rows = df.select(
        x_axis.bin_of(number_column(df, x)).alias("bin_x"), y_axis.bin_of(number_column(df, y)).alias("bin_y"), w.alias("w"))
    cells = rows.where("bin_x IS NOT NULL AND bin_y IS NOT NULL").groupBy("bin_x", "bin_y")
    if weight is None:
        return cells.agg(F.count("*").alias("count"))
    return cells.agg(F.count("*").alias("count"), F.sum("w").alias("weight"), F.sum(F.col("w") * F.col("w")).alias("weight2"))


def profile_x(df: DataFrame, x: str, y: str, axis: Axis) -> DataFrame:
    """Per bin of x: rows, mean of y and the error of the mean; rows with a null or NaN in either are left out."""
    (_, type_x), (_, type_y) = resolve(df.schema, x), resolve(df.schema, y)
    a, b = usable(number_column(df, x), T.DoubleType()), usable(number_column(df, y), T.DoubleType())
    rows = df.select(a.alias("x"), b.alias("y")).dropna().select(axis.bin_of(F.col("x")).alias("bin"), "y")
    binned = rows.groupBy("bin").agg(
        F.count("*").alias("n"), F.avg("y").alias("mean"), F.stddev_pop("y").alias("spread"))
    return axis.spine(df).join(binned, "bin", "left").select(
        "bin", F.coalesce("n", F.lit(0)).alias("count"), "mean", (F.col("spread") / F.sqrt("n")).alias("error"))


def quantile_axes(df: DataFrame, bins: Sequence[int], ranges: dict[str, tuple[float, float]]) -> list[Axis]:
    """Axes between two quantiles of each column, found together."""
    found = exact_quantiles(df, {name: list(pair) for name, pair in ranges.items()})
    return [Axis(n, found[name].quantiles[low], found[name].quantiles[high])
            for n, (name, (low, high)) in zip(bins, ranges.items())]


def density_xy(df: DataFrame, x: str, y: str, bins: tuple[int, int] = (30, 30),
               x_range: tuple[float, float] | None = None, y_range: tuple[float, float] | None = None,
               x_trim: tuple[float, float] = (0.001, 0.99), y_trim: tuple[float, float] = (0.001, 0.995)) -> DataFrame:
    """Two-dimensional density between given bounds, or between quantiles where none are given."""
    df, wanted = dates_as_times(df, x, y), {}
    if x_range is None:
        wanted[x] = x_trim
    if y_range is None:
        wanted[y] = y_trim
    axes = dict(zip(wanted, quantile_axes(df, [1] * len(wanted), wanted))) if wanted else {}
    unit = lambda name: 1e6 if is_time(resolve(df.schema, name)[1]) else 1.0
    low_x, high_x = x_range or (axes[x].low / unit(x), axes[x].high / unit(x))
    low_y, high_y = y_range or (axes[y].low / unit(y), axes[y].high / unit(y))
    return hist2d(df, x, y, Axis(bins[0], low_x, high_x), Axis(bins[1], low_y, high_y))
