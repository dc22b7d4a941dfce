"""Profile a whole table: every column gets the statistics its kind calls for.

``whole_profile`` makes the pages of all columns together. Values to count, bins and outliers of every column are rows of one long form, so the number
of scans does not grow with the width of the table: the summary, the exact number of values where there are few, the quantiles (two or three more), and one each
for categories, histograms and outliers. Groups are bounded per column, and outliers are cut to a few per task before they are shuffled.
Only text with many values is a job of its own, since all its values are listed.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qualframe.document import TableSpec
from qualframe.functions.columns import as_number, dates_as_times, resolve
from qualframe.operators.binning import Axis, DEFAULT_BINS, hist1d
from qualframe.operators.profile import (
    CATEGORY_LIMIT, QUARTILES, ROBUST, TIME_PERCENTILES, category_table, column_profile, kinds, outliers, rounded, time_rows, time_summary,
)
from qualframe.operators.quantiles import ColumnRange, exact_quantiles
from qualframe.types import is_fraction

# Outliers on each side, and columns in one long form.
OUTLIERS, WIDTH = 10, 24
PAGE_DDL = "column string, part string, place bigint, label string, value double, n bigint"

SUMMARY_DDL = (
    "column string, type string, rows bigint, nulls bigint, nan bigint, distinct_estimate bigint, min string, max string"
)


@dataclass
class TableProfile:
    """``summary`` covers every column; the rest is per column and computed when it is looked at."""

    summary: DataFrame
    kinds: dict[str, str]
    ranges: dict[str, ColumnRange] = field(default_factory=dict)
    spec: TableSpec | None = None


def profile_table(df: DataFrame, spec: TableSpec | None = None, columns: Sequence[str] | None = None) -> TableProfile:
    """One aggregate for all columns, an exact distinct count of those with few values, and the quantiles of all
    numbers together; the summary is kept as the few rows it is, so looking at it again costs nothing.

    Columns found to be categories are flagged in the returned specification, unless it has a flag already.
    """
    if columns:
        df = df.select(*columns)
    flags = {f.raw_name: f.flag("is_categorical") for f in spec.fields} if spec else {}
    rows = column_profile(df).collect()
    summary = df.sparkSession.createDataFrame(rows, SUMMARY_DDL)
    found = kinds(df, flags, {row["column"]: row.distinct_estimate for row in rows})
    numbers = [name for name, kind in found.items() if kind == "number"]
    ranges = exact_quantiles(df, {name: sorted({*ROBUST, *QUARTILES}) for name in numbers}) if numbers else {}
    if spec:
        for name, kind in found.items():
            if kind == "category" and name in spec.columns and flags.get(name) is None:
                spec = spec.replace_field(spec.field(name).with_flags(is_categorical=True))
    return TableProfile(summary, found, ranges, spec)


def column_details(df: DataFrame, profile: TableProfile, column: str, bins: int = DEFAULT_BINS) -> dict[str, DataFrame]:
    """The tables behind one column's page: categories, time summary, or histogram and outliers."""
    kind = profile.kinds[column]
    if kind == "category":
        return {"categories": category_table(df, column)}
    if kind == "time":
        return {"summary": time_summary(df, column)}
    quantiles = profile.ranges[column].quantiles
    low, high = rounded(quantiles[ROBUST[0]]), rounded(quantiles[ROBUST[2]])
    if low is None:
        return {}
    details = {"outliers": outliers(df, column, low, high)}
    if low < high:
        details["histogram"] = hist1d(df, column, Axis(bins, low, high))
    return details


def _page(rows: DataFrame, part: str, place: Column, label: Column, value: Column, n: Column) -> DataFrame:
    return rows.select("column", F.lit(part).alias("part"), place.cast("bigint").alias("place"), label.cast("string").alias("label"),
                       value.cast("double").alias("value"), n.cast("bigint").alias("n"))


def _long(df: DataFrame, cells: dict[str, Column]) -> DataFrame:
    """One row per row and column: the column's name and the members of its struct. A wide table takes several such frames, each reading its own columns."""
    names, parts = list(cells), []
    for i in range(0, len(names), WIDTH):
        some = [F.struct(F.lit(name).alias("column"), cells[name].alias("s")) for name in names[i:i + WIDTH]]
        parts.append(df.select(F.explode(F.array(*some)).alias("c")).select("c.column", "c.s.*"))
    return reduce(DataFrame.unionByName, parts)


def category_pages(df: DataFrame, columns: Sequence[str], total: int) -> DataFrame:
    """Values, counts and percentages of columns with few values: all columns in one grouped count."""
    cells = {}
    for name in columns:
        c, dtype = resolve(df.schema, name)
        number = as_number(c, dtype) if isinstance(dtype, T.NumericType) else F.lit(None).cast("double")
        cells[name] = F.struct(c.cast("string").alias("v"), number.alias("x"), F.lit(isinstance(dtype, T.NumericType)).alias("numeric"))
    counted = _long(df, cells).groupBy("column", "v", "x", "numeric").agg(F.count("*").alias("n"))
    order = [F.when(F.col("numeric"), F.lit(0)).otherwise(-F.col("n")), F.col("x").asc_nulls_last(), F.col("v").asc_nulls_last()]
    ranked = counted.withColumn("place", F.row_number().over(Window.partitionBy("column").orderBy(*order)) - 1)  # few values a column
    return _page(ranked, "categories", F.col("place"), F.coalesce("v", F.lit("None")), F.col("n") / F.lit(total) * F.lit(100.0), F.col("n"))


def histogram_pages(df: DataFrame, axes: dict[str, Axis]) -> DataFrame:
    """Counts of every bin of every column, empty ones too."""
    cells = {name: F.struct(axis.bin_of(as_number(*resolve(df.schema, name))).alias("bin")) for name, axis in axes.items()}
    counted = _long(df, cells).where("bin IS NOT NULL").groupBy("column", "bin").agg(F.count("*").alias("n"))
    spine = df.sparkSession.createDataFrame([(name, axis.bins + 1) for name, axis in axes.items()], "column string, last int").select(
        "column", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last").cast("bigint"))).alias("bin"))
    filled = spine.join(counted, ["column", "bin"], "left")
    return _page(filled, "histogram", F.col("bin"), F.lit(None), F.lit(None), F.coalesce("n", F.lit(0)))


def outlier_pages(df: DataFrame, bounds: dict[str, tuple[float, float]], n: int = OUTLIERS) -> DataFrame:
    """The ``n`` least values below and the ``n`` greatest from the upper bound on, of every column; without any below, the lower bound ``n`` times."""
    cells, odd = {}, F.lit(False)
    for name, (low, high) in bounds.items():
        c, dtype = resolve(df.schema, name)
        v = as_number(c, dtype)
        above = (v >= F.lit(high)) & ~F.isnan(v) if is_fraction(dtype) else v >= F.lit(high)
        cells[name] = F.struct(F.when(v < F.lit(low), "low").when(above, "high").alias("side"), v.alias("v"))
        odd = odd | F.coalesce((v < F.lit(low)) | above, F.lit(False))
    rows = _long(df.where(odd), cells).where("side IS NOT NULL")
    order = F.when(F.col("side") == "low", F.col("v")).otherwise(-F.col("v"))
    kept = rows.withColumn("place", F.row_number().over(Window.partitionBy("column", "side").orderBy(order))).where(F.col("place") <= n)
    found = _page(kept, "outliers", F.col("place"), F.col("side"), F.col("v"), F.lit(None))
    lows = df.sparkSession.createDataFrame([(name, float(low)) for name, (low, _) in bounds.items()], "column string, low double")
    none = lows.join(kept.where("side = 'low'").select("column"), "column", "left_anti").withColumn("place", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return found.unionByName(_page(none, "outliers", F.col("place"), F.lit("low"), F.col("low"), F.lit(None)))


def whole_profile(df: DataFrame, spec: TableSpec | None = None, bins: int = DEFAULT_BINS) -> DataFrame:
    """The pages of all columns in one frame: ``column, part, place, label, value, n``.

    ``categories`` list values by place (label, percentage, rows), ``histogram`` the rows of each bin, ``outliers`` values by place and side, ``summary``
    the statistics of a time column by label.
    """
    profile = profile_table(df, spec)
    rows = profile.summary.select("rows").first()
    if rows is None:
        return df.sparkSession.createDataFrame([], PAGE_DDL)
    estimates = {row["column"]: row.distinct_estimate for row in profile.summary.collect()}
    by_kind = lambda kind: [name for name, k in profile.kinds.items() if k == kind]
    few = [name for name in by_kind("category") if estimates[name] < 4 * CATEGORY_LIMIT]
    parts = []
    if few:
        parts.append(category_pages(df, few, rows.rows))
    for name in set(by_kind("category")) - set(few):
        table = category_table(df, name).withColumn("column", F.lit(name))
        parts.append(_page(table, "categories", F.col("index"), F.col("value"), F.col("percent"), F.col("count")))
    ends = {name: profile.ranges[name].quantiles for name in by_kind("number")}
    bounds = {name: (rounded(q[ROBUST[0]]), rounded(q[ROBUST[2]])) for name, q in ends.items() if q[ROBUST[0]] is not None}
    axes = {name: Axis(bins, low, high) for name, (low, high) in bounds.items() if low < high}
    if axes:
        parts.append(histogram_pages(df, axes))
    if bounds:
        parts.append(outlier_pages(df, bounds))
    times = by_kind("time")
    if times:
        found = exact_quantiles(dates_as_times(df, *times), {name: list(TIME_PERCENTILES) for name in times}, moments=True)
        stats = [(name, label, value) for name in times for label, value in time_rows(found[name], TIME_PERCENTILES)]
        parts.append(_page(df.sparkSession.createDataFrame(stats, "column string, label string, value double"), "summary", F.lit(0), F.col("label"), F.col("value"), F.lit(None)))
    return reduce(DataFrame.unionByName, parts) if parts else df.sparkSession.createDataFrame([], PAGE_DDL)
