"""What people look at before they trust a column: counts, categories, ranges, outliers, summaries."""

from __future__ import annotations

import math
from functools import reduce
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qualframe.functions.columns import as_number, dates_as_times, micros, micros_text, ref, resolve, usable
from qualframe.operators.ordering import rank_groups
from qualframe.operators.quantiles import ColumnRange, approximate_quantiles, exact_quantiles
from qualframe.operators.uniqueness import typed_slots
from qualframe.types import is_fraction, is_time

# A column with fewer distinct values is a category; quantiles of the robust range and of time.
CATEGORY_LIMIT = 30
# Relative standard error of the sketch of distinct values.
SKETCH_ERROR = 0.05
ROBUST = (0.001, 0.5, 0.999)
TIME_PERCENTILES = (0.01, 0.25, 0.5, 0.77, 0.99)
QUARTILES = (0.25, 0.5, 0.75)
# Columns per profiling aggregate.
WIDTH = 24


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value; null is a value, and all NaN are one."""
    return df.groupBy(resolve(df.schema, column)[0].alias("value")).agg(F.count("*").alias("count"))


def _value_text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("None"))


def category_table(df: DataFrame, column: str, numeric: bool | None = None) -> DataFrame:
    """Rank, value as text, count and percentage; ordered by value if numeric, else by falling count.

    The counts are written once; total and ranks are read from them, not from the data.
    """
    if numeric is None:
        numeric = isinstance(resolve(df.schema, column)[1], T.NumericType)
    by_value = F.col("value").asc_nulls_last()
    order = [by_value] if numeric else [F.col("count").desc(), by_value]
    ranked = rank_groups(value_counts(df, column), order)
    total = ranked.agg(F.sum("count")).scalar()
    return ranked.select(
        F.col("index"), _value_text(F.col("value")).alias("value"), F.col("count"),
        (F.col("count") / total * F.lit(100.0)).alias("percent"),
    )


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact number of distinct values of each column (null counts as one): one shuffle of distinct values."""
    cells = F.array(*[F.struct(F.lit(name).alias("column"), *typed_slots(*resolve(df.schema, name))) for name in columns])
    long = df.select(F.explode(cells).alias("s")).select("s.*")
    return long.distinct().groupBy("column").agg(F.count("*").alias("distinct"))


def categorical_columns(df: DataFrame, columns: Sequence[str], limit: int = CATEGORY_LIMIT,
                        estimates: Mapping[str, int] | None = None, margin: float | None = 4) -> dict[str, int]:
    """Columns with fewer than ``limit`` distinct values, with their exact number.

    A sketch (or the ``estimates`` of an earlier one) sorts out columns whose estimate is ``margin`` times the limit or more, so the
    exact count only ever shuffles columns with few values. The sketch's standard error is ``SKETCH_ERROR``: with the margin of 4 a
    column below the limit would have to be estimated 60 standard errors too high to be missed. ``margin=None`` counts every column.
    """
    if not columns:
        return {}
    if estimates is None and margin is not None:
        row = df.agg(*[
            F.approx_count_distinct(resolve(df.schema, name)[0], SKETCH_ERROR).alias(f"c{i}") for i, name in enumerate(columns)
        ]).first()
        estimates = {name: row[f"c{i}"] for i, name in enumerate(columns)}
    few = [name for name in columns if margin is None or estimates[name] < margin * limit]
    if not few:
        return {}
    exact = {row["column"]: row["distinct"] for row in distinct_counts(df, few).collect()}
    return {name: exact.get(name, 0) for name in few if exact.get(name, 0) < limit}


def robust_ranges(df: DataFrame, columns: Sequence[str], quantiles: Sequence[float] = ROBUST,
                  approximate: bool = False, moments: bool = False) -> dict[str, ColumnRange]:
    """Quantiles of several columns in one go: low, median and high of the robust range unless others are asked for."""
    wanted = {name: list(quantiles) for name in columns}
    return approximate_quantiles(df, wanted) if approximate else exact_quantiles(df, wanted, moments)


def rounded(value: float | None) -> float | None:
    """To the nearest whole number, halves to the even one."""
    if value is None or not math.isfinite(value):
        return value
    return float(round(value))


def numeric_bounds(df: DataFrame, column: str) -> DataFrame:
    """One row: usable values, low (0.1 %), median, high (99.9 %), the first and last as whole numbers."""
    found = robust_ranges(df, [column])[column]
    low, middle, high = (found.quantiles[q] for q in ROBUST)
    return df.sparkSession.createDataFrame(
        [(column, found.count, rounded(low), middle, rounded(high))],
        "column string, count bigint, low double, median double, high double")


def outliers(df: DataFrame, column: str, low: float, high: float, n: int = 10) -> DataFrame:
    """The ``n`` smallest values below ``low`` and the ``n`` largest from ``high`` on.

    Without any value below ``low`` the low side shows ``low`` itself ``n`` times.
    """
    c, dtype = resolve(df.schema, column)
    v = as_number(c, dtype)
    values = df.select(v.alias("value"))
    # Plain comparisons reach the file scan, where whole row groups without an outlier are skipped. A limited
    # sort is a top-n per task and one merge of n rows per task. NaN sorts above all and is left out.
    below = [row.value for row in values.where(v < F.lit(low)).orderBy("value").limit(n).collect()] or [float(low)] * n
    high_end = values.where(v >= F.lit(high))
    if is_fraction(dtype):
        high_end = high_end.where(~F.isnan("value"))
    above = [row.value for row in high_end.orderBy(F.desc("value")).limit(n).collect()]
    rows = [("low", i + 1, x) for i, x in enumerate(below)] + [("high", i + 1, x) for i, x in enumerate(above)]
    return df.sparkSession.createDataFrame(rows, "side string, rank bigint, value double")


def time_rows(found: ColumnRange, percentiles: Sequence[float]) -> list[tuple[str, float | None]]:
    """Statistics of a time column from its quantiles and moments, in microseconds."""
    day = 86_400_000_000
    stats: list[tuple[str, float | int | None]] = [("count", found.count)]
    if found.count:
        low = int(found.quantiles[percentiles[0]] // day * day)
        high = int(-(-found.quantiles[percentiles[-1]] // day) * day)
        stats += [("mean", found.mean), ("min", found.low)]
        stats += [(f"{round(p * 100)}%", found.quantiles[p]) for p in percentiles]
        stats += [("max", found.high), ("range_low", low), ("range_high", high), ("bins", (high - low) // day)]
    return [(name, None if value is None else float(value)) for name, value in stats]


def time_summary(df: DataFrame, column: str, percentiles: Sequence[float] = TIME_PERCENTILES) -> DataFrame:
    """Statistics of a time column (a date counts as its midnight) as (statistic, microseconds, text), the day range and its days."""
    df = dates_as_times(df, column)
    found = exact_quantiles(df, {column: list(percentiles)}, moments=True)[column]
    frame = df.sparkSession.createDataFrame(time_rows(found, percentiles), "statistic string, value double")
    counted = F.col("statistic").isin("count", "bins")
    return frame.withColumn("text", F.when(~counted, micros_text(F.floor(F.col("value")))))


def describe_numeric(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Count, mean, sample standard deviation, minimum, quartiles and maximum per column."""
    found = robust_ranges(df, list(columns), QUARTILES, approximate, moments=True)
    rows = []
    for name in columns:
        r = found[name]
        rows.append((name, r.count, r.mean, r.std, r.low, *[r.quantiles[q] for q in QUARTILES], r.high))
    return df.sparkSession.createDataFrame(
        rows, "column string, count bigint, mean double, std double, min double, "
              "`25%` double, `50%` double, `75%` double, max double")


def describe_text(df: DataFrame, column: str) -> DataFrame:
    """Count, number of distinct values, the most frequent value (ties: the first in order) and its count."""
    counts = value_counts(df, column).where(F.col("value").isNotNull())
    first = F.min(F.struct((-F.col("count")).alias("n"), F.col("value").alias("v")))
    return counts.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("count"), F.count("*").alias("unique"), first.alias("_f"),
    ).select(
        F.lit(column).alias("column"), "count", "unique", F.col("_f.v").cast("string").alias("top"),
        (-F.col("_f.n")).alias("freq"),
    )


def duration(df: DataFrame, start: str, end: str, name: str = "duration", seconds: bool = True) -> DataFrame:
    """Add the difference of two columns: seconds between two times, else a plain difference."""
    (a, type_a), (b, type_b) = resolve(df.schema, start), resolve(df.schema, end)
    if is_time(type_a) and is_time(type_b):
        difference = micros(b) - micros(a)
        return df.withColumn(name, difference / F.lit(1e6) if seconds else difference)
    return df.withColumn(name, b - a)


def column_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Of every column: rows, nulls, NaN, estimated distinct values, least and greatest value.

    One aggregate for up to ``WIDTH`` columns; a wide table takes several, each reading its own columns.
    """
    columns = list(columns or df.columns)
    parts = [columns[i:i + WIDTH] for i in range(0, len(columns), WIDTH)]
    return reduce(DataFrame.unionByName, [_profile_batch(df, part) for part in parts])


def _profile_batch(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    aggregates, rows = [F.count(F.lit(1)).alias("rows")], []
    for i, name in enumerate(columns):
        c, dtype = resolve(df.schema, name)
        nan = F.count_if(F.isnan(c)) if is_fraction(dtype) else F.count_if(F.lit(False))
        ordered = not isinstance(dtype, (T.MapType, T.ArrayType, T.StructType, T.BinaryType))
        v = usable(c, dtype) if ordered else F.lit(None).cast("string")
        aggregates += [
            F.count_if(c.isNull()).alias(f"nulls{i}"), nan.alias(f"nan{i}"), F.approx_count_distinct(v).alias(f"d{i}"),
            F.min(v).cast("string").alias(f"lo{i}"), F.max(v).cast("string").alias(f"hi{i}"),
        ]
        rows.append(F.struct(
            F.lit(name).alias("column"), F.lit(dtype.simpleString()).alias("type"), F.col("rows"),
            F.col(f"nulls{i}").alias("nulls"), F.col(f"nan{i}").alias("nan"), F.col(f"d{i}").alias("distinct_estimate"),
            F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"),
        ))
    return df.agg(*aggregates).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def kind_of(dtype: T.DataType, categorical: bool) -> str:
    """Which profile a column gets: ``time``, ``category`` or ``number``."""
    if is_time(dtype) or isinstance(dtype, T.DateType):
        return "time"
    if categorical or not isinstance(dtype, T.NumericType):
        return "category"
    return "number"


def kinds(df: DataFrame, flags: Mapping[str, bool | None] | None = None,
          estimates: Mapping[str, int] | None = None) -> dict[str, str]:
    """The kind of every column: by its flag where one is set, else by its type and number of distinct values."""
    flags = flags or {}
    open_columns = [f.name for f in df.schema.fields
                    if flags.get(f.name) is None and isinstance(f.dataType, T.AtomicType) and not is_time(f.dataType)]
    few = categorical_columns(df, open_columns, estimates=estimates)
    return {
        f.name: kind_of(f.dataType, bool(flags.get(f.name)) or f.name in few) for f in df.schema.fields
        if isinstance(f.dataType, T.AtomicType)
    }
