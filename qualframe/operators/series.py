"""Series of points (x, y) with optional errors, ready to be drawn."""

from __future__ import annotations

from functools import reduce
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualframe.functions.columns import ref
from qualframe.operators.binning import number_column
from qualframe.operators.ordering import with_index


def _broken(c: Column) -> Column:
    return c.isNull() | F.isnan(c)


def number_guard(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: rows in all, and rows a series over these columns cannot use (a null, NaN, or no number)."""
    broken = reduce(lambda a, b: a | b, [_broken(number_column(df, c)) for c in columns])
    return df.agg(F.count("*").alias("rows"), F.count_if(broken).alias("rejected"))


def clean_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as doubles, without the rows that ``number_guard`` counts as rejected."""
    numbers = df.select(*[number_column(df, c).alias(c) for c in columns])
    return numbers.where(reduce(lambda a, b: a & b, [~_broken(ref(c)) for c in columns]))


def common_index(df: DataFrame, y: str, x: str | None = None, ey: str | None = None, ex: str | None = None) -> DataFrame:
    """Drop rows that are null in a member of the series; with x and y alone only y is looked at."""
    errors = [c for c in (ey, ex) if c]
    return df.dropna(subset=[y, *([x] if x and errors else []), *errors])


def series(df: DataFrame, y: str, x: str | None = None, ey: str | None = None, ex: str | None = None,
           order: Sequence[str] = ()) -> DataFrame:
    """Points ``x, y, ex, ey`` as doubles; rows with a null or NaN are left out.

    Without ``x`` the points are numbered 1, 2, ... by ``order``. Time becomes seconds since 1970. Missing
    errors are zero.
    """
    members = [c for c in (x, y, ey, ex) if c]
    if x is None:
        if not order:
            raise ValueError("a series without x needs an order")
        extra = [c for c in order if c not in members]
        kept = df.select(*[number_column(df, c).alias(f"_{c}") for c in members],
                         *[ref(c).alias(f"_{c}") for c in extra])
        kept = kept.where(reduce(lambda a, b: a & b, [~_broken(ref(f"_{c}")) for c in members]))
        numbered = with_index(kept, [ref(f"_{c}").asc() for c in order], "_index")
        place = (F.col("_index") + 1).cast("double")
        value = lambda c: ref(f"_{c}")
    else:
        numbered = clean_numbers(df, members)
        place, value = ref(x), ref
    error = lambda c: value(c) if c else F.lit(0.0)
    return numbered.select(place.alias("x"), value(y).alias("y"), error(ex).alias("ex"), error(ey).alias("ey"))


def step_series(points: DataFrame) -> DataFrame:
    """A line with steps: each y holds until the next x, so n points give 2n - 1, numbered by ``seq``.

    The next x comes from a join on the point's number, so no task sees the whole series.
    """
    numbered = with_index(points.select("x", "y"), [F.col("x").asc()], "_index")
    following = numbered.select((F.col("_index") - 1).alias("_index"), F.col("x").alias("_next"))
    pairs = numbered.join(following, "_index", "left")
    point = lambda seq, x: F.struct(seq.alias("seq"), x.alias("x"), F.col("y").alias("y"))
    both = F.array(point(F.col("_index") * 2, F.col("x")), point(F.col("_index") * 2 + 1, F.col("_next")))
    return pairs.select(F.explode(both).alias("p")).select("p.*").where(F.col("x").isNotNull())


def multi_series(named: Mapping[str, DataFrame]) -> DataFrame:
    """Several series in one frame, told apart by ``series``."""
    parts = [points.select(F.lit(name).alias("series"), *points.columns) for name, points in named.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
