"""Row numbers over a global order without a single task that sees every row."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qualframe.session import materialize

# Copies of one row are dealt out over the tasks of the sort by a number below this.
SPREAD = 1 << 20
# monotonically_increasing_id(): the partition above these bits, the row within it below.
_ROW_BITS = 33


def _numbered(ranked: DataFrame, index: str) -> DataFrame:
    """Rows of a materialised, globally sorted frame with their number from 0: rows in partitions before, plus the place within."""
    tagged = ranked.withColumn("__row", F.monotonically_increasing_id())
    part = F.shiftright("__row", _ROW_BITS)
    counts = tagged.groupBy(part.alias("__part")).agg(F.count("*").alias("__rows"))
    # One row per task of the sort, whatever the number of rows: what is sent to every task is bounded by the sort's width.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = F.broadcast(counts.select("__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before")))
    placed = tagged.withColumn("__part", part).join(offsets, "__part")
    number = F.col("__before") + F.col("__row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return placed.withColumn(index, number).drop("__part", "__before", "__row")


def with_index(df: DataFrame, order: Sequence[Column], index: str = "index") -> DataFrame:
    """Number rows 0, 1, ... by ``order`` (ties by the remaining columns, so the result is determined).

    Equal rows may be any part of the frame: a running number, last in the order, spreads them over the tasks of the sort.
    """
    ties = [F.col(f"`{c}`").asc_nulls_first() for c in df.columns]
    spread = df.withColumn("__spread", F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)))
    ranked = materialize(spread.orderBy(*order, *ties, "__spread").drop("__spread"))
    return _numbered(ranked, index).select(index, *[F.col(f"`{c}`") for c in df.columns])


def rank_groups(df: DataFrame, order: Sequence[Column], index: str = "index") -> DataFrame:
    """The same for frames whose rows are distinct already, such as the result of an aggregate."""
    return _numbered(materialize(df.orderBy(*order)), index)
