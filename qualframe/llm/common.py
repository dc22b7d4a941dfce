"""What the operators of this subpackage share."""

from __future__ import annotations

import sys
import types
from typing import Callable, Iterable, Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qualframe.session import configure, scratch_path

# Blank characters between words: space, and tab to carriage return.
BLANK = r"[\x20\x09-\x0D]+"


def travels(module: str) -> None:
    """Lets tasks get the functions of a module with the job, so executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def once(name: str, make: Callable[[], object]):
    """What ``make`` returns, made once per process and kept between tasks."""
    kept = sys.modules.setdefault("_kept_between_tasks", types.ModuleType("_kept_between_tasks")).__dict__
    if name not in kept:
        kept[name] = make()
    return kept[name]


travels(__name__)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often ``body`` mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Words between blanks, as an array; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK), lambda w: w != "")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared scratch folder and read again: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Keys of 8 bytes that may be sent to every task.
SENT = 1_000_000


def among(rows: DataFrame, few: DataFrame, column: str) -> DataFrame:
    """``rows`` whose ``column`` is in ``few`` (stored, one bigint). Up to ``SENT`` of them, counted first, are sent to every task; more are
    joined by a shuffle, where Spark's own Bloom filter keeps most rows back."""
    return rows.join(F.broadcast(few) if few.count() <= SENT else few, column, "left_semi")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def others(df: DataFrame, taken: Iterable[str]) -> list[str]:
    """Columns of ``df`` besides those an operator makes itself (compared without case, as Spark does)."""
    made = {c.lower() for c in taken}
    return [c for c in df.columns if c.lower() not in made]


def columns(df: DataFrame, names: Sequence[str]) -> list[Column]:
    return [df[f"`{c}`"] for c in names]
