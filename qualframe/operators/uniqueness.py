"""Uniqueness of columns and keys.

Values are counted with a partial aggregate first, so a value that fills a third of all rows crosses the
network once per map task, not once per row. Only counts per value go on to the second aggregate.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qualframe.functions.columns import ref, resolve
from qualframe.functions.fingerprint import identity
from qualframe.types import is_fraction, is_time


def typed_slots(c: Column, dtype: T.DataType) -> list[Column]:
    """One typed cell per column, so several columns can be counted in one shuffle without losing exactness."""
    whole = isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) or is_time(dtype)
    slot_long = F.lit(None).cast("bigint")
    slot_double = F.lit(None).cast("double")
    slot_text = F.lit(None).cast("string")
    if is_time(dtype):
        slot_long = F.unix_micros(c.cast("timestamp"))
    elif whole:
        slot_long = c.cast("bigint")
    elif is_fraction(dtype):
        slot_double = c.cast("double") + F.lit(0.0)  # -0.0 and 0.0 are one value
    elif isinstance(dtype, T.BinaryType):
        slot_text = identity(F.hex(c))
    else:
        slot_text = identity(c.cast("string"))
    return [slot_long.alias("vl"), slot_double.alias("vd"), slot_text.alias("vs")]


def duplicate_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Per column: non-null rows, rows whose value occurs more than once, and how many such values there are."""
    cells = []
    for name in columns:
        c, dtype = resolve(df.schema, name)
        cells.append(F.struct(F.lit(name).alias("column"), c.isNull().alias("absent"), *typed_slots(c, dtype)))
    groups = [ref(c) for c in by]
    if len(cells) == 1:
        long = df.select(*groups, cells[0].alias("_c"))
    else:
        long = df.select(*groups, F.explode(F.array(*cells)).alias("_c"))
    long = long.select(*groups, "_c.*")
    per_value = long.groupBy(*groups, "column", "absent", "vl", "vd", "vs").agg(F.count("*").alias("n"))
    # One wide aggregate per group, so that an empty frame still gives a row for every column.
    sums, rows = [], []
    for i, name in enumerate(columns):
        present = (F.col("column") == name) & ~F.col("absent")
        sums += [
            F.coalesce(F.sum(F.when(present, F.col("n"))), F.lit(0)).alias(f"e{i}"),
            F.coalesce(F.sum(F.when(present & (F.col("n") > 1), F.col("n"))), F.lit(0)).alias(f"f{i}"),
            F.count_if(present & (F.col("n") > 1)).alias(f"r{i}"),
        ]
        rows.append(F.struct(F.lit(name).alias("column"), F.col(f"e{i}").alias("evaluated"),
                             F.col(f"f{i}").alias("failed"), F.col(f"r{i}").alias("repeated_values")))
    wide = per_value.groupBy(*groups).agg(*sums)
    return wide.select(*groups, F.explode(F.array(*rows)).alias("_r")).select(*groups, "_r.*")


def key_counts(df: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The same for a compound key; a key with a null part is not evaluated."""
    groups = [ref(c) for c in by]
    parts = [ref(key) for key in keys]
    absent = F.lit(False)
    for part in parts:
        absent = absent | part.isNull()
    compact = [identity(c) if isinstance(resolve(df.schema, key)[1], T.StringType) else c for key, c in zip(keys, parts)]
    keyed = df.select(*groups, absent.alias("_absent"), *[c.alias(f"_k{i}") for i, c in enumerate(compact)])
    per_key = keyed.groupBy(*groups, "_absent", *[f"_k{i}" for i in range(len(keys))]).agg(F.count("*").alias("_n"))
    repeated = ~F.col("_absent") & (F.col("_n") > 1)
    return per_key.groupBy(*groups).agg(
        F.coalesce(F.sum(F.when(~F.col("_absent"), F.col("_n"))), F.lit(0)).alias("evaluated"),
        F.coalesce(F.sum(F.when(repeated, F.col("_n"))), F.lit(0)).alias("failed"),
        F.count_if(repeated).alias("repeated_values"),
    )


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys that occur more than once, with their number of rows."""
    parts = [ref(key) for key in keys]
    counted = df.groupBy(*parts).agg(F.count("*").alias("rows")).where(F.col("rows") > 1)
    # Not dropna, which also takes NaN away: NaN is a key like any other.
    return counted.where(reduce(lambda a, b: a & b, [ref(key).isNotNull() for key in keys]))
