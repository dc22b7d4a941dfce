"""Fingerprints of values, and of rows whatever their order, file layout or partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualframe.functions.columns import ref
from qualframe.functions.uid import key_hash


def identity(text: Column) -> Column:
    """The SHA-256 of a text, which stands for it wherever equal texts are counted: 64 bytes instead of whole documents."""
    return F.sha2(text.cast("binary"), 256)


def row_fingerprint(df: DataFrame, columns: list[str] | None = None, by: list[str] = (),
                    algorithm: str = "xxhash64") -> DataFrame:
    """Rows and the sum of row hashes (exact decimal, so adding in any order gives the same)."""
    columns = columns or [c for c in df.columns if c not in by]
    cells = [ref(c) for c in columns]
    if algorithm == "xxhash64":  # it skips nulls, so say where they are
        cells.append(F.array(*[ref(c).isNull() for c in columns]))
    hashed = key_hash(*cells, algorithm=algorithm)
    total = F.sum(hashed.cast("decimal(38,0)")).cast("string")
    return df.groupBy(*[ref(c) for c in by]).agg(F.count("*").alias("rows"), total.alias("fingerprint"))
