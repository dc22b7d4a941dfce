"""Contiguous shards of nearly equal bytes, from global prefix sums over per-partition totals.

Rows are sorted by range into partitions, written once, and every partition adds up its own sizes. Only those totals, one
row per partition, are added up in one place; each row then knows the bytes and rows before it, and the shard is where
the middle of the row falls among equal targets. No task holds more than its range; a key with any number of copies is
spread over partitions, as copies are told apart by their content and by a running number.

Defined results: a null text has no bytes (size 8) and crc32 0; shard and slot follow (id, crc32, size), so repeated rows
sit side by side; null ids come first; an empty table gives no rows; other columns are dropped, names cannot clash. With
texts larger than a target some shards stay empty, since a row is never cut.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qualframe.llm.common import stored, travels

travels(__name__)

# Bytes a row counts besides its text.
ROW_BYTES = 8


def text_crc32(text: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def _running(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Bytes and rows before each row, within its partition as it lies."""
    bytes_before = rows_before = 0
    for batch in batches:
        ends = np.cumsum(batch["size"].to_numpy(np.int64))
        batch["bytes_in"] = bytes_before + ends - batch["size"].to_numpy(np.int64)
        batch["rows_in"] = rows_before + np.arange(len(batch), dtype=np.int64)
        if len(batch):
            bytes_before, rows_before = bytes_before + int(ends[-1]), rows_before + len(batch)
        yield batch


def prefix_sums(sized: DataFrame, order: list[str], size: str = "size") -> DataFrame:
    """Rows of ``sized`` with ``bytes_before`` and ``rows_before`` in the order of ``order``."""
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20))
    ranged = (sized.withColumn("_spread", spread).repartitionByRange(*order, "_spread")
              .sortWithinPartitions(*order, "_spread").drop("_spread").withColumn("_part", F.spark_partition_id()))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema.fields)
    placed = stored(ranged.mapInPandas(_running, f"{schema}, bytes_in bigint, rows_in bigint"), "prefix-sums")
    totals = placed.groupBy("_part").agg(F.sum(size).alias("bytes"), F.count("*").alias("rows"))
    # One row per partition of the sort: as many as the job has tasks, whatever the number of documents.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in ("bytes", "rows")])
    return placed.join(offsets, "_part").select(
        *[c for c in sized.columns], (F.col("_bytes") + F.col("bytes_in")).alias("bytes_before"),
        (F.col("_rows") + F.col("rows_in")).alias("rows_before"))


def shards(docs: DataFrame, number: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key``, ``size``, ``text_crc32``, ``shard`` (0 to ``number`` - 1) and gapless ``slot``."""
    body = docs[f"`{text}`"]
    sized = docs.select(docs[f"`{key}`"].alias("key"), F.coalesce(F.octet_length(body), F.lit(0)).cast("bigint").alias("_length"),
                        text_crc32(body).alias("text_crc32")).select(
        "key", (F.col("_length") + ROW_BYTES).alias("size"), "text_crc32")
    summed = prefix_sums(sized, ["key", "text_crc32", "size"])
    total = summed.agg(F.max(F.col("bytes_before") + F.col("size"))).first()[0] or 1  # one number
    middle = 2 * F.col("bytes_before") + F.col("size")
    placed = summed.withColumn("shard", F.call_function("div", middle * number, F.lit(2 * total).cast("bigint")).cast("int"))
    starts = placed.groupBy("shard").agg(F.min("rows_before").alias("_start"))  # at most ``number`` rows
    return placed.join(F.broadcast(starts), "shard").select(
        F.col("key").alias(key), "size", "text_crc32", "shard", (F.col("rows_before") - F.col("_start")).alias("slot"))
