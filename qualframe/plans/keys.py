"""Keys that must be unique over all deliveries of a dataset.

An index keeps the hashes of the keys of every accepted delivery, in parts by delivery and leading bits of the hash, each with a Bloom filter.
The keys of a new delivery are held against the filters first; only parts that may hold one of them are read, and what is found there is
confirmed on the values, in the published rows of the deliveries concerned. Deliveries the index does not know yet (the first time, or after a
job that died) are added before they are needed, so the index is never part of a commit.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualframe.functions.columns import ref
from qualframe.plans.ingest import ATTEMPT, Dataset
from qualframe.session import materialize
from qualframe.sources.files import path_exists
from qualframe.sources.reports import latest

# Keys of a part, about, and the bits of its filter for each of them (a power of two of 64-bit words in all).
PART_KEYS, KEY_BITS, PROBES, DEEPEST = 1_000_000, 10, 4, 20
# Rows of a frame of deliveries or parts that may be sent to every task, counted first.
SENT = 100_000
PARTS_DDL = f"{ATTEMPT} string, depth int, prefix bigint, keys bigint, words int, bits array<bigint>"


def _sent(frame: DataFrame) -> DataFrame:
    return F.broadcast(frame) if frame.count() <= SENT else frame


def _prefix(value: Column, depth: Column) -> Column:
    """The leading bits of a hash."""
    return F.when(depth == 0, F.lit(0).cast("bigint")).otherwise(F.call_function("shiftrightunsigned", value, F.lit(64) - depth))


def _positions(value: Column, words: Column) -> Column:
    """The bits of a filter that stand for a hash."""
    step = F.xxhash64(value)
    mixed = lambda j: F.pmod(value.bitwiseXOR(F.call_function("shiftright", step, F.lit(7 * j))), words.cast("bigint") * 64)
    return F.array(*[mixed(j) for j in range(PROBES)])


def _bit(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), (position % 64).cast("int"))


def _maybe(value: Column, words: Column, bits: Column) -> Column:
    """Whether a filter may hold a hash."""
    return F.forall(_positions(value, words), lambda p: F.get(bits, F.shiftright(p, 6).cast("int")).bitwiseAND(_bit(p)) != 0)


@dataclass
class KeyIndex:
    """The keys of one dataset, kept below ``root/keys``."""

    dataset: Dataset
    keys: Sequence[str]

    @property
    def entries_path(self) -> str:
        return f"{self.dataset.root}/keys/entries"

    @property
    def parts_path(self) -> str:
        return f"{self.dataset.root}/keys/parts"

    def hashed(self, rows: DataFrame, *others: str) -> DataFrame:
        """Rows with the hash of their key; a key with a null in it is none."""
        complete = reduce(lambda a, b: a & b, [ref(k).isNotNull() for k in self.keys])
        return rows.where(complete).select(*others, *[ref(k).alias(f"_k{i}") for i, k in enumerate(self.keys)],
                                           F.xxhash64(*[ref(k) for k in self.keys]).alias("hash"))

    def parts(self) -> DataFrame:
        spark = self.dataset.spark
        if not path_exists(spark, self.parts_path):
            return spark.createDataFrame([], PARTS_DDL)
        return spark.read.schema(PARTS_DDL).parquet(self.parts_path).dropDuplicates([ATTEMPT, "depth", "prefix"])

    def refresh(self) -> int:
        """Add the accepted deliveries the index does not know; returns how many there were."""
        accepted = latest(self.dataset.manifest().where("status = 'accepted'")).select("ingestion", F.col("uid").alias(ATTEMPT))
        unknown = materialize(accepted.join(self.parts().select(ATTEMPT).distinct(), ATTEMPT, "left_anti"))
        if number := unknown.count():
            self._add(self.dataset.attempts(unknown.select("ingestion", ATTEMPT)))
        return number

    def _add(self, rows: DataFrame) -> None:
        spark = self.dataset.spark
        own = self.hashed(rows, ATTEMPT).select(ATTEMPT, "hash").distinct()
        sizes = materialize(own.groupBy(ATTEMPT).agg(F.count("*").alias("n")))
        depth = F.least(F.ceil(F.log2(F.greatest(F.col("n") / PART_KEYS, F.lit(1.0)))), F.lit(DEEPEST)).cast("int")
        placed = own.join(_sent(sizes), ATTEMPT).withColumn("depth", depth).select(ATTEMPT, "depth", _prefix(F.col("hash"), F.col("depth")).alias("prefix"), "hash")
        placed.hint("rebalance", ATTEMPT, "depth", "prefix").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            ATTEMPT, "depth", "prefix").parquet(self.entries_path)
        written = self.entries().join(_sent(sizes.select(ATTEMPT)), ATTEMPT, "left_semi")
        words = F.greatest(F.lit(1.0), F.pow(F.lit(2.0), F.ceil(F.log2(F.col("keys") * KEY_BITS / 64)))).cast("int")
        parts = materialize(written.groupBy(ATTEMPT, "depth", "prefix").agg(F.count("*").alias("keys")).withColumn("words", words))
        by = [ATTEMPT, "depth", "prefix", "keys", "words"]
        # Words without any bit are there as well, so that the word of a bit is found by its place.
        empty = parts.select(*by, F.explode(F.sequence(F.lit(0), F.col("words") - 1)).alias("word"), F.lit(0).cast("bigint").alias("bit"))
        bits = written.join(_sent(parts), [ATTEMPT, "depth", "prefix"]).select(*by, F.explode(_positions(F.col("hash"), F.col("words"))).alias("p")).select(
            *by, F.shiftright("p", 6).cast("int").alias("word"), _bit(F.col("p")).alias("bit"))
        whole = bits.unionByName(empty).groupBy(*by, "word").agg(F.bit_or("bit").alias("bit"))
        # At most KEY_BITS bits for each key of a part, as whole words.
        filters = whole.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "bit"))), lambda w: w["bit"]).alias("bits"))
        known = filters.select(*[c.split(" ")[0] for c in PARTS_DDL.split(", ")])
        # A delivery without any key is known too.
        without = self._names(rows).join(sizes, ATTEMPT, "left_anti").select(
            ATTEMPT, F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("prefix"), F.lit(0).cast("bigint").alias("keys"), F.lit(1).alias("words"),
            F.array(F.lit(0).cast("bigint")).alias("bits"))
        known.unionByName(without).write.mode("append").parquet(self.parts_path)

    def _names(self, rows: DataFrame) -> DataFrame:
        return rows.select(ATTEMPT).distinct()

    def entries(self) -> DataFrame:
        ddl = f"hash bigint, {ATTEMPT} string, depth int, prefix bigint"
        spark = self.dataset.spark
        return spark.read.schema(ddl).parquet(self.entries_path) if path_exists(spark, self.entries_path) else spark.createDataFrame([], ddl)

    def hits(self, hashes: DataFrame, besides: DataFrame | None = None) -> DataFrame:
        """``ingestion, attempt, hash``: published deliveries (but those in ``besides``, by ``ingestion``) that hold a hash of ``hashes``."""
        current = latest(self.dataset.manifest().where("status = 'accepted'")).select("ingestion", F.col("uid").alias(ATTEMPT))
        if besides is not None:
            current = current.join(besides.select("ingestion").distinct(), "ingestion", "left_anti")
        parts = materialize(self.parts().join(current, ATTEMPT).where("keys > 0"))
        depths = [row.depth for row in parts.select("depth").distinct().collect()]  # at most DEEPEST + 1
        each = hashes.select("hash").distinct().select("hash", F.explode(F.array(*[F.lit(d) for d in depths]).cast("array<int>")).alias("depth"))
        asked = each.withColumn("prefix", _prefix(F.col("hash"), F.col("depth")))
        met = asked.join(parts, ["depth", "prefix"]).where(_maybe(F.col("hash"), F.col("words"), F.col("bits"))).select(
            "ingestion", ATTEMPT, "depth", "prefix", "hash")
        met = materialize(met)
        # Folders of parts that no key may be in are pruned by this join.
        read = self.entries().join(_sent(met.select(ATTEMPT, "depth", "prefix").distinct()), [ATTEMPT, "depth", "prefix"], "left_semi")
        return met.join(read.select(ATTEMPT, "hash").distinct(), [ATTEMPT, "hash"]).select("ingestion", ATTEMPT, "hash")

    def repeated(self, arriving: DataFrame) -> DataFrame:
        """Keys of ``arriving`` rows (with ``ingestion``) that occur more than once, there or in other published deliveries.

        One row per delivery and key: the key, ``rows`` in the delivery, and ``elsewhere``, the rows with that key in other deliveries.
        """
        names = [f"_k{i}" for i in range(len(self.keys))]
        counted = materialize(self.hashed(arriving, "ingestion").groupBy("ingestion", *names, "hash").agg(F.count("*").alias("rows")))
        found = materialize(self.hits(counted, besides=counted))
        published = self.hashed(self.dataset.attempts(found.select("ingestion", ATTEMPT).distinct())).join(found.select("hash").distinct(), "hash", "left_semi")
        before = published.groupBy(*names).agg(F.count("*").alias("before"))
        whole = counted.groupBy(*names).agg(F.sum("rows").alias("arrived"))
        every = counted.join(whole, names).join(before, names, "left")
        elsewhere = F.col("arrived") - F.col("rows") + F.coalesce("before", F.lit(0))
        return every.select("ingestion", *[F.col(n).alias(k) for n, k in zip(names, self.keys)], "rows", elsewhere.alias("elsewhere")).where(
            "rows + elsewhere > 1")

    def counts(self, arriving: DataFrame) -> DataFrame:
        """Per delivery: rows with a key, and rows whose key occurs again in any delivery."""
        complete = reduce(lambda a, b: a & b, [ref(k).isNotNull() for k in self.keys])
        all_ = arriving.groupBy("ingestion").agg(F.count_if(complete).alias("evaluated"))
        again = self.repeated(arriving).groupBy("ingestion").agg(F.sum("rows").alias("failed"))
        return all_.join(again, "ingestion", "left").select("ingestion", "evaluated", F.coalesce("failed", F.lit(0)).alias("failed"))
