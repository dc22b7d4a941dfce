"""Keys over all deliveries: the index against a plain count of everything that is visible."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from qualframe.document import Document
from qualframe.plans import keys
from qualframe.plans.ingest import Dataset
from qualframe.plans.keys import KeyIndex
from qualframe.queries.registry import spec_of

DDL = "ingestion string, a bigint, b string, x double"


def make(spark, tmp_path):
    spec = spec_of(spark.createDataFrame([], DDL), "t", ["ingestion"])
    for name in ("a", "b"):
        spec = spec.replace_field(spec.field(name).with_flags(is_key=True))
    return Dataset(spark, str(tmp_path / "d"), Document("t", "t0000001", (spec,)), unique_keys=True)


def status(rows):
    return {r.ingestion: r.status for r in rows.collect()}


def rows_of(delivery, numbers, b="k"):
    return [(delivery, n, b, 0.5) for n in numbers]


@pytest.mark.parametrize("part_keys", [1_000_000, 40])
def test_repeated_keys_equal_a_plain_count(spark, tmp_path, monkeypatch, part_keys):
    monkeypatch.setattr(keys, "PART_KEYS", part_keys)
    dataset, kept = make(spark, tmp_path), []
    index = KeyIndex(dataset, ["a", "b"])
    for i in range(3):
        part = [r for k in range(2) for r in rows_of(f"{i}{k}", range(1_000 * (2 * i + k), 1_000 * (2 * i + k) + 300))]
        dataset.ingest(spark.createDataFrame(part, DDL))
        kept += part
    assert index.refresh() == 2 and index.refresh() == 0  # those of the last batch; the others were added before it
    assert index.parts().count() >= (6 if part_keys > 40 else 40)
    fresh = rows_of("new", [5, 5, 299, 1_000, 9_999, 9_999, 70_000]) + rows_of("new", [5], "other") + [("new", None, "k", 1.0), ("new", 1, None, 1.0)] + rows_of("late", [2_001, 70_000])
    found = {(r.ingestion, r.a, r.b): (r.rows, r.elsewhere) for r in index.repeated(spark.createDataFrame(fresh, DDL)).collect()}
    counts, wanted = Counter((a, b) for _, a, b, _ in kept + fresh if a is not None and b is not None), {}
    for (delivery, a, b), n in Counter(r[:3] for r in fresh if None not in r).items():
        if counts[a, b] > 1:
            wanted[delivery, a, b] = (n, counts[a, b] - n)
    assert found == wanted
    assert {r.ingestion: (r.evaluated, r.failed) for r in index.counts(spark.createDataFrame(fresh, DDL)).collect()} == {"new": (8, 7), "late": (2, 2)}


def test_only_parts_that_may_hold_a_key_are_read(spark, tmp_path):
    dataset = make(spark, tmp_path)
    dataset.ingest(spark.createDataFrame([r for i in range(8) for r in rows_of(f"d{i}", range(1_000 * i, 1_000 * i + 400))], DDL))
    index = KeyIndex(dataset, ["a", "b"])
    index.refresh()
    fresh = index.hashed(spark.createDataFrame(rows_of("new", [3_100, 3_200]), DDL), "ingestion")
    assert index.parts().count() == 8
    found = index.hits(fresh)
    assert {r.ingestion for r in found.collect()} == {"d3"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower() or "PartitionFilters" in plan
    # A filter of ten bits a key lets few foreign keys pass.
    foreign = spark.range(100_000, 104_000).select(F.xxhash64(F.col("id"), F.lit("k")).alias("hash"))
    one = index.parts().limit(1)
    assert foreign.join(F.broadcast(one), F.col("keys") > 0).where(keys._maybe(F.col("hash"), F.col("words"), F.col("bits"))).count() < 0.05 * 4_000


def test_deliveries_with_known_keys_are_refused(spark, tmp_path):
    dataset = make(spark, tmp_path)
    assert status(dataset.ingest(spark.createDataFrame(rows_of("a", range(50)) + rows_of("b", [70, 70]), DDL))) == {"a": "accepted", "b": "rejected"}
    assert status(dataset.ingest(spark.createDataFrame(rows_of("c", [49, 50]) + rows_of("d", [60]) + rows_of("e", [70]), DDL))) == {
        "c": "rejected", "d": "accepted", "e": "accepted"}  # b was refused, so its keys are free
    # A delivery that comes again is not held against itself; the key it leaves out is free then.
    assert status(dataset.ingest(spark.createDataFrame(rows_of("a", range(49)), DDL))) == {"a": "accepted"}
    assert status(dataset.ingest(spark.createDataFrame(rows_of("f", [49]) + rows_of("g", [48]), DDL))) == {"f": "accepted", "g": "rejected"}


def test_one_key_in_most_rows_and_deliveries_without_keys(spark, tmp_path):
    dataset = make(spark, tmp_path)
    nothing = [("n", None, "k", 0.0), ("n", 1, None, 0.0)]
    assert status(dataset.ingest(spark.createDataFrame(nothing, DDL))) == {"n": "accepted"}
    index = KeyIndex(dataset, ["a", "b"])
    assert index.refresh() == 1 and index.refresh() == 0
    many = spark.range(30_000).select(F.lit("m").alias("ingestion"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).cast("bigint").alias("a"),
                                      F.lit("k").alias("b"), F.lit(0.0).alias("x"))
    assert {r.ingestion: (r.evaluated, r.failed) for r in index.counts(many).collect()} == {"m": (30_000, 10_001)}
