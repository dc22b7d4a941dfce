"""Shards against prefix sums in plain Python."""

import zlib
from collections import defaultdict

from qualframe.llm import sharding


def check(rows, found, number):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode())))
    total, before, wanted, slots = sum(len((t or "").encode()) + 8 for _, t, *_ in rows), 0, [], defaultdict(int)
    for key, text, *_ in order:
        size = len((text or "").encode()) + 8
        shard = (2 * before + size) * number // (2 * total)
        wanted.append((key, size, zlib.crc32((text or "").encode()), shard, slots[shard]))
        slots[shard] += 1
        before += size
    plain = lambda r: (r[0] is not None, *[v or 0 for v in r])
    assert sorted(map(plain, map(tuple, found))) == sorted(map(plain, wanted))


def test_shards_match_prefix_sums(spark):
    rows = [(i * 7 % 101, "ü" * (i * 37 % 400) if i % 9 else None, i) for i in range(101)] + [(None, "n", 0), (5, "", 0)]
    found = sharding.shards(spark.createDataFrame(rows, "doc_id bigint, text string, shard int").repartition(5), 7).collect()
    check(rows, found, 7)


def test_copies_of_one_row_are_spread_and_counted(spark):
    rows = [(1, "same text")] * 5_000 + [(i, f"t{i}") for i in range(2, 1_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    check(rows, sharding.shards(docs, 4).collect(), 4)
    sized = docs.selectExpr("doc_id AS key", "CAST(length(text) + 8 AS BIGINT) AS size")
    parts = sharding.prefix_sums(sized, ["key", "size"])
    assert parts.selectExpr("max(rows_before)").first()[0] == len(rows) - 1


def test_one_long_text_and_an_empty_table(spark):
    rows = [(1, "x" * 100_000), (2, "y"), (3, None)]
    check(rows, sharding.shards(spark.createDataFrame(rows, "doc_id bigint, text string"), 24).collect(), 24)
    assert sharding.shards(spark.createDataFrame([], "doc_id bigint, text string"), 24).count() == 0
