"""Quality ledger: against plain Python, and its policies and ablations."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from qualframe.llm import quality

TEXTS = [None, "", " \t\n", "one", "a b c a b c", "a a a a", "x\x0by\x0cz\r w", "l1\nl1\n\nl2 \nl1", "#*$%&|<> ok", "é ñ ü " * 30,
         "the same words come again and again " * 12, " ".join(f"w{i}" for i in range(70)), "w " * 30_000, "long" * 40_000]


def expected(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {p for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [line for line in text.split("\n") if line.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines), len(lines) - len(set(lines)), len(covered)


def test_measures_match_plain_python(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    for row in quality.ledger(docs).collect():
        assert tuple(row[m] for m in quality.MEASURES) == expected(TEXTS[row.id]), TEXTS[row.id]


def test_clashing_columns_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", 7, "k")] * 2, "id int, text string, n_words int, `my.col` string")
    judged = quality.ledger(docs)
    assert judged.columns == ["id", "text", "my.col", *quality.MEASURES, "fail_bits"]
    assert [(r.n_words, r["my.col"]) for r in judged.collect()] == [(2, "k")] * 2
    assert quality.ledger(docs.limit(0)).count() == 0


def test_policies_are_masks(spark):
    docs = spark.createDataFrame([(" ".join(f"w{i}" for i in range(60)),), ("# " * 60,), (None,)], "text string")
    judged = quality.ledger(docs)
    for policy in quality.POLICIES:
        assert [r.kept for r in judged.select(quality.passes(policy).alias("kept")).collect()][2] is False
    assert [r.kept for r in judged.select(quality.passes("2024-1").alias("kept")).collect()] == [True, False, False]


@pytest.mark.parametrize("policy", list(quality.POLICIES))
def test_ablations_match_masks_applied_one_by_one(spark, policy):
    bits = [0, 1, 2, 3, 16, 17, 32, 63, 8]
    judged = spark.createDataFrame([(b,) for b in bits], "fail_bits bigint")
    whole = quality.mask(quality.POLICIES[policy])
    found = {r["rule"]: r for r in quality.ablations(judged, policy).collect()}
    assert set(found) == set(quality.POLICIES[policy])
    for rule, row in found.items():
        without = whole & ~quality.mask([rule])
        assert row.failed == sum(bool(b & quality.mask([rule])) for b in bits)
        assert row.kept == sum(not b & whole for b in bits)
        assert row.kept_without == sum(not b & without for b in bits)
        assert row.only_by_it == row.kept_without - row.kept
    assert quality.ablations(judged.where(F.lit(False)), policy).count() == 0
