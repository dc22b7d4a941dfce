"""Quality rules as a ledger: every rule is evaluated once and stored as a bit, policies are masks over the bits.

``ledger`` measures each text and sets one bit for every rule that fails. A policy is a named set of rules; applying another
version, or asking what a policy would keep without one of its rules, needs the bits only and never the texts again.
Everything is a column expression: no shuffle, no state, whole texts.

Defined results: a null text counts as a text without words; an empty text fails ``few_words``; repeated rows are judged
alike; an empty table gives an empty ledger; columns named like a measurement are replaced, all others are kept.
"""

from __future__ import annotations

from functools import reduce
from typing import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualframe.llm.common import columns, let, others, words_of

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

# Rule -> condition under which it fails, over the measurements. The place in this mapping is the place of the bit.
RULES: Mapping[str, Callable[[Mapping[str, Column]], Column]] = {
    "few_words": lambda m: m["n_words"] < 50,
    "repeated_windows": lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"],
    "short_words": lambda m: m["word_chars"] < 2 * m["n_words"],
    "long_words": lambda m: m["word_chars"] > 12 * m["n_words"],
    "many_symbols": lambda m: 10 * m["n_symbols"] > m["n_words"],
    "repeated_lines": lambda m: 10 * m["n_dup_lines"] > 3 * m["n_lines"],
}

# Versions of the policy: the rules whose failure rejects a document.
POLICIES: Mapping[str, Sequence[str]] = {
    "base": ("few_words", "repeated_windows"),
    "2024-1": ("few_words", "repeated_windows", "long_words", "many_symbols"),
    "2024-2": ("few_words", "repeated_windows", "short_words", "long_words", "many_symbols", "repeated_lines"),
}
DEFAULT_POLICY = "2024-1"


def mask(rules: Sequence[str]) -> int:
    return sum(1 << list(RULES).index(rule) for rule in rules)


def _repeated(words: Column, n: Column) -> Column:
    """Words inside windows of three words found twice or more.

    Windows are hashed to 64 bits and sorted together with their places, so equal windows are neighbours; the places of
    those are sorted again and the words they cover are added up. Linear but for the two sorts, within the row.
    """
    places = F.sequence(F.lit(0), n - 3)
    keyed = F.transform(places, lambda i: F.struct(F.xxhash64(words[i], words[i + 1], words[i + 2]).alias("h"), i.alias("i")))
    last = n - 3

    def repeated(s: Column) -> Column:
        again = F.filter(s, lambda x, k: ((k > 0) & (s[F.greatest(k - 1, F.lit(0))]["h"] == x["h"]))
                         | ((k < last) & (s[F.least(k + 1, last)]["h"] == x["h"])))
        return F.sort_array(F.transform(again, lambda x: x["i"]))

    def covered(starts: Column) -> Column:
        many = F.size(starts)
        return F.aggregate(F.transform(starts, lambda p, k: F.when(k == many - 1, F.lit(3)).otherwise(
            F.least(F.lit(3), starts[F.least(k + 1, many - 1)] - p))), F.lit(0).cast("bigint"), lambda a, x: a + x)

    return F.when(n < 3, F.lit(0).cast("bigint")).otherwise(let(let(F.sort_array(keyed), repeated), covered))


def measures(text: Column) -> Column:
    """All measurements of a text, as a struct of ``MEASURES``."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.translate(line, BLANKS, "") != "")
    length = lambda c: F.length(c).cast("bigint")
    by_words = let(words_of(text), lambda w: F.struct(
        F.size(w).cast("bigint").alias("n_words"), let(F.size(w), lambda n: _repeated(w, n)).alias("n_repeat_words")))
    by_lines = let(lines, lambda x: F.struct(
        F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines")))
    return let(by_words, lambda a: let(by_lines, lambda b: F.struct(
        a["n_words"].alias("n_words"), length(F.translate(text, BLANKS, "")).alias("word_chars"),
        (length(text) - length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
        b["n_lines"].alias("n_lines"), b["n_dup_lines"].alias("n_dup_lines"), a["n_repeat_words"].alias("n_repeat_words"))))


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``MEASURES`` and ``fail_bits`` (bigint, one bit per rule of ``RULES``, set where the rule fails)."""
    kept = others(docs, (*MEASURES, "fail_bits", "_m"))
    measured = docs.select(*columns(docs, kept), measures(docs[f"`{text}`"]).alias("_m"))
    bits = [F.when(fails({m: F.col(f"_m.{m}") for m in MEASURES}), F.lit(1 << k)).otherwise(F.lit(0)).cast("bigint")
            for k, fails in enumerate(RULES.values())]
    return measured.select(*columns(measured, kept), "_m.*", reduce(Column.bitwiseOR, bits).alias("fail_bits"))


def passes(policy: str, bits: str = "fail_bits") -> Column:
    """Whether a ledger row passes a version of the policy; the base rules always hold."""
    return F.col(bits).bitwiseAND(F.lit(mask(POLICIES[policy]) | mask(POLICIES["base"])).cast("bigint")) == 0


def ablations(judged: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """Per rule of the policy: documents it fails, documents only it rejects, documents kept with it and without it.

    The ledger is counted by its bits first, at most 2^rules rows whatever its size; every figure follows from those.
    """
    whole = mask(POLICIES[policy])
    histogram = judged.groupBy(F.col("fail_bits").bitwiseAND(F.lit(whole).cast("bigint")).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask([r])).cast("bigint").alias("bit")) for r in POLICIES[policy]])
    each = histogram.select("bits", "n", F.inline(rules))
    count = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("bigint")
    rest = F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit")))
    return each.groupBy("rule").agg(
        count(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("failed"),
        count((rest == 0) & (F.col("bits") != 0)).alias("only_by_it"),
        count(F.col("bits") == 0).alias("kept"), count(rest == 0).alias("kept_without"))
