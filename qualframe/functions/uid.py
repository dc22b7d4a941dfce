"""Short identifiers: integers below 10^14 written as eight base-62 digits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualframe.functions.columns import ref

# Fixed value: the digits, least first.
DIGITS = "1234567890ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE = len(DIGITS)
LENGTH = 8


def largest(length: int = LENGTH) -> int:
    """Largest integer of one decimal digit less than the digits could hold."""
    return 10 ** (len(str(BASE**length)) - 1) - 1


def encode_uid(n: Column, length: int = LENGTH) -> Column:
    """Integer to text; null outside ``0 .. largest(length)``."""
    n = n.cast("bigint")
    digits = []
    for place in range(length - 1, -1, -1):
        digit = F.call_function("div", n, F.lit(BASE**place).cast("bigint")) % F.lit(BASE)
        digits.append(F.substring(F.lit(DIGITS), (digit + 1).cast("int"), F.lit(1)))
    return F.when((n >= 0) & (n <= F.lit(largest(length))), F.concat(*digits))


def decode_uid(text: Column, length: int = LENGTH) -> Column:
    """Text to integer; null for other characters, too much text or too large a number."""
    # The first digit is zero, so padding with it leaves the number as it is and fixes the places.
    padded = F.lpad(text, length, DIGITS[0])
    number = F.lit(0).cast("bigint")
    for place in range(length):
        digit = F.call_function("instr", F.lit(DIGITS), F.substring(padded, place + 1, 1)) - F.lit(1)
        number = number * F.lit(BASE) + digit.cast("bigint")
    well_formed = (F.length(text) <= length) & text.rlike(r"^[0-9A-Za-z]*\z")
    return F.when(well_formed & (number <= F.lit(largest(length))), number)


def key_hash(*keys: Column, algorithm: str = "xxhash64") -> Column:
    """A non-negative 60-bit number per key: ``xxhash64`` (fast) or ``md5`` (any engine can recompute it)."""
    if algorithm == "xxhash64":
        return F.pmod(F.xxhash64(*keys), F.lit(2**60))
    if algorithm == "md5":
        # Each part with its length before it, so that no two lists of parts give the same text; null has none.
        parts = [key.cast("string") for key in keys]
        text = F.concat(*[F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts])
        return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
    raise ValueError(f"unknown algorithm {algorithm!r}")


def with_uid(df: DataFrame, keys: list[str], uid: str = "uid", algorithm: str = "xxhash64") -> DataFrame:
    """Give every row an identifier that depends on its keys only, so a recomputed task gives the same one."""
    number = key_hash(*[ref(key) for key in keys], algorithm=algorithm) % F.lit(largest() + 1)
    return df.withColumn(uid, encode_uid(number))


def uid_collisions(df: DataFrame, keys: list[str], uid: str = "uid") -> DataFrame:
    """Identifiers that stand for more than one key (about 10^7 keys is where the first are to be expected)."""
    distinct = df.groupBy(ref(uid).alias(uid), *[ref(key) for key in keys]).agg(F.count("*").alias("rows"))
    return distinct.groupBy(uid).agg(F.count("*").alias("keys")).where("keys > 1")
