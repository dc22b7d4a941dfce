"""Near-duplicate documents by MinHash with tensored banding, confirmed on full shingle sets.

Two collections of ``SUBKEYS`` sub-keys of ``HASHES`` minhashes each are computed per distinct shingle set; a table's key is a
sub-key of the left collection combined with one of the right. So 2 x 16 x 3 = 96 minhashes serve 256 tables of six hashes,
which would need 1,536. Two sets with a similarity of 0.75 share a key with a probability of 0.9997.

Sub-keys are counted first: only those that two sets share are combined, so documents without a near
copy never reach the tables. Candidates are then found without listing the pairs of a bucket:

1. Each bucket of the tables (i, i) names a leader, the set whose sub-keys are shared most (in a group of edited copies, the
   one closest to them all); members are verified against it, and what is linked becomes one component.
2. Only buckets of any table that still hold several components are open. Their members are joined exactly: two sets that
   are similar enough share one of the rarest shingles of either (the prefix of the set in order of rarity). Pairs
   within a component are never formed, and the places of the shingle bound the overlap.

Equal sets are one node throughout, whatever their number.

Defined results: without words or text a document has no shingles and no link; with fewer words than a shingle its words are one
shingle; a null id takes no part (its component is null, it is kept); rows with the same id are one node; repeated rows stay,
each with the verdict of its id; an empty table gives no rows; other columns are dropped, names cannot clash.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qualframe.llm.common import among, stored, travels
from qualframe.llm.components import components

travels(__name__)

SHINGLE = 5
# Similarity of a link, in hundredths.
SIMILAR = 75
SUBKEYS, HASHES = 16, 3
REMEMBERED = 500_000

_RANDOM = np.random.default_rng(20_240_601)
_FACTORS = _RANDOM.integers(1 << 62, size=2 * SUBKEYS * HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _RANDOM.integers(1 << 63, size=2 * SUBKEYS * HASHES, dtype=np.uint64)
_PLACES = _RANDOM.integers(1 << 62, size=SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Words(dict):
    """64-bit hashes of words."""

    def __missing__(self, word):
        if len(self) >= REMEMBERED:
            self.clear()
        number = self[word] = xxhash.xxh64_intdigest(word)
        return number


def _mixed(value: np.ndarray) -> np.ndarray:
    value = (value ^ (value >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return value ^ (value >> np.uint64(29))


def shingles(text: str | None, known: Words) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text, in which A-Z count as a-z."""
    words = (text or "").encode().lower().split()  # of bytes: ASCII letters, and blanks from tab to carriage return
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if len(words) < SHINGLE:
        return _mixed((hashes * _PLACES[:len(words)]).sum(keepdims=True) + np.uint64(len(words)))
    total = np.zeros(len(words) - SHINGLE + 1, np.uint64)
    for place, factor in enumerate(_PLACES):
        total += hashes[place:len(words) - SHINGLE + 1 + place] * factor
    return np.unique(_mixed(total))


def subkeys(found: np.ndarray) -> np.ndarray:
    """Both collections of sub-keys of a set, left before right."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max)
    for start in range(0, len(found), 1024):
        part = (found[start:start + 1024, None] ^ _MASKS) * _FACTORS
        least = np.minimum(least, part.min(axis=0))
    folded = np.zeros(2 * SUBKEYS, np.uint64)
    for hashes in least.reshape(-1, HASHES).T:
        folded = _mixed(folded * np.uint64(31) + hashes)
    return (folded + np.arange(len(folded), dtype=np.uint64)).view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = Words()
    for batch in batches:
        sizes, digests, keys = [], [], []
        for body in batch.column(1):
            found = shingles(body.as_py(), known)
            sizes.append(len(found))
            digests.append(xxhash.xxh3_128_digest(found.tobytes()))
            keys.append(subkeys(found) if len(found) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
            ["id", "n", "digest", "subkeys"])


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= SIMILAR * (len(a) + len(b) - common)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known, last, one = Words(), None, None
    for batch in batches:
        keep = []
        for a, text_a, text_b in zip(batch["a"].to_pylist(), batch["text_a"], batch["text_b"]):
            if (a, text_a) != last:
                last, one = (a, text_a), shingles(text_a.as_py(), known)
            keep.append(_similar(one, shingles(text_b.as_py(), known)))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of ids whose full sets are similar enough; the texts of one side travel with the pairs."""
    right = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    both = right.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_verified, "a bigint, b bigint").distinct()


def _led(keys: DataFrame) -> DataFrame:
    """Pairs of each bucket's members with its leader: the set whose sub-keys most others share, among equals by hash."""
    leaders = keys.groupBy("key").agg(F.max(F.struct("popular", F.xxhash64("id", "key").alias("h"), "id"))["id"].alias("leader"),
                                      F.count("*").alias("members")).where("members > 1")
    pairs = keys.join(leaders, "key").where("id <> leader")
    return pairs.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()


def _tables(sets: DataFrame, chosen: Column) -> DataFrame:
    """Keys of the tables, each a left sub-key with a right one; only sub-keys that some other set has too."""
    sides = sets.select(*[c for c in sets.columns if c not in ("left", "right")], F.explode("left").alias("l"), "right")
    return sides.withColumn("r", F.explode("right")).where(chosen).withColumn("key", F.xxhash64("l.key", "r.key")).drop("l", "r", "right")


def _prefix_pairs(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs across components that share a shingle in their prefixes, for sets (id, n, component)."""

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([shingles(t.as_py(), known).view(np.int64) for t in batch.column(3)], pa.list_(pa.int64()))],
                ["id", "n", "component", "shingles"])

    sets = members.join(texts, "id").select("id", "n", "component", "text").mapInArrow(
        exploded, "id bigint, n bigint, component bigint, shingles array<bigint>")
    flat = sets.select("id", "n", "component", F.explode("shingles").alias("s"))
    # A shingle that one component alone has can link nothing; it still counts for the order.
    counts = flat.groupBy("s").agg(F.count("*").alias("df"), (F.min("component") != F.max("component")).alias("open"))
    rarest = Window.partitionBy("id").orderBy("df", "s")
    needed = F.call_function("div", F.col("n") * SIMILAR + 99, F.lit(100))
    ranked = flat.join(counts, "s").withColumn("place", F.row_number().over(rarest)).where(F.col("place") <= F.col("n") - needed + 1)
    prefix = stored(ranked.where("open").select("id", "n", "component", "s", "place"), "prefixes")
    x, y = prefix.alias("x"), prefix.alias("y")
    size, rest = F.col("x.n") + F.col("y.n"), F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    fits = (F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * SIMILAR) & ((rest + 1) * (100 + SIMILAR) >= size * SIMILAR)
    met = x.join(y, (F.col("x.s") == F.col("y.s")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.component") != F.col("y.component")) & fits)
    return met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_shingles``, ``component_id`` (smallest id reachable) and ``kept`` (it is the smallest) of every row."""
    plain = docs.select(docs[f"`{key}`"].cast("bigint").alias("id"), docs[f"`{text}`"].cast("string").alias("text"))
    signed = stored(plain.mapInArrow(_signed, "id bigint, n bigint, digest binary, subkeys array<bigint>"), "signatures")
    full = signed.where("id IS NOT NULL AND n > 0")
    nodes = full.groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("subkeys").alias("subkeys"))

    # Sub-keys that at least two sets have, by set.
    single = nodes.select("id", "n", F.posexplode("subkeys").alias("i", "key"))
    shared = single.groupBy("key").agg(F.count("*").alias("sets")).where("sets > 1")
    entry = F.struct((F.col("i") % SUBKEYS).alias("i"), "key")
    sets = stored(single.join(shared, "key").groupBy("id", "n").agg(F.sum("sets").alias("popular"),
        F.collect_list(F.when(F.col("i") < SUBKEYS, entry)).alias("left"),
        F.collect_list(F.when(F.col("i") >= SUBKEYS, entry)).alias("right")).where("size(left) > 0 AND size(right) > 0"), "sets")
    texts = stored(among(plain, stored(sets.select("id").distinct(), "candidates"), "id"), "texts")

    first = stored(confirm(_led(_tables(sets.select("id", "popular", "left", "right"), F.col("l.i") == F.col("r.i"))), texts), "first-links")
    grouped = components(first)
    members = sets.join(grouped, "id", "left").withColumn("component", F.coalesce("component", "id"))
    keys = _tables(members.select("id", "n", "component", "left", "right"), F.lit(True))
    opened = keys.groupBy("key").agg(F.min("component").alias("c"), F.max("component").alias("d")).where("c <> d").select("key")
    unsettled = stored(keys.join(opened, "key", "left_semi").select("id", "n", "component").distinct(), "unsettled")
    second = stored(confirm(_prefix_pairs(unsettled, texts), texts), "second-links")

    # Equal sets are links of their own: every id with the smallest id of its set.
    equal = full.join(nodes.select("digest", F.col("id").alias("node")), "digest")
    classes = components(first.union(second))
    placed = equal.select("id", "node").distinct().join(classes.withColumnRenamed("id", "node"), "node", "left").groupBy("id").agg(
        F.min(F.coalesce("component", "node")).alias("component"))
    return signed.select("id", "n").join(placed, "id", "left").select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.col("component") == F.col("id"), F.lit(True)).alias("kept"))
