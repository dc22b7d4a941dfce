"""Hard negatives: for an anchor and one of its positives, rows of other labels that are nearly, but not quite, as near as the positive.

Components are whole numbers, so every score is exact. Anchors (a stated set) meet all rows in tiles: groups of anchors and blocks of rows of
the same vector length, each pair one task's work. Within a tile the scores are the product of two whole-number matrices, padded with zeros and
multiplied by Strassen's recursion: seven products of half the size instead of eight. Additions wrap at 64 bits, which leaves every score that fits into
64 bits exact whatever the sums between.

Two passes over the tiles, each keeping heaps that can be merged: the first keeps for every anchor the best rows of its label, the second, for
every anchor and positive, the best rows of other labels whose scores lie in the positive's window. A task merges the heaps of its tiles, Spark those of
the tasks: the partial step of a ranking window cuts each task's rows to the heap's size before they are shuffled.

Blocks are drawn by a hash of id and row, so copies of one row or id are spread; their rows are fewer the longer the vectors. Work grows with anchors x rows, as asked for; nothing else does.

Defined results: rows with a null id, a null label, a null vector, or null or non-finite components take no part, nor do components
of 2^55 and more, whose whole numbers do not fit 64 bits; vectors of zeros and empty ones do; a row meets rows of its own vector length only, and none with
its own id; ties go to the smaller id; repeated rows are each a candidate, repeated anchors are one; an anchor without positives, or a positive without
rows in its window, gives no rows; an empty table gives none; the names of the table cannot clash with those made here.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qualframe.llm.common import SENT, stored, travels

travels(__name__)

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
# The window of a negative's score, in hundredths of the positive's.
FROM, TO = 30, 90
# Components of rows, and of anchors, that meet in one task, about, and the side of the tiles that are multiplied there.
BLOCK, GROUP, TILE = 1 << 20, 1 << 17, 1_024
# Matrices with a side below this are multiplied directly.
DIRECT = 32
MOST = np.iinfo(np.int64).max


def usable(vector: Column) -> Column:
    fits = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 2.0 ** 55))
    return F.coalesce(vector.isNotNull() & fits, F.lit(False))


def _strassen(a: np.ndarray, b: np.ndarray, levels: int) -> np.ndarray:
    """The product of matrices whose sides are multiples of 2 ** levels."""
    if not levels:
        return a @ b
    n, k, m = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:n, :k], a[:n, k:], a[n:, :k], a[n:, k:]
    b11, b12, b21, b22 = b[:k, :m], b[:k, m:], b[k:, :m], b[k:, m:]
    times = lambda x, y: _strassen(x, y, levels - 1)
    p1, p2, p3 = times(a11 + a22, b11 + b22), times(a21 + a22, b11), times(a11, b12 - b22)
    p4, p5 = times(a22, b21 - b11), times(a11 + a12, b22)
    out = np.empty((2 * n, 2 * m), np.int64)
    out[:n, :m] = p1 + p4 - p5 + times(a12 - a22, b21 + b22)
    out[:n, m:], out[n:, :m] = p3 + p5, p2 + p4
    out[n:, m:] = p1 - p2 + p3 + times(a21 - a11, b11 + b12)
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` of int64 matrices: padded with zeros to sides that can be halved while all of them are ``DIRECT`` or more."""
    (n, k), m, levels = a.shape, b.shape[1], 0
    while min(n, k, m) >> levels >= 2 * DIRECT:
        levels += 1
    step = 1 << levels
    padded = lambda x: np.pad(x, [(0, -side % step) for side in x.shape])
    return _strassen(padded(a), padded(b), levels)[:n, :m]


class Heaps:
    """The best ``size`` rows of each slot, best first: by score, then by the smaller id. Rows are offered in order of their ids."""

    def __init__(self, slots: int, size: int) -> None:
        self.size = size
        self.slot, self.score, self.row = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        # A full heap takes in higher scores only, as equal ones come with larger ids.
        self.full, self.floor = np.zeros(slots, bool), np.zeros(slots, np.int64)

    def wants(self, scores: np.ndarray, slots: np.ndarray) -> np.ndarray:
        return ~self.full[slots][:, None] | (scores > self.floor[slots][:, None])

    def merge(self, slot: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        slot, score, row = np.concatenate([self.slot, slot]), np.concatenate([self.score, score]), np.concatenate([self.row, row])
        # The complement turns the order of scores round, without a sign that could overflow.
        order = np.lexsort((row, ~score, slot))
        slot, score, row = slot[order], score[order], row[order]
        first = np.searchsorted(slot, slot)
        kept = np.arange(len(slot)) - first < self.size
        self.slot, self.score, self.row = slot[kept], score[kept], row[kept]
        last = np.flatnonzero(np.arange(len(slot)) - first == self.size - 1)
        self.full[slot[last]] = True
        self.floor[slot[last]] = score[last]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    return flat.reshape(len(column), len(flat) // len(column))


def _sorted(table: pa.Table, key: str) -> pa.Table:
    return table.take(pa.array(np.argsort(table[key].to_numpy(), kind="stable")))


def _tiles(anchors: pa.Table, rows: pa.Table) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Scores of anchors and rows, tile by tile, rows in order of their ids within every tile of anchors."""
    left, right = _matrix(anchors["vector"]), _matrix(rows["vector"])
    for i in range(0, len(left), TILE):
        for j in range(0, len(right), TILE):
            yield slice(i, min(i + TILE, len(left))), slice(j, min(j + TILE, len(right))), product(left[i:i + TILE], right[j:j + TILE].T)


def best_positives(anchors: pa.Table, rows: pa.Table, size: int = POSITIVES) -> pa.Table:
    """The best rows of each anchor's label: ``anchor``, ``positive_id``, ``positive_score``."""
    rows = _sorted(rows, "vec_id")
    ids, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
    own_ids, own_labels = anchors["vec_id"].to_numpy(), anchors["label"].to_numpy()
    heaps = Heaps(len(anchors), size)
    for a, r, scores in _tiles(anchors, rows):
        slots = np.arange(a.start, a.stop)
        open_ = (own_labels[a][:, None] == labels[r]) & (own_ids[a][:, None] != ids[r]) & heaps.wants(scores, slots)
        i, j = np.nonzero(open_)
        heaps.merge(slots[i], scores[i, j], ids[r][j])
    return pa.table({"anchor": anchors["anchor"].to_numpy()[heaps.slot], "positive_id": heaps.row, "positive_score": heaps.score})


def windows(scores: list[int], low: int = FROM, high: int = TO) -> tuple[list[int], list[int]]:
    """Least and largest score within ``low`` to ``high`` hundredths of each score (an empty window where low is above high)."""
    return [min(-(-low * s // 100), MOST) for s in scores], [max(high * s // 100, -MOST - 1) for s in scores]


def best_negatives(anchors: pa.Table, rows: pa.Table, size: int = NEGATIVES) -> pa.Table:
    """The best rows of other labels in each positive's window: ``anchor``, ``place`` of the positive, ``negative_id``, ``negative_score``."""
    rows = _sorted(rows, "vec_id")
    ids, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
    own_labels = anchors["label"].to_numpy()
    bounds = [windows(scores) for scores in anchors["scores"].to_pylist()]
    most = max(len(low) for low, _ in bounds)
    # A window that no score is in fills up the anchors with fewer positives.
    low = np.array([lo + [MOST] * (most - len(lo)) for lo, _ in bounds], np.int64)
    high = np.array([hi + [-MOST - 1] * (most - len(hi)) for _, hi in bounds], np.int64)
    heaps = Heaps(len(anchors) * most, size)
    for a, r, scores in _tiles(anchors, rows):
        other = own_labels[a][:, None] != labels[r]
        for place in range(most):
            slots = np.arange(a.start, a.stop) * most + place
            i, j = np.nonzero(other & (scores >= low[a, place][:, None]) & (scores <= high[a, place][:, None]) & heaps.wants(scores, slots))
            heaps.merge(slots[i], scores[i, j], ids[r][j])
    return pa.table({"anchor": anchors["anchor"].to_numpy()[heaps.slot // most], "place": (heaps.slot % most).astype(np.int32),
                     "negative_id": heaps.row, "negative_score": heaps.score})


def mine(table: DataFrame, is_anchor: Column, label: Column, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE,
         positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of the anchors' hard negatives.

    Components are taken as whole numbers, the floor of ``scale`` times their value.
    """
    wide = table.select(table[f"`{key}`"].cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"),
                        table[f"`{vector}`"].cast("array<double>").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    whole = wide.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector"))).select(
        "vec_id", "label", "asks", F.transform("vector", lambda x: F.floor(x * scale)).alias("vector"))
    # Rows are told apart by a number that is written with them, so that it stays what it is when a task is repeated.
    rows = stored(whole.select("*", F.size("vector").alias("length"), F.monotonically_increasing_id().alias("row")), "whole-vectors")
    counts = rows.groupBy("length").agg(F.count("*").alias("n"), F.count_if("asks").alias("asked"))
    grid = stored(counts.where("asked > 0").select("length", *[
        F.greatest(F.ceil(F.col(n) * F.col("length") / F.lit(size)), F.lit(1)).cast("int").alias(name) for n, size, name in (("n", BLOCK, "blocks"), ("asked", GROUP, "groups"))]), "grid")
    sent = F.broadcast(grid) if grid.count() <= SENT // 100 else grid  # a row for every length of vectors
    number = lambda key, many: F.pmod(F.xxhash64(*key), many).cast("int")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.col(many) - 1))

    blocks = rows.join(sent, "length").select(
        "length", number(["vec_id", "row"], "blocks").alias("block"), every("groups").alias("group"), "vec_id", "label", "vector")
    # Equal rows that are anchors are one; its row number stands for it.
    fresh = [F.col(c).alias(c) for c in ("length", "vec_id", "label", "vector")]  # columns of their own, as both sides come from one table
    asked = rows.where("asks").groupBy(*fresh).agg(F.min("row").alias("anchor"))
    cells = ["length", "block", "group"]

    def met(anchors: DataFrame, more: list[str], best, found: str) -> DataFrame:
        groups = anchors.join(sent, "length").select(
            "length", every("blocks").alias("block"), number(["anchor"], "groups").alias("group"), "anchor", "vec_id", "label", "vector", *more)
        return groups.groupBy(*cells).cogroup(blocks.groupBy(*cells)).applyInArrow(best, found)

    def first(found: DataFrame, by: list[str], score: str, row: str, size: int) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc(score), row)
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)

    def own(left: pa.Table, right: pa.Table) -> pa.Table:
        return best_positives(left, right, positives) if len(left) and len(right) else _NO_POSITIVES

    def other(left: pa.Table, right: pa.Table) -> pa.Table:
        return best_negatives(left, right, negatives) if len(left) and len(right) else _NO_NEGATIVES

    near = first(met(asked, [], own, "anchor bigint, positive_id bigint, positive_score bigint"), ["anchor"], "positive_score", "positive_id", positives)
    # At most ``positives`` structs for each anchor.
    listed = stored(near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("near")), "positives")
    known = asked.join(listed.select("anchor", F.col("near.positive_score").alias("scores")), "anchor")
    hard = met(known, ["scores"], other, "anchor bigint, place int, negative_id bigint, negative_score bigint")
    ranked = first(hard, ["anchor", "place"], "negative_score", "negative_id", negatives)
    ids = asked.select("anchor", F.col("vec_id").alias("anchor_id"))
    each = listed.join(ids, "anchor").select("anchor", "anchor_id", F.posexplode("near").alias("place", "near"))
    return ranked.join(each, ["anchor", "place"]).select(
        "anchor_id", F.col("near.positive_id").alias("positive_id"), "rank", "negative_id", F.col("near.positive_score").alias("positive_score"), "negative_score")


_NO_POSITIVES = pa.table({"anchor": np.zeros(0, np.int64), "positive_id": np.zeros(0, np.int64), "positive_score": np.zeros(0, np.int64)})
_NO_NEGATIVES = pa.table({"anchor": np.zeros(0, np.int64), "place": np.zeros(0, np.int32), "negative_id": np.zeros(0, np.int64), "negative_score": np.zeros(0, np.int64)})
