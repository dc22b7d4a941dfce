"""Approximate nearest neighbours by inner product, on a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample (``SAMPLE`` vectors) and kept on the driver and in every task; every row is
assigned to a leaf. A query walks the tree with a priority queue, nearest centre first, and lists the leaves to visit. How many it
visits is calibrated: for a bounded set of queries the true neighbours are found by brute force over all rows, and the number
of visits is widened until the leaves visited hold ``RECALL`` of them.

Leaves and queries meet in cells of bounded size: a leaf with many rows (a vector with countless copies) is cut into blocks,
its queries into groups, and every pair of block and group is one task's small product, which returns the best rows of each
query. So no leaf, however full, is one task.

Vectors of different lengths never meet: each length has a tree of its own, and lengths of no more rows than a leaf holds are one leaf each.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components,
and rows without an id take no part; a query meets rows of its own length; ties go to the smaller id; a query meets every row but those with its own id;
with fewer candidates than asked for, all are returned; repeated rows are each a candidate; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from functools import reduce
from typing import Iterator, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qualframe.llm.common import stored, travels

travels(__name__)

SAMPLE, BRANCHES, LEAF, ROUNDS = 8_192, 8, 256, 10
CALIBRATED, RECALL = 256, 0.95
# Rows, and queries, that meet in one cell, about.
CELL_ROWS, CELL_QUERIES = 4_096, 4_096
FOUND = "query_id bigint, vec_id bigint, score double"


class Tree(NamedTuple):
    """Nodes in breadth-first order; the children of node k are ``first[k]`` up to ``last[k]``, leaves have none."""

    centres: np.ndarray
    first: np.ndarray
    last: np.ndarray
    leaf: np.ndarray  # number of the leaf, -1 for inner nodes

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres ** 2).sum(axis=1) - 2 * points @ centres.T, axis=1)


def _means(points: np.ndarray, number: int, rng: np.random.Generator) -> np.ndarray:
    centres = points[rng.choice(len(points), number, replace=False)]
    for _ in range(ROUNDS):
        near = _nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        counts = np.bincount(near, minlength=number)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def build(points: np.ndarray) -> Tree:
    """K-means of the points, again within each cluster, until clusters are small or all their points are equal."""
    rng = np.random.default_rng(7)
    centres, members = [points.mean(axis=0)], [np.arange(len(points))]
    first, last, leaf, node, leaves = [], [], [], 0, 0
    while node < len(centres):
        own = members[node]
        near = np.zeros(0, int)
        if len(own) > LEAF and (points[own] != points[own[0]]).any():
            found = _means(points[own], min(BRANCHES, len(own)), rng)
            near = _nearest(points[own], found)
        kinds = np.unique(near)
        first.append(len(centres))
        if len(kinds) > 1:
            for kind in kinds:
                centres.append(found[kind])
                members.append(own[near == kind])
        last.append(len(centres))
        leaf.append(-1 if len(kinds) > 1 else leaves)
        leaves += len(kinds) <= 1
        members[node] = None
        node += 1
    return Tree(np.array(centres), np.array(first), np.array(last), np.array(leaf))


def assign(tree: Tree, points: np.ndarray) -> np.ndarray:
    """The leaf of each point: down the tree, to the nearest centre at each node."""
    at = np.zeros(len(points), np.int64)
    while True:
        inner = np.flatnonzero(tree.leaf[at] < 0)
        if not len(inner):
            return tree.leaf[at]
        for node in np.unique(at[inner]):
            here = inner[at[inner] == node]
            a, b = tree.first[node], tree.last[node]
            at[here] = a + _nearest(points[here], tree.centres[a:b])


def visits(tree: Tree, query: np.ndarray, rows: np.ndarray, number: int, least: int) -> list[int]:
    """Leaves in the order of a best-bin-first walk, until ``number`` leaves with at least ``least`` rows in all."""
    queue, out, held = [(0.0, 0)], [], 0
    while queue and (len(out) < number or held < least):
        _, node = heapq.heappop(queue)
        if tree.leaf[node] >= 0:
            if rows[tree.leaf[node]]:
                out.append(int(tree.leaf[node]))
                held += int(rows[tree.leaf[node]])
            continue
        a, b = tree.first[node], tree.last[node]
        for child, score in zip(range(a, b), (tree.centres[a:b] @ query).tolist()):
            heapq.heappush(queue, (-score, child))
    return out


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length, one row each."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // max(len(column), 1))


def best(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> pa.Table:
    """The ``k`` best rows of each query among ``rows``, by exact inner products; ties to the smaller id.

    A matrix product finds who can be among the best, with a margin for its rounding; their products are then computed the
    same way for every row, so that equal vectors have equal scores wherever they are.
    """
    order = np.argsort(row_ids, kind="stable")
    rows, row_ids = rows[order], row_ids[order]
    longest = np.linalg.norm(rows, axis=1).max() if len(rows) else 0.0
    taken, found = min(len(rows), k + 8), []
    for start in range(0, len(queries), 256):
        asked, ids = queries[start:start + 256], query_ids[start:start + 256]
        rough = asked @ rows.T
        for q, (low, high) in enumerate(zip(np.searchsorted(row_ids, ids), np.searchsorted(row_ids, ids, "right"))):
            rough[q, low:high] = -np.inf
        near = np.argpartition(-rough, taken - 1, axis=1)[:, :taken] if taken < len(rows) else np.tile(np.arange(len(rows)), (len(asked), 1))
        values = np.take_along_axis(rough, near, axis=1)
        exact = np.where(np.isneginf(values), -np.inf, (rows[near] * asked[:, None, :]).sum(axis=2))
        first = np.lexsort((row_ids[near], -exact), axis=1)[:, :k]
        near, exact = np.take_along_axis(near, first, axis=1), np.take_along_axis(exact, first, axis=1)
        if taken < len(rows):
            # More rows tie with the last one than were taken: look at all of them.
            margin = 1e-12 * np.linalg.norm(asked, axis=1) * longest
            floor = -np.partition(-values, k - 1, axis=1)[:, k - 1] - margin
            for q in np.flatnonzero(values.min(axis=1) >= floor):
                tied = np.flatnonzero(rough[q] >= floor[q])
                score = (rows[tied] * asked[q]).sum(axis=1)
                chosen = np.lexsort((row_ids[tied], -score))[:k]
                near[q, :len(chosen)], exact[q, :len(chosen)] = tied[chosen], score[chosen]
        real = ~np.isneginf(exact)
        found.append((np.repeat(ids, real.sum(axis=1)), row_ids[near[real]], exact[real]))
    columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.table(dict(zip(("query_id", "vec_id", "score"), columns)))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)


def fit(vectors: DataFrame, sample: int = SAMPLE) -> Tree:
    """The tree of a bounded sample (smallest hashes of id) of vectors of one length."""
    taken = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vector").toArrow()
    return build(_vectors(taken["vector"]).astype(np.float64, copy=False))


def search(table: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding",
           sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the ``k`` nearest rows found for each row that is a query."""
    spark = table.sparkSession
    vectors = table.select(table[f"`{key}`"].cast("bigint").alias("vec_id"), table[f"`{vector}`"].cast("array<double>").alias("vector"),
                           F.coalesce(is_query, F.lit(False)).alias("asks")).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    lengths = {r["length"]: r["n"] for r in vectors.groupBy(F.size("vector").alias("length")).agg(F.count("*").alias("n")).collect()}  # a row per length
    large = sorted(length for length, n in lengths.items() if n > LEAF)
    parts = [_in_tree(vectors.where(F.size("vector") == length), k, sample, recall) for length in large]
    if len(large) < len(lengths):
        few = vectors if not large else vectors.where(~F.size("vector").isin(large))
        parts.append(_in_leaves(stored(few.withColumn("leaf", F.size("vector")), "leaves"), k))
    found = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], FOUND)
    return _ranked(found, k).select("query_id", "rank", "vec_id", "score")


def _in_tree(vectors: DataFrame, k: int, sample: int, recall: float) -> DataFrame:
    """Rows found for each query among vectors of one length."""
    tree = fit(vectors, sample)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("leaf", pa.array(assign(tree, _vectors(batch.column(1))), pa.int32()))

    index = stored(vectors.mapInArrow(placed, "vec_id bigint, vector array<double>, asks boolean, leaf int"), "leaves")
    queries = index.where("asks").select(F.col("vec_id").alias("query_id"), "vector")
    held = _counted(index)
    rows = np.array([held.get(leaf, 0) for leaf in range(tree.leaves)], np.int64)
    number = _calibrated(index, queries, tree, rows, k, recall)

    def walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                listed = [visits(tree, p, rows, number, k + 1) for p in _vectors(part.column(1))]
                yield part.append_column("leaves", pa.array(listed, pa.list_(pa.int32())))

    walked = queries.mapInArrow(walks, "query_id bigint, vector array<double>, leaves array<int>").select(
        "query_id", "vector", F.explode("leaves").alias("leaf"))
    return _met(index, walked, held, k)


def _in_leaves(index: DataFrame, k: int) -> DataFrame:
    """The same among vectors whose length is their leaf: every query meets all rows of its leaf."""
    asked = index.where("asks").select(F.col("vec_id").alias("query_id"), F.col("vector").alias("vector"), F.col("leaf").alias("leaf"))
    return _met(index, asked, _counted(index), k)


def _counted(rows: DataFrame) -> dict[int, int]:
    """Rows of every leaf."""
    return {r["leaf"]: r["n"] for r in rows.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # a row per leaf


def _met(index: DataFrame, walked: DataFrame, held: dict[int, int], k: int) -> DataFrame:
    """The ``k`` best rows of each leaf for each query that visits it, cell by cell."""
    asked = _counted(walked)
    grid = index.sparkSession.createDataFrame(
        [(leaf, -(-n // CELL_ROWS), -(-asked.get(leaf, 0) // CELL_QUERIES)) for leaf, n in sorted(held.items())], "leaf int, blocks int, groups int")
    grid = F.broadcast(grid)  # a row per leaf, bounded by the sample and the number of lengths
    blocks = index.join(grid, "leaf").where("groups > 0").select(
        "leaf", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), "vec_id", "vector")
    groups = walked.join(grid, "leaf").select(
        "leaf", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.pmod(F.xxhash64("query_id"), "groups").cast("int").alias("group"), "query_id", "vector")

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        return best(_vectors(left["vector"]), left["query_id"].to_numpy(), _vectors(right["vector"]), right["vec_id"].to_numpy(), k)

    cells = ["leaf", "block", "group"]
    return groups.groupBy(*cells).cogroup(blocks.groupBy(*cells)).applyInArrow(cell, FOUND)


def _calibrated(index: DataFrame, queries: DataFrame, tree: Tree, rows: np.ndarray, k: int, recall: float) -> int:
    """The least number of leaves at which the calibration queries reach ``recall``, their truth found by brute force."""
    chosen = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(CALIBRATED).toArrow()
    if not len(chosen):
        return 1
    asked, points = chosen["query_id"].to_numpy(), _vectors(chosen["vector"])

    def truth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = dict(zip(batch["vec_id"].to_pylist(), batch["leaf"].to_pylist()))
            top = best(points, asked, _vectors(batch["vector"]), batch["vec_id"].to_numpy(), k)
            yield from top.append_column("leaf", pa.array([leaf[i] for i in top["vec_id"].to_pylist()], pa.int32())).to_batches()

    nearest = _ranked(index.mapInArrow(truth, f"{FOUND}, leaf int"), k).select("query_id", "leaf").toArrow()
    walks = {int(q): {leaf: n for n, leaf in enumerate(visits(tree, p, rows, tree.leaves, 0), 1)} for q, p in zip(asked, points)}
    needed = sorted(walks[q][leaf] for q, leaf in zip(nearest["query_id"].to_pylist(), nearest["leaf"].to_pylist()))
    return needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)] if needed else 1
