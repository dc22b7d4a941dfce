"""Neighbours against brute force: exact where everything is visited, by recall elsewhere."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from qualframe.llm import neighbours

RNG = np.random.default_rng(3)


def truth(rows, k):
    usable = [(i, np.array(v, float)) for i, v in rows
              if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in usable:
        if i % 20 == 0:
            scored = sorted((-(v * q).sum(), j) for j, v in usable if j != i and len(v) == len(q))[:k]
            out[i] = [(j, -s) for s, j in scored]
    return out


def answers(found):
    out = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_small_tables_ties_and_unusable_vectors(spark):
    same = [0.5, -0.25, 1.0]
    rows = [(i, same) for i in range(60)] + [(60, [0.0, 0.0, 0.0]), (61, None), (62, [1.0, None, 2.0]), (63, [float("nan"), 1.0, 1.0]),
                                            (64, [float("inf"), 1.0, 1.0]), (65, []), (None, same), (80, [-1.0, 0.0, 0.0]), (100, [3.0, 1.0, 2.0])]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<float>, leaf string")
    found = answers(neighbours.search(table, F.col("vec_id") % 20 == 0).collect())
    assert found == truth(rows, 20)


def test_fewer_candidates_than_asked_for_and_none(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])], "vec_id bigint, embedding array<float>")
    assert answers(neighbours.search(table, F.col("vec_id") == 0).collect()) == {0: [(1, 0.5), (2, 0.0)]}
    assert neighbours.search(table.limit(0), F.col("vec_id") == 0).count() == 0
    assert neighbours.search(table, F.col("vec_id") == 7).count() == 0


def test_every_length_of_vectors_is_searched(spark):
    """A length with a tree, a second one nearly as frequent, and rare ones that are one leaf each."""
    rows = [(i, [float(x) for x in RNG.normal(size=8 if i % 2 else 5)]) for i in range(1_300)]
    rows += [(2_000 + i, [float(x) for x in RNG.normal(size=3 + i % 2 * 9)]) for i in range(90)] + [(3_000, [1.0] * 40)]
    table = spark.createDataFrame([(*r, "x", 1, True) for r in rows], "vec_id bigint, embedding array<double>, vector string, leaf int, asks boolean").repartition(4)
    found, wanted = answers(neighbours.search(table, F.col("vec_id") % 20 == 0, recall=1.0).collect()), truth(rows, 20)
    assert {q: w for q, w in wanted.items() if q >= 2_000 and w} == {q: f for q, f in found.items() if q >= 2_000}
    tree = [q for q in wanted if q < 2_000]
    assert set(tree) <= set(found) and sum(len(set(found[q]) & set(wanted[q])) for q in tree) >= 0.9 * 20 * len(tree)


def test_recall_on_clusters(spark):
    centres = RNG.normal(size=(40, 16))
    points = centres[RNG.integers(40, size=4_000)] + 0.3 * RNG.normal(size=(4_000, 16))
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4)
    found, wanted = answers(neighbours.search(table, F.col("vec_id") % 20 == 0).collect()), truth(rows, 20)
    hits = sum(len({j for j, _ in found[q]} & {j for j, _ in wanted[q]}) for q in wanted)
    assert set(found) == set(wanted) and hits >= 0.9 * 20 * len(wanted)


@pytest.mark.parametrize("copies", [1, 30, 400])
def test_best_is_exact_with_any_number_of_ties(copies):
    rows = np.concatenate([np.tile(RNG.normal(size=8), (copies, 1)), RNG.normal(size=(200, 8))])
    ids = RNG.permutation(len(rows)).astype(np.int64)
    queries = np.concatenate([rows[:3], RNG.normal(size=(5, 8))])
    query_ids = np.concatenate([ids[:3], [10_000, 10_001, 10_002, 10_003, 10_004]])
    found = neighbours.best(queries, query_ids, rows, ids, 20).to_pydict()
    got = list(zip(found["query_id"], found["vec_id"], found["score"]))
    wanted = []
    for q, i in zip(queries, query_ids.tolist()):
        wanted += [(i, j, -s) for s, j in sorted((-(r * q).sum(), j) for r, j in zip(rows, ids.tolist()) if j != i)[:20]]
    assert got == wanted
