"""Hard negatives against all scores in plain Python, and the product against whole numbers of any size."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from qualframe.llm import negatives

RNG = np.random.default_rng(11)
DDL = "vec_id bigint, label int, embedding array<double>"


def expected(rows, anchors=100, positives=5, size=10):
    fits = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows if None not in (i, lab, v)
            and all(x is not None and math.isfinite(x) and abs(x) < 2 ** 55 for x in v)]
    out = []
    for i, lab, v in {(i, lab, tuple(v)) for i, lab, v in fits if i % anchors == 0}:
        scored = [(-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in fits if j != i and len(w) == len(v)]
        for s, j, _ in sorted(x for x in scored if x[2] == lab)[:positives]:
            near = sorted(x[:2] for x in scored if x[2] != lab and 30 * -s <= 100 * -x[0] <= 90 * -s)[:size]
            out += [(i, j, rank, k, -s, -t) for rank, (t, k) in enumerate(near, 1)]
    return sorted(out)


def check(spark, rows, ddl=DDL, **sizes):
    table = spark.createDataFrame(rows, ddl).repartition(3)
    found = negatives.mine(table, F.col("vec_id") % 100 == 0, F.col("label"), **sizes).collect()
    assert sorted(map(tuple, found)) == expected([r[:3] for r in rows])
    return found


def vectors(n, width, labels=4, spread=1.0):
    centre = RNG.normal(size=width)
    return [(i, int(RNG.integers(labels)), [float(x) for x in centre + spread * RNG.normal(size=width)]) for i in range(n)]


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 200, 5), (64, 64, 64), (100, 130, 257), (129, 65, 200), (5, 0, 7)])
def test_product_is_exact(shape):
    n, k, m = shape
    a, b = RNG.integers(-2 ** 31, 2 ** 31, (n, k)), RNG.integers(-2 ** 15, 2 ** 15, (k, m))
    assert (negatives.product(a, b) == a.astype(object) @ b.astype(object)).all()
    # Sums between beyond 64 bits wrap round and come back.
    far = np.full((n, k), 2 ** 62), np.where(np.arange(k)[:, None] % 2 == np.zeros(m, int), 1, -1)
    assert (negatives.product(*far) == far[0].astype(object) @ far[1].astype(object)).all() or k % 2


def test_negatives_match_all_scores(spark, monkeypatch):
    monkeypatch.setattr(negatives, "TILE", 48)
    monkeypatch.setattr(negatives, "BLOCK", 64 * 90)
    monkeypatch.setattr(negatives, "GROUP", 64 * 2)
    assert len(check(spark, vectors(600, 64))) > 50


def test_ties_copies_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(negatives, "TILE", 16)
    monkeypatch.setattr(negatives, "BLOCK", 3 * 40)
    same = [1.0, -0.5, 2.0]
    rows = [(i, i % 3, [x * (1 + i % 4 // 3 * -0.3) for x in same]) for i in range(220)] + [(0, 0, same)] * 3 + [(7, 1, same)] * 50 + [(100, 2, [0.5, 0.5, 0.5])]
    check(spark, rows)


def test_rows_that_take_no_part_other_lengths_and_clashing_columns(spark):
    good = vectors(130, 3)
    odd = [(200, 1, None), (300, None, [1.0, 1.0, 1.0]), (None, 1, [1.0, 1.0, 1.0]), (400, 1, [1.0, None, 1.0]), (500, 1, [float("nan"), 1.0, 1.0]),
           (501, 1, [float("inf"), 1.0, 1.0]), (502, 1, [2.0 ** 55, 1.0, 1.0]), (503, 1, [0.0, 0.0, 0.0]), (600, 1, []), (601, 1, []), (602, 2, []),
           (700, 2, [1.0, 2.0]), (701, 2, [1.0, 1.0]), (702, 1, [0.5, 0.5]), (703, 1, [5.0, 5.0])]
    found = check(spark, [r + (1, "x", [2]) for r in good + odd], DDL + ", length int, anchor string, vector array<int>")
    assert {r.anchor_id for r in found} >= {600, 700}
    assert negatives.mine(spark.createDataFrame([], DDL), F.col("vec_id") % 100 == 0, F.col("label")).count() == 0
    assert negatives.mine(spark.createDataFrame([(1, 1, [1.0])], DDL), F.col("vec_id") % 100 == 0, F.col("label")).count() == 0


def test_negative_and_zero_scores(spark):
    rows = [(0, 0, [1.0, 0.0]), (1, 0, [-1.0, 0.0]), (2, 1, [-0.5, 0.0]), (3, 0, [0.0, 1.0]), (4, 1, [0.0, 2.0]), (5, 1, [0.001, 0.0])]
    found = check(spark, rows)
    assert {(r.positive_id, r.negative_id) for r in found} == {(3, 4), (3, 5)}  # only a score of 0 lies in the window of 0
