import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from qualframe.operators.ordering import rank_groups, with_index
from qualframe.operators.quantiles import approximate_quantiles, exact_quantiles

P = [0.0, 0.001, 0.1, 0.5, 0.77, 0.999, 1.0]


def same(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(4)
    found = exact_quantiles(df, {"v": P})["v"]
    assert found.count == len(values)
    for p in P:
        # numpy leaves the last bit to the order of its operations
        assert found.quantiles[p] == pytest.approx(float(np.quantile(np.array(values), p)), rel=1e-12, abs=0.0), p


def test_heavy_tails_and_hot_values(spark):
    rng = np.random.default_rng(5)
    same(spark, np.concatenate([
        rng.lognormal(0, 40, 2000), -rng.lognormal(0, 90, 2000), np.full(3000, 7.5), [1.7e308, -1.7e308, 5e-324, 0.0, -0.0]]))


def test_few_values(spark):
    same(spark, [3.0])
    same(spark, [2.0, 1.0])
    same(spark, [4.0] * 50)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.floats(allow_nan=False, allow_infinity=False, width=32), min_size=1, max_size=60))
def test_any_values(spark, values):
    same(spark, values)


def test_infinities_nulls_and_nan(spark):
    values = [math.inf] * 3 + [-math.inf] * 4 + [1.0, 2.0, 3.0, float("nan"), None]
    df = spark.createDataFrame([(v, 1) for v in values], "v double, w int")
    found = exact_quantiles(df, {"v": [0.0, 0.5, 1.0], "w": [0.5]})
    assert found["v"].count == 10
    assert found["v"].quantiles == {0.0: -math.inf, 0.5: 1.5, 1.0: math.inf}
    assert found["w"].quantiles == {0.5: 1.0}


def test_nothing_to_rank(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "v double")
    assert exact_quantiles(df, {"v": [0.5]})["v"].quantiles == {0.5: None}


def test_approximate(spark):
    found = approximate_quantiles(spark.range(10_001), {"id": [0.5]})["id"]
    assert abs(found.quantiles[0.5] - 5000) <= 2


def test_index_follows_the_order(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") < 1000, 5).otherwise(F.col("id") % 40).alias("a"), (F.col("id") % 7).alias("b"))
    found = sorted((r["n"], r.a, r.b) for r in with_index(df, [F.col("a").desc()], "n").collect())
    assert [n for n, _, _ in found] == list(range(3000))
    assert [(a, b) for _, a, b in found] == sorted(((r.a, r.b) for r in df.collect()), key=lambda t: (-t[0], t[1]))


def test_no_task_holds_more_than_its_share_of_copies(spark):
    df = spark.range(40_000).select((F.col("id") % 3).alias("a"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # Spark joins small partitions, whatever is in them
    try:
        numbered = with_index(df, [F.col("a")], "n")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in numbered.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 3 * 40_000 / 8
    assert numbered.groupBy("a").agg(F.min("n").alias("lo"), F.max("n").alias("hi")).orderBy("a").collect() == [
        (0, 0, 13333), (1, 13334, 26666), (2, 26667, 39999)]


def test_rank_groups(spark):
    df = spark.range(500).selectExpr("id AS v", "id % 3 AS n")
    found = {r["i"]: (r.v, r.n) for r in rank_groups(df, [F.col("n").desc(), F.col("v")], "i").collect()}
    wanted = sorted(((v, v % 3) for v in range(500)), key=lambda t: (-t[1], t[0]))
    assert [found[i] for i in range(500)] == wanted
