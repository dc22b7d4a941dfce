"""Discrete quantiles of whole numbers of any size against a sorted list."""

import math
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from qualframe.document import DocumentError
from qualframe.operators import whole_quantiles
from qualframe.operators.whole_quantiles import discrete_quantiles

P = [0.0, 0.001, 0.25, 0.5, 0.999, 1.0]


def expected(values):
    kept = sorted(v for v in values if v is not None)
    return {p: kept[max(1, len(kept) - math.floor(len(kept) - p * len(kept))) - 1] if kept else None for p in P}


def test_numbers_that_doubles_do_not_tell_apart(spark):
    near = 2 ** 62
    longs = [near + i * 7 % 5_003 for i in range(4_000)] + [-near - i for i in range(10)] + [2 ** 63 - 1, -2 ** 63, None]
    tiny = [Decimal(f"{10 ** 20}.{i * 37 % 3_001:010}") for i in range(len(longs) - 3)] + [Decimal("-" + "9" * 27 + ".9999999999"), Decimal("9" * 28), None]
    df = spark.createDataFrame(list(zip(longs, tiny)), "a bigint, d decimal(38,10)").repartition(4)
    found = discrete_quantiles(df, {"a": P, "d": P})
    assert found["a"] == expected(longs) and found["d"] == expected(tiny)
    assert len({float(v) for v in longs[:4_000]}) < 50  # what a double makes of them


def test_the_whole_range_of_38_digits(spark):
    values = [Decimal("9" * 38), Decimal("-" + "9" * 38)] + [Decimal(i) * Decimal(10) ** 33 for i in range(-40, 41)] + [Decimal(0)] * 500
    df = spark.createDataFrame([(v,) for v in values], "d decimal(38,0)").repartition(3)
    assert discrete_quantiles(df, {"d": P})["d"] == expected(values)


@pytest.mark.parametrize("cells", [2, 1024])
def test_hot_values_times_and_nothing(spark, monkeypatch, cells):
    monkeypatch.setattr(whole_quantiles, "CELLS", cells)
    values = [5] * 3_000 + list(range(-50, 1_000, 3))
    df = spark.createDataFrame([(v,) for v in values], "v int").selectExpr(
        "v", "CAST(NULL AS bigint) AS nothing", "CAST(v AS decimal(9,2)) / 4 AS share", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, v) AS t", "CAST(v AS double) AS x")
    found = discrete_quantiles(df, {"v": P, "nothing": P, "t": [0.5]})
    assert found["v"] == expected(values) and found["nothing"] == dict.fromkeys(P)
    start = 1_704_067_200_000_000
    assert found["t"][0.5] == start + expected(values)[0.5] * 3_600_000_000
    with pytest.raises(DocumentError):
        discrete_quantiles(df, {"x": [0.5]})


@settings(max_examples=6, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-2 ** 63, 2 ** 63 - 1)), min_size=1, max_size=40))
def test_any_numbers(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    assert discrete_quantiles(df, {"v": P})["v"] == expected(values)
