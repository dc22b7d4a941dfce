import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from qualframe.operators import binning, fits, series
from qualframe.operators.binning import Axis
from qualframe.operators.profile import describe_text, outliers, rounded, time_summary
from qualframe.plans.profiling import column_details, profile_table, whole_profile

# Cells 0 (underflow) to 41 (overflow) of a published distance histogram, 40 bins on [0, 31).
CELLS = [
    0, 347323, 787366, 564782, 311797, 197494, 118340, 78380, 52769, 42259, 33306, 29594, 28909, 28538, 24076, 18967,
    14708, 10638, 8524, 7777, 7592, 8618, 11619, 18198, 19165, 15143, 9628, 7200, 4912, 3084, 1897, 1190, 951, 791,
    693, 680, 510, 476, 358, 240, 188, 2835,
]


def test_known_histogram_comes_back(spark):
    axis = Axis(40, 0.0, 31.0)
    centres = [(-1.0 if i == 0 else 31.0 if i == 41 else (i - 0.5) * 31 / 40, n) for i, n in enumerate(CELLS)]
    df = spark.createDataFrame(centres, "x double, n int").select("x", F.explode(F.sequence(F.lit(1), F.greatest("n", F.lit(1)))), "n").where("n > 0")
    cells = {r.bin: r["count"] for r in binning.hist1d(df, "x", axis).collect()}
    assert [cells[i] for i in range(42)] == CELLS
    stats = binning.hist_stats(df, "x", axis).first()
    assert (stats.entries, stats.underflow, stats.overflow, stats.in_range) == (2821515, 0, 2835, 2818680)
    assert stats.mean == pytest.approx(3.29, abs=0.01)


def test_edges_and_broken_values(spark):
    values = [0.0, 1.0, 2.5, 10.0, -0.1, 9.999999, float("nan"), None, math.inf, -math.inf]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    cells = {r.bin: r["count"] for r in binning.hist1d(df, "x", Axis(10, 0.0, 10.0)).collect()}
    assert {b: n for b, n in cells.items() if n} == {0: 2, 1: 1, 2: 1, 3: 1, 10: 1, 11: 3}
    assert sum(cells.values()) == len(values) - 1


def test_no_bins():
    with pytest.raises(ValueError):
        Axis(10, 1.0, 1.0)
    with pytest.raises(ValueError):
        Axis(0, 0.0, 1.0)


def test_normalised_area(spark):
    axis = Axis(10, 0, 50)
    density = binning.normalise(binning.hist1d(spark.range(40), "id", axis), axis, 100)
    assert density.where("bin BETWEEN 1 AND 10").agg(F.sum("density")).first()[0] * axis.width == pytest.approx(100)


def test_numpy_agrees_in_two_dimensions(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(0, 1, 2000), rng.normal(0, 2, 2000)
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "x double, y double")
    cells = {(r.bin_x, r.bin_y): r["count"] for r in binning.hist2d(df, "x", "y", Axis(5, -1, 1), Axis(4, -2, 2)).collect()}
    expected, _, _ = np.histogram2d(x, y, bins=(5, 4), range=((-1, 1), (-2, 2)))
    for i in range(5):
        for j in range(4):
            assert cells.get((i + 1, j + 1), 0) == expected[i, j]
    assert sum(cells.values()) == 2000


def test_steps_repeat_points(spark):
    points = spark.createDataFrame([(1.0, 10.0), (2.0, 20.0), (4.0, 5.0), (8.0, 1.0)], "x double, y double")
    x, y = np.array([1.0, 2, 4, 8]), np.array([10.0, 20, 5, 1])
    expected = list(zip(x.repeat(2)[1:], y.repeat(2)[:-1]))
    assert [(r.x, r.y) for r in series.step_series(points).orderBy("seq").collect()] == expected


def test_series_without_x_needs_an_order(spark):
    with pytest.raises(ValueError):
        series.series(spark.range(3), "id")


def test_common_index_rules(spark):
    df = spark.createDataFrame([(1.0, None, 1.0), (None, 1.0, 1.0), (1.0, 1.0, None), (1.0, 1.0, 1.0)], "y double, x double, e double")
    assert series.common_index(df, "y", "x").count() == 3
    assert series.common_index(df, "y", "x", "e").count() == 1
    assert series.common_index(df, "y", ey="e").count() == 2


@pytest.mark.parametrize("degree", [0, 1, 2, 3])
def test_polynomials(spark, degree):
    rng = np.random.default_rng(degree)
    x = rng.uniform(1000, 1010, 300)
    y = 3 - 0.5 * (x - 1005) + 0.25 * (x - 1005) ** 2 + rng.normal(0, 0.1, 300)
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "x double, y double")
    found = [r.value for r in fits.fit(df, f"pol{degree}").orderBy("parameter").collect()]
    fitted = np.polynomial.Polynomial.fit(x, y, degree)
    assert np.polynomial.Polynomial(found)(1004.0) == pytest.approx(fitted(1004.0), rel=1e-6)


def test_fit_refuses_what_has_no_closed_form(spark):
    with pytest.raises(ValueError):
        fits.fit(spark.range(3).selectExpr("id AS x", "id AS y"), "landau")
    with pytest.raises(ValueError):
        fits.fit_polynomial(spark.range(2), "id", "id", 3)


def test_rounding_is_half_even():
    assert [rounded(v) for v in (0.5, 1.5, 2.5, -0.5)] == [0.0, 2.0, 2.0, 0.0]


def test_outliers_without_any_below(spark):
    rows = outliers(spark.range(100), "id", 0.0, 95.0).collect()
    assert [(r.side, r.value) for r in rows] == [("low", 0.0)] * 10 + [("high", v) for v in (99.0, 98.0, 97.0, 96.0, 95.0)]


def test_most_frequent_text_is_the_first_of_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "s string")
    assert tuple(describe_text(df, "s").first()) == ("s", 4, 2, "a", 2)


def test_time_range_covers_whole_days(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01 06:00:00' + make_dt_interval(0, id) AS t FROM range(49)")
    found = {r.statistic: (r.value, r.text) for r in time_summary(df, "t").collect()}
    assert found["range_low"][1] == "2024-01-01 00:00:00.000000"
    assert found["range_high"][1] == "2024-01-04 00:00:00.000000"
    assert found["bins"][0] == 3 and found["count"][0] == 49


def test_whole_table_profile(spark, lineitem):
    profile = profile_table(lineitem)
    assert profile.kinds["l_shipdate"] == "time"
    assert profile.kinds["l_returnflag"] == profile.kinds["l_tax"] == "category"
    assert profile.kinds["l_extendedprice"] == "number"
    assert profile.summary.count() == 11
    details = column_details(lineitem, profile, "l_extendedprice")
    assert details["histogram"].agg(F.sum("count")).first()[0] == lineitem.count()
    assert set(column_details(lineitem, profile, "l_returnflag")) == {"categories"}
    assert set(column_details(lineitem, profile, "l_shipdate")) == {"summary"}


def normal(x, height, mean, sigma):
    return height * np.exp(-0.5 * ((np.asarray(x) - mean) / sigma) ** 2)


def fitted(frame, **options):
    return {r.parameter: r.value for r in fits.fit_normal(frame, **options).collect()}


@pytest.mark.parametrize("scale, shift", [(1.0, 0.0), (1e-6, 3.0), (1e7, -5e8)])
def test_a_normal_curve_is_found_again(spark, scale, shift):
    x = np.linspace(-2.0, 5.0, 40) * scale + shift
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, normal(x, 12.5, 1.2 * scale + shift, 0.7 * scale))], "x double, y double")
    found = fitted(df)
    assert found["mean"] == pytest.approx(1.2 * scale + shift, rel=1e-9) and found["sigma"] == pytest.approx(0.7 * scale, rel=1e-7)
    assert found["height"] == pytest.approx(12.5, rel=1e-7) and found["points"] == 40


@pytest.mark.parametrize("weighted", [False, True])
def test_no_other_normal_curve_is_nearer(spark, weighted):
    rng = np.random.default_rng(8)
    x = np.arange(30.0)
    y = np.maximum(normal(x, 50, 14, 4.5) + rng.normal(0, 4, 30), 0.0)
    error = np.sqrt(y) if weighted else np.ones(30)
    rows = [(float(a), float(b), float(e)) for a, b, e in zip(x, y, error)] + [(1.0, float("nan"), 0.0), (None, 4.0, 1.0)]
    df = spark.createDataFrame(rows, "x double, y double, e double").where("NOT isnan(y)")
    found = fitted(df, error="e")
    kept = error > 0
    squares = lambda h, m, s: float((((y - normal(x, h, m, s))[kept] / error[kept]) ** 2).sum())
    best = squares(found["height"], found["mean"], found["sigma"])
    assert found["chi2"] == pytest.approx(best) and found["points"] == kept.sum()
    for step in (1e-4, 1e-3):
        for change in ((step, 0, 0), (-step, 0, 0), (0, step, 0), (0, -step, 0), (0, 0, step), (0, 0, -step)):
            assert squares(*(v * (1 + c) for v, c in zip((found["height"], found["mean"], found["sigma"]), change))) >= best


def test_a_histogram_of_a_normal_sample(spark):
    axis = binning.Axis(40, -4.0, 4.0)
    df = spark.range(40_000).select(F.randn(5).alias("v"))
    found = {r.parameter: r.value for r in fits.fit_histogram_normal(binning.hist1d(df, "v", axis), axis).collect()}
    assert abs(found["mean"]) < 0.03 and abs(found["sigma"] - 1) < 0.03 and found["chi2"] < 80
    assert {r.parameter for r in fits.fit(df.limit(9).select(F.col("v").alias("x"), F.exp(-F.col("v") * F.col("v")).alias("y")), "gaus:Q").collect()} == set(found)
    for rows in ([], [(1.0, 2.0), (2.0, 3.0)], [(1.0, 0.0)] * 5):
        with pytest.raises(ValueError):
            fits.fit_normal(spark.createDataFrame(rows, "x double, y double"))


def test_pages_together_are_the_pages_one_by_one(spark):
    """Nulls, NaN, one value in most rows, no value below the range, dates, and text with many values."""
    df = spark.range(3_000).selectExpr(
        "id", "IF(id % 3 = 0, 5, CAST(id % 100 AS INT)) AS hot", "CASE WHEN id % 50 = 0 THEN double('NaN') WHEN id % 7 = 0 THEN NULL ELSE id / 3 END AS x",
        "CAST(id AS DECIMAL(12,2)) AS money", "IF(id % 4 = 0, NULL, concat('t', id % 5)) AS few", "IF(id % 9 = 0, NULL, concat('u', id)) AS many", "id % 2 = 0 AS flag",
        "CAST(id % 6 AS INT) - 2 AS small", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, CAST(id AS INT)) AS at", "DATE'2024-01-01' + CAST(id % 40 AS INT) AS day",
        "CAST(NULL AS DOUBLE) AS nothing", "7 AS constant").repartition(3)
    profile = profile_table(df)
    wanted = set()
    for name in profile.kinds:
        for part, page in column_details(df, profile, name).items():
            for r in page.collect():
                wanted.add({"categories": lambda: (name, part, r["index"], r["value"], r["percent"], r["count"]), "histogram": lambda: (name, part, r["bin"], None, None, r["count"]),
                            "outliers": lambda: (name, part, r["rank"], r["side"], r["value"], None), "summary": lambda: (name, part, 0, r["statistic"], r["value"], None)}[part]())
    found = whole_profile(df).collect()
    assert {tuple(r) for r in found} == wanted and len(found) == len(wanted)
    assert whole_profile(df.limit(0)).where("part <> 'summary'").count() == 0


def test_the_number_of_jobs_does_not_grow_with_the_columns(spark):
    tracker, jobs = spark.sparkContext.statusTracker(), {}
    for width in (3, 9):
        df = spark.range(5_000).select(*[(F.col("id") * (i + 3) % 4_999).alias(f"c{i}") for i in range(width)], *[(F.col("id") % (i + 2)).cast("string").alias(f"t{i}") for i in range(width)])
        spark.sparkContext.setJobGroup(f"width-{width}", "profile")
        whole_profile(df).write.format("noop").mode("overwrite").save()
        jobs[width] = len(tracker.getJobIdsForGroup(f"width-{width}"))
    assert jobs[9] <= jobs[3] + 4, jobs
