"""Histograms, profiles, series and fits."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from qualframe.operators import binning, fits, series
from qualframe.operators.binning import Axis
from qualframe.operators.profile import category_table
from qualframe.queries.profiles import bin_sql
from qualframe.queries.registry import query, table
from qualframe.queries.validation import INJECTED, injected


def _hist(source: str, v: str, bins: int, low: str, high: str, bounds: str = "(SELECT 1)", edge: int = 6) -> str:
    """``bounds`` may be a subquery with the columns that ``low`` and ``high`` name."""
    return f"""WITH q AS (SELECT * FROM {bounds}), c AS (SELECT {bin_sql(v, bins, low, high)} AS bin, count(*) AS n FROM {source}, q GROUP BY 1)
      SELECT i AS bin, round(CAST({low} AS DOUBLE) + (i - 1) * ((CAST({high} AS DOUBLE) - CAST({low} AS DOUBLE)) / {bins}), {edge}) AS low_edge,
      coalesce(n, 0) AS count FROM range(0, {bins + 2}) AS r(i) CROSS JOIN q LEFT JOIN c ON c.bin = i"""


def _rounded(df, digits=6):
    return df.withColumn("low_edge", F.round("low_edge", digits))


@query("hist_fixed", _hist("lineitem", "l_extendedprice", 40, "2000", "90000"))
def hist_fixed(spark, d):
    return _rounded(binning.hist1d(table(spark, d, "lineitem"), "l_extendedprice", Axis(40, 2000, 90000)))


@query("hist_nan_null", _hist(INJECTED, "l_quantity", 10, "5", "45"))
def hist_nan_null(spark, d):
    return _rounded(binning.hist1d(injected(table(spark, d, "lineitem")), "l_quantity", Axis(10, 5, 45)))


@query("hist_auto", _hist("customer", "c_acctbal", 40, "q.lo - (q.hi - q.lo) * 0.05::DOUBLE", "q.hi + (q.hi - q.lo) * 0.05::DOUBLE",
                          "(SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)"))
def hist_auto(spark, d):
    df = table(spark, d, "customer")
    return _rounded(binning.hist1d(df, "c_acctbal", binning.make_axis(df, "c_acctbal")))


@query("hist_half_open", _hist("customer", "c_acctbal", 25, "0", "q.hi", "(SELECT max(c_acctbal) AS hi FROM customer)"))
def hist_half_open(spark, d):
    df = table(spark, d, "customer")
    return _rounded(binning.hist1d(df, "c_acctbal", binning.make_axis(df, "c_acctbal", 25, low=0.0)))


@query("hist_trim", _hist("lineitem", "l_extendedprice", 20, "q.lo", "q.hi",
                          "(SELECT quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi FROM lineitem)"))
def hist_trim(spark, d):
    df = table(spark, d, "lineitem")
    return _rounded(binning.hist1d(df, "l_extendedprice", binning.make_axis(df, "l_extendedprice", 20, trim=0.01)))


@query("hist_time", _hist("events", "(epoch_us(ts) / 1e6::DOUBLE)", 31, "1704067200", "1706745600"))
def hist_time(spark, d):
    return _rounded(binning.hist1d(table(spark, d, "events"), "ts", Axis(31, 1704067200, 1706745600)))


_CATEGORIES = """SELECT row_number() OVER (ORDER BY n DESC, event_type) - 1 AS x, n, event_type FROM
  (SELECT event_type, count(*) AS n FROM events GROUP BY 1)"""


@query("hist_weighted", f"""SELECT i AS bin, event_type AS label, coalesce(CAST(n AS DOUBLE), 0.0) AS weight,
  coalesce(CAST(n AS DOUBLE) * n, 0.0) AS weight2 FROM range(0, 7) AS r(i) LEFT JOIN ({_CATEGORIES}) ON x = i - 1""")
def hist_weighted(spark, d):
    """The bars of a category table: one bin per category, weighted by its count and named after it."""
    categories = category_table(table(spark, d, "events"), "event_type")
    return binning.hist_weighted(categories, "index", "count", Axis(5, 0, 5), "value")


@query("hist_weighted_values", f"""SELECT i AS bin, CAST(NULL AS VARCHAR) AS label, round(coalesce(w, 0.0), 4) AS weight, round(coalesce(w2, 0.0) / 1e9::DOUBLE, 3) AS weight2
  FROM range(0, 12) AS r(i) LEFT JOIN (SELECT {bin_sql('l_quantity', 10, '0', '51')} AS bin, sum(l_extendedprice) AS w, sum(l_extendedprice * l_extendedprice) AS w2
  FROM {INJECTED} WHERE NOT isnan(l_quantity) AND l_extendedprice IS NOT NULL GROUP BY 1) ON bin = i""")
def hist_weighted_values(spark, d):
    found = binning.hist_weighted(injected(table(spark, d, "lineitem")), "l_quantity", "l_extendedprice", Axis(10, 0, 51))
    return found.withColumns({"weight": F.round("weight", 4), "weight2": F.round(F.col("weight2") / 1e9, 3)})


@query("hist_norm", f"""WITH h AS ({_hist("lineitem", "l_extendedprice", 20, "5000", "80000")})
  SELECT bin, low_edge, count, round(count * 100.0::DOUBLE / (SELECT sum(count) FROM h WHERE bin BETWEEN 1 AND 20) / 3750.0::DOUBLE, 10) AS density FROM h""")
def hist_norm(spark, d):
    axis = Axis(20, 5000, 80000)
    found = binning.normalise(binning.hist1d(table(spark, d, "lineitem"), "l_extendedprice", axis), axis, 100)
    return _rounded(found).withColumn("density", F.round("density", 10))


@query("hist_stats", """WITH t AS (SELECT l_extendedprice AS v, l_extendedprice >= 5000 AND l_extendedprice < 80000 AS ok FROM lineitem),
  m AS (SELECT avg(v) AS mean, stddev_pop(v) AS std FROM t WHERE ok),
  s AS (SELECT avg(power((v - mean) / std, 3)) AS skewness, avg(power((v - mean) / std, 4)) - 3 AS kurtosis FROM t, m WHERE ok)
  SELECT (SELECT count(*) FROM t) AS entries, (SELECT count(*) FROM t WHERE v < 5000) AS underflow,
  (SELECT count(*) FROM t WHERE v >= 80000) AS overflow, (SELECT count(*) FROM t WHERE ok) AS in_range,
  round(mean, 4) AS mean, round(std, 4) AS std, round(skewness, 8) AS skewness, round(kurtosis, 8) AS kurtosis FROM m, s""")
def hist_stats(spark, d):
    found = binning.hist_stats(table(spark, d, "lineitem"), "l_extendedprice", Axis(20, 5000, 80000))
    return found.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4),
                              "skewness": F.round("skewness", 8), "kurtosis": F.round("kurtosis", 8)})


@query("hist2d", f"""SELECT {bin_sql('l_quantity', 30, '1', '51')} AS bin_x, {bin_sql('l_extendedprice', 30, '0', '100000')} AS bin_y,
  count(*) AS count FROM lineitem GROUP BY 1, 2""")
def hist2d(spark, d):
    return binning.hist2d(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", Axis(30, 1, 51), Axis(30, 0, 100000))


@query("hist2d_weighted", f"""SELECT {bin_sql('l_quantity', 10, '1', '51')} AS bin_x, {bin_sql('l_discount', 5, '0', '0.1')} AS bin_y,
  count(*) AS count, round(sum(l_extendedprice), 4) AS weight, round(sum(l_extendedprice * l_extendedprice) / 1e9::DOUBLE, 3) AS weight2 FROM lineitem GROUP BY 1, 2""")
def hist2d_weighted(spark, d):
    found = binning.hist2d(table(spark, d, "lineitem"), "l_quantity", "l_discount", Axis(10, 1, 51), Axis(5, 0, 0.1), "l_extendedprice")
    return found.withColumns({"weight": F.round("weight", 4), "weight2": F.round(F.col("weight2") / 1e9, 3)})


@query("profile_x", f"""WITH q AS (SELECT min(l_quantity) - (max(l_quantity) - min(l_quantity)) * 0.05::DOUBLE AS lo,
   max(l_quantity) + (max(l_quantity) - min(l_quantity)) * 0.05::DOUBLE AS hi FROM {INJECTED} WHERE NOT isnan(l_quantity)),
  c AS (SELECT {bin_sql('l_quantity', 20, 'q.lo', 'q.hi')} AS bin, count(*) AS n, avg(l_extendedprice) AS mean,
   stddev_pop(l_extendedprice) / sqrt(count(*)) AS error FROM {INJECTED}, q WHERE NOT isnan(l_quantity) AND l_extendedprice IS NOT NULL GROUP BY 1)
  SELECT i AS bin, coalesce(n, 0) AS count, round(mean, 6) AS mean, round(error, 6) AS error FROM range(0, 22) AS r(i) LEFT JOIN c ON bin = i""")
def profile_x(spark, d):
    df = injected(table(spark, d, "lineitem"))
    found = binning.profile_x(df, "l_quantity", "l_extendedprice", binning.make_axis(df, "l_quantity", 20))
    return found.withColumns({"mean": F.round("mean", 6), "error": F.round("error", 6)})


# ---- series ---------------------------------------------------------------------------------------

_DAILY = "(SELECT date_trunc('day', ts) AS day, count(*) AS n, round(sum(value), 4) AS total, round(stddev_pop(value), 6) AS spread FROM events GROUP BY 1)"
_MONTHLY = "(SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, round(avg(o_totalprice), 4) AS price FROM orders GROUP BY 1)"


def daily(spark, d):
    return table(spark, d, "events").groupBy(F.date_trunc("DAY", "ts").alias("day")).agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.stddev_pop("value"), 6).alias("spread"))


def monthly(spark, d):
    return table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("price"))


@query("series_index", f"SELECT CAST(row_number() OVER (ORDER BY month) AS DOUBLE) AS x, CAST(n AS DOUBLE) AS y, 0.0::DOUBLE AS ex, 0.0::DOUBLE AS ey FROM {_MONTHLY}")
def series_index(spark, d):
    return series.series(monthly(spark, d), "n", order=["month"])


@query("series_index_rows", """SELECT CAST(row_number() OVER (ORDER BY l_shipdate, l_extendedprice) AS DOUBLE) AS x, l_extendedprice AS y,
  0.0::DOUBLE AS ex, 0.0::DOUBLE AS ey FROM lineitem""")
def series_index_rows(spark, d):
    """Every row a point: numbering does not depend on any one task seeing all of them."""
    return series.series(table(spark, d, "lineitem"), "l_extendedprice", order=["l_shipdate", "l_extendedprice"])


@query("series_time", f"SELECT CAST(epoch_us(day) AS DOUBLE) / 1e6::DOUBLE AS x, total AS y, 0.0::DOUBLE AS ex, 0.0::DOUBLE AS ey FROM {_DAILY}")
def series_time(spark, d):
    return series.series(daily(spark, d), "total", "day")


@query("series_errors", f"SELECT CAST(n AS DOUBLE) AS x, total AS y, 0.0::DOUBLE AS ex, spread AS ey FROM {_DAILY}")
def series_errors(spark, d):
    return series.series(daily(spark, d), "total", "n", ey="spread")


@query("series_step", f"""WITH p AS (SELECT row_number() OVER (ORDER BY day) - 1 AS i, CAST(epoch_us(day) AS DOUBLE) / 1e6::DOUBLE AS x, total AS y FROM {_DAILY}),
  n AS (SELECT i, x, y, lead(x) OVER (ORDER BY i) AS nx FROM p)
  SELECT CAST(2 * i AS BIGINT) AS seq, x, y FROM n UNION ALL SELECT CAST(2 * i + 1 AS BIGINT), nx, y FROM n WHERE nx IS NOT NULL""")
def series_step(spark, d):
    return series.step_series(series.series(daily(spark, d), "total", "day"))


@query("multi_series", f"""SELECT 'count' AS series, CAST(row_number() OVER (ORDER BY month) AS DOUBLE) AS x, CAST(n AS DOUBLE) AS y, 0.0::DOUBLE AS ex, 0.0::DOUBLE AS ey FROM {_MONTHLY}
  UNION ALL SELECT 'price', CAST(row_number() OVER (ORDER BY month) AS DOUBLE), price, 0.0::DOUBLE, 0.0::DOUBLE FROM {_MONTHLY}""")
def multi_series(spark, d):
    return series.multi_series({
        "count": series.series(monthly(spark, d), "n", order=["month"]),
        "price": series.series(monthly(spark, d), "price", order=["month"])})


@query("common_index", f"SELECT l_orderkey, l_linenumber, count(*) AS rows FROM {INJECTED} WHERE l_extendedprice IS NOT NULL AND l_returnflag IS NOT NULL GROUP BY 1, 2")
def common_index(spark, d):
    kept = series.common_index(injected(table(spark, d, "lineitem")), "l_extendedprice", ey="l_returnflag")
    return kept.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("rows"))


@query("nan_guard", f"SELECT count(*) AS rows, count(*) FILTER (WHERE isnan(l_quantity) OR l_extendedprice IS NULL) AS rejected FROM {INJECTED}")
def nan_guard(spark, d):
    return series.number_guard(injected(table(spark, d, "lineitem")), ["l_quantity", "l_extendedprice"])


@query("clean_numbers", f"SELECT l_quantity, l_extendedprice FROM {INJECTED} WHERE NOT isnan(l_quantity) AND l_extendedprice IS NOT NULL")
def clean_numbers(spark, d):
    return series.clean_numbers(injected(table(spark, d, "lineitem")), ["l_quantity", "l_extendedprice"])


# ---- fits -----------------------------------------------------------------------------------------

@query("fit_linear", """SELECT CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope,
  round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 9) AS r2 FROM lineitem""")
def fit_linear(spark, d):
    found = fits.fit_line(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")
    return found.select("n", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 9).alias("r2"))


@query("fit_weighted_line", f"""WITH p AS (SELECT CAST(row_number() OVER (ORDER BY day) AS DOUBLE) AS x, total AS y, 1.0 / (spread * spread) AS w FROM {_DAILY} WHERE spread > 0),
  s AS (SELECT sum(w) AS s, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy FROM p)
  SELECT 'p0' AS parameter, round((sxx * sy - sx * sxy) / (s * sxx - sx * sx), 4) AS value FROM s
  UNION ALL SELECT 'p1', round((s * sxy - sx * sy) / (s * sxx - sx * sx), 4) FROM s""")
def fit_weighted_line(spark, d):
    points = series.series(daily(spark, d).where("spread > 0"), "total", ey="spread", order=["day"])
    return fits.fit(points, "pol1:Q", "ey").withColumn("value", F.round("value", 4))


@query("fit_histogram_line", f"""WITH h AS ({_hist("lineitem", "l_extendedprice", 20, "5000", "80000")}),
  p AS (SELECT 5000 + (bin - 0.5) * 3750.0::DOUBLE AS x, CAST(count AS DOUBLE) AS y, 1.0 / count AS w FROM h WHERE bin BETWEEN 1 AND 20 AND count > 0),
  s AS (SELECT sum(w) AS s, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy FROM p)
  SELECT 'p0' AS parameter, round((sxx * sy - sx * sxy) / (s * sxx - sx * sx), 5) AS value FROM s
  UNION ALL SELECT 'p1', round((s * sxy - sx * sy) / (s * sxx - sx * sx), 9) FROM s""")
def fit_histogram_line(spark, d):
    axis = Axis(20, 5000, 80000)
    found = fits.fit_histogram(binning.hist1d(table(spark, d, "lineitem"), "l_extendedprice", axis), axis, 1)
    return found.withColumn("value", F.when(F.col("parameter") == "p0", F.round("value", 5)).otherwise(F.round("value", 9)))


def _normal_sql(points: str, rounds: int = 60) -> str:
    """The same rounds by the normal equations, solved by Cramer's rule; without halved steps, as these data need none."""
    return f"""WITH RECURSIVE p AS ({points}),
  m AS (SELECT sum(x * y) / sum(y) AS c, max(y) AS top FROM p), b AS (SELECT c, top, sqrt(sum(y * (x - c) * (x - c)) / sum(y)) AS d FROM p, m GROUP BY c, top),
  z AS (SELECT (x - c) / d AS u, y, w FROM p, b),
  r AS (SELECT 0 AS i, ln(top) AS p0, 0.0::DOUBLE AS p1, -0.5::DOUBLE AS p2 FROM b
    UNION ALL SELECT i + 1,
      p0 + (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / det,
      p1 + (s0 * (t1 * s4 - s3 * t2) - t0 * (s1 * s4 - s3 * s2) + s2 * (s1 * t2 - t1 * s2)) / det,
      p2 + (s0 * (s2 * t2 - t1 * s3) - s1 * (s1 * t2 - t1 * s2) + t0 * (s1 * s3 - s2 * s2)) / det
    FROM (SELECT *, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2) AS det FROM (
      SELECT i, p0, p1, p2, sum(g) AS s0, sum(g * u) AS s1, sum(g * u * u) AS s2, sum(g * u * u * u) AS s3, sum(g * u * u * u * u) AS s4,
        sum(e) AS t0, sum(e * u) AS t1, sum(e * u * u) AS t2
      FROM (SELECT i, p0, p1, p2, u, w * f * f AS g, w * f * (y - f) AS e FROM (SELECT *, exp(p0 + p1 * u + p2 * u * u) AS f FROM r, z WHERE i < {rounds}))
      GROUP BY i, p0, p1, p2)))
  SELECT parameter, round(value, 4) AS value FROM (SELECT unnest(['height', 'mean', 'sigma']) AS parameter,
    unnest([exp(p0 - p1 * p1 / (4 * p2)), c - d * p1 / (2 * p2), d / sqrt(-2 * p2)]) AS value FROM r, b WHERE i = {rounds})"""


# Sums of nearly even shares: bell-shaped.
_BELL = "(l_quantity / 50 + l_linenumber / 7.0::DOUBLE + l_discount * 10 + l_tax * 12.5::DOUBLE)"
_BELL_WHOLE = "CAST(floor(l_quantity / 10) AS BIGINT) + l_linenumber + l_partkey % 6 + l_suppkey % 5"


@query("fit_histogram_normal", _normal_sql(f"""SELECT 0.5 + (bin - 0.5) * 0.15::DOUBLE AS x, CAST(count AS DOUBLE) AS y, 1.0::DOUBLE / count AS w
  FROM ({_hist("lineitem", _BELL, 20, "0.5::DOUBLE", "3.5::DOUBLE")}) WHERE bin BETWEEN 1 AND 20 AND count > 0"""))
def fit_histogram_normal(spark, d):
    axis = Axis(20, 0.5, 3.5)
    bell = F.col("l_quantity") / 50 + F.col("l_linenumber") / F.lit(7.0) + F.col("l_discount") * 10 + F.col("l_tax") * 12.5
    found = fits.fit_histogram_normal(binning.hist1d(table(spark, d, "lineitem").withColumn("bell", bell), "bell", axis), axis)
    return found.where("parameter IN ('height', 'mean', 'sigma')").withColumn("value", F.round("value", 4))


@query("fit_series_normal", _normal_sql(f"""SELECT CAST({_BELL_WHOLE} AS DOUBLE) AS x, CAST(count(*) AS DOUBLE) AS y, 1.0::DOUBLE AS w FROM lineitem GROUP BY 1"""))
def fit_series_normal(spark, d):
    """A series without errors."""
    whole = F.floor(F.col("l_quantity") / 10) + F.col("l_linenumber") + F.col("l_partkey") % 6 + F.col("l_suppkey") % 5
    points = table(spark, d, "lineitem").groupBy(whole.alias("x")).agg(F.count("*").alias("y"))
    return fits.fit(points, "gaus:Q").where("parameter IN ('height', 'mean', 'sigma')").withColumn("value", F.round("value", 4))


@query("fit_gauss_moments", f"""SELECT count(*) AS n, round(count(*) * 3750.0::DOUBLE / stddev_pop(l_extendedprice) / {math.sqrt(2 * math.pi)!r}::DOUBLE, 6) AS height,
  round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS sigma FROM lineitem WHERE l_extendedprice >= 5000 AND l_extendedprice < 80000""")
def fit_gauss_moments(spark, d):
    found = fits.fit_gauss(table(spark, d, "lineitem"), "l_extendedprice", Axis(20, 5000, 80000))
    return found.select("n", F.round("height", 6).alias("height"), F.round("mean", 4).alias("mean"), F.round("sigma", 4).alias("sigma"))
