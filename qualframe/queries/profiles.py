"""Profiles, categories, quantiles, durations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualframe.functions.columns import fill_template
from qualframe.operators import binning, profile
from qualframe.operators.quantiles import exact_quantiles
from qualframe.operators.whole_quantiles import discrete_quantiles
from qualframe.plans.profiling import profile_table, whole_profile
from qualframe.queries.registry import query, spec_of, table
from qualframe.queries.validation import INJECTED, injected
from qualframe.session import materialize


@query("value_counts", "SELECT l_linenumber AS value, count(*) AS count FROM lineitem GROUP BY 1")
def value_counts(spark, d):
    return profile.value_counts(table(spark, d, "lineitem"), "l_linenumber")


@query("value_counts_nan_null", f"SELECT l_quantity AS value, count(*) AS count FROM {INJECTED} GROUP BY 1")
def value_counts_nan_null(spark, d):
    return profile.value_counts(injected(table(spark, d, "lineitem")), "l_quantity")


def _categories(source: str, value: str, order: str, text: str) -> str:
    return f"""SELECT row_number() OVER (ORDER BY {order}) - 1 AS index, coalesce({text}, 'None') AS value, n AS count,
      n / sum(n) OVER () * 100.0 AS percent FROM (SELECT {value} AS v, count(*) AS n FROM {source} GROUP BY 1)"""


@query("category_numeric", _categories("lineitem", "l_linenumber", "v NULLS LAST", "CAST(v AS VARCHAR)"))
def category_numeric(spark, d):
    return profile.category_table(table(spark, d, "lineitem"), "l_linenumber")


@query("category_text", _categories("events", "event_type", "n DESC, v NULLS LAST", "v"))
def category_text(spark, d):
    return profile.category_table(table(spark, d, "events"), "event_type")


@query("category_with_nulls", _categories(INJECTED, "l_returnflag", "n DESC, v NULLS LAST", "v"))
def category_with_nulls(spark, d):
    return profile.category_table(injected(table(spark, d, "lineitem")), "l_returnflag")


@query("category_large", _categories("orders", "o_custkey", "v NULLS LAST", "CAST(v AS VARCHAR)"))
def category_large(spark, d):
    return profile.category_table(table(spark, d, "orders"), "o_custkey")


_LINEITEM_COLUMNS = ("l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_orderkey")
_DISTINCT = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS \"distinct\" FROM {{source}}"
    for c in _LINEITEM_COLUMNS)


@query("distinct_counts", f'SELECT "column", CAST("distinct" AS BIGINT) AS "distinct" FROM ({_DISTINCT.format(source="lineitem")})')
def distinct_counts(spark, d):
    return profile.distinct_counts(table(spark, d, "lineitem"), _LINEITEM_COLUMNS)


@query("auto_categorical", f'SELECT "column", CAST("distinct" AS BIGINT) AS "distinct" FROM ({_DISTINCT.format(source="lineitem")}) WHERE "distinct" < 30')
def auto_categorical(spark, d):
    found = profile.categorical_columns(table(spark, d, "lineitem"), _LINEITEM_COLUMNS)
    return spark.createDataFrame(sorted(found.items()), "column string, distinct bigint")


@query("column_kinds", """SELECT "column", CASE WHEN "column" = 'o_orderdate' THEN 'time'
  WHEN "column" IN ('o_orderstatus', 'o_orderpriority') OR "distinct" < 30 THEN 'category' ELSE 'number' END AS kind FROM (""" +
  " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS \"distinct\" FROM orders"
                     for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")) + ")")
def column_kinds(spark, d):
    df = table(spark, d, "orders")
    found = profile_table(df, spec_of(df, "orders")).kinds
    return spark.createDataFrame(sorted(found.items()), "column string, kind string")


_SUMMARY = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{kind}' AS type, count(*) AS rows, count(*) FILTER (WHERE {c} IS NULL) AS nulls,
    count(*) FILTER (WHERE {'isnan(' + c + ')' if kind == 'double' else 'false'}) AS nan,
    CAST(min({c}){' FILTER (WHERE NOT isnan(' + c + '))' if kind == 'double' else ''} AS VARCHAR) AS min,
    CAST(max({c}){' FILTER (WHERE NOT isnan(' + c + '))' if kind == 'double' else ''} AS VARCHAR) AS max FROM {INJECTED}"""
    for c, kind in (("l_orderkey", "bigint"), ("l_linenumber", "int"), ("l_returnflag", "string"), ("l_quantity", "double"),
                    ("l_extendedprice", "double"), ("l_empty", "bigint")))


@query("column_profile", _SUMMARY)
def column_profile(spark, d):
    found = profile.column_profile(injected(table(spark, d, "lineitem")))
    return found.select("column", "type", "rows", "nulls", "nan", "min", "max")


@query("distinct_values", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {v}) + max(CASE WHEN {v} IS NULL THEN 1 ELSE 0 END) AS \"distinct\" FROM {INJECTED}"
    for c, v in (("l_orderkey", "l_orderkey"), ("l_returnflag", "l_returnflag"), ("l_quantity", "l_quantity"), ("zero", "l_linenumber % 2"))))
def distinct_values(spark, d):
    """Exact numbers, in which -0.0 and 0.0 are one value, all NaN are one, and null is one."""
    df = injected(table(spark, d, "lineitem"))
    df = df.withColumn("zero", (F.col("l_linenumber") % 2) * F.when(F.col("l_linenumber") % 4 == 0, -1.0).otherwise(1.0))
    return profile.distinct_counts(df, ["l_orderkey", "l_returnflag", "l_quantity", "zero"])


_DAY = "86400000000"
_PAGE = '"column", part, place, label, value, n'


def _category_page(c: str) -> str:
    return f"""SELECT '{c}' AS "column", 'categories' AS part, row_number() OVER (ORDER BY n DESC, v) - 1 AS place, v AS label,
    n / sum(n) OVER () * 100.0::DOUBLE AS value, n FROM (SELECT {c} AS v, count(*) AS n FROM orders GROUP BY 1)"""


def _number_page(c: str) -> str:
    """Histogram and outliers between the 0.1 % and 99.9 % quantiles as whole numbers."""
    return f"""SELECT {_PAGE} FROM (WITH x AS (SELECT CAST({c} AS DOUBLE) AS v FROM orders),
    b AS (SELECT round_even(quantile_cont(v, 0.001), 0) AS lo, round_even(quantile_cont(v, 0.999), 0) AS hi FROM x),
    low AS (SELECT row_number() OVER (ORDER BY v) AS place, v FROM x, b WHERE v < lo QUALIFY place <= 10),
    high AS (SELECT row_number() OVER (ORDER BY v DESC) AS place, v FROM x, b WHERE v >= hi QUALIFY place <= 10),
    bins AS (SELECT CASE WHEN v < lo THEN 0 WHEN v >= hi THEN 41 ELSE CAST(floor(40 * (v - lo) / (hi - lo)) AS BIGINT) + 1 END AS bin FROM x, b WHERE lo < hi)
    SELECT '{c}' AS "column", 'outliers' AS part, place, 'low' AS label, v AS value, NULL::BIGINT AS n FROM low
    UNION ALL SELECT '{c}', 'outliers', i, 'low', lo, NULL FROM b, range(1, 11) AS r(i) WHERE NOT EXISTS (SELECT 1 FROM low)
    UNION ALL SELECT '{c}', 'outliers', place, 'high', v, NULL FROM high
    UNION ALL SELECT '{c}', 'histogram', i, NULL, NULL, count(bin) FROM range(0, 42) AS s(i) LEFT JOIN bins ON bin = i WHERE EXISTS (SELECT 1 FROM bins) GROUP BY i)"""


def _time_page(c: str) -> str:
    return f"""SELECT {_PAGE} FROM (WITH t AS (SELECT CAST(epoch_us({c}) AS DOUBLE) AS v FROM orders),
    q AS (SELECT quantile_cont(v, [0.01, 0.25, 0.5, 0.77, 0.99]) AS p, count(*)::DOUBLE AS n, avg(v) AS mean, min(v) AS lo, max(v) AS hi FROM t),
    r AS (SELECT *, floor(p[1] / {_DAY}) * {_DAY} AS rl, ceil(p[5] / {_DAY}) * {_DAY} AS rh FROM q)
    SELECT '{c}' AS "column", 'summary' AS part, 0::BIGINT AS place, label, round(CASE WHEN label IN ('count', 'bins') THEN value ELSE value / 1e6 END, 3) AS value, NULL::BIGINT AS n
    FROM (SELECT unnest(['count', 'mean', 'min', '1%', '25%', '50%', '77%', '99%', 'max', 'range_low', 'range_high', 'bins']) AS label,
      unnest([n, mean, lo, p[1], p[2], p[3], p[4], p[5], hi, rl, rh, (rh - rl) / {_DAY}]) AS value FROM r))"""


@query("table_profile", " UNION ALL ".join([
    *map(_category_page, ("o_orderstatus", "o_orderpriority")), *map(_number_page, ("o_orderkey", "o_custkey", "o_totalprice")), _time_page("o_orderdate")]))
def table_pages(spark, d):
    """Every page of the profile of a table, in one long form."""
    found = whole_profile(table(spark, d, "orders"))
    seconds = F.round(F.when(F.col("label").isin("count", "bins"), F.col("value")).otherwise(F.col("value") / 1e6), 3)
    return found.withColumn("value", F.when(F.col("part") == "summary", seconds).otherwise(F.col("value")))


@query("date_stats", """WITH d AS (SELECT CAST(o_orderdate AS DATE) AS x FROM orders)
  SELECT count(*)::BIGINT AS "count", CAST(min(x) AS VARCHAR) AS low, CAST(max(x) AS VARCHAR) AS high FROM d""")
def date_stats(spark, d):
    """A date column in the time summary: its days, not microseconds since 1970."""
    found = profile.time_summary(table(spark, d, "orders").select(F.to_date("o_orderdate").alias("x")), "x")
    at = lambda name, c: F.max(F.when(F.col("statistic") == name, c))
    day = F.to_date(F.timestamp_micros(F.col("value").cast("bigint"))).cast("string")
    return found.agg(at("count", F.col("value")).cast("bigint").alias("count"), at("min", day).alias("low"), at("max", day).alias("high"))


@query("template_fill", """SELECT DISTINCT 'data/' || o_orderstatus || '/raw/' || o_orderstatus || '.parquet' AS path FROM orders""")
def template_fill(spark, d):
    return table(spark, d, "orders").select(fill_template("data/{x}/raw/{x}.parquet", F.col("o_orderstatus")).alias("path")).distinct()


_QUANTILES = (0.0, 0.001, 0.25, 0.5, 0.77, 0.999, 1.0)


def _quantile_sql(source: str, columns: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS \"column\", CAST({q} AS DOUBLE) AS quantile, round(quantile_cont({c}, {q}), 6) AS value FROM {source}"
        for name, c in columns.items() for q in _QUANTILES)


def _quantile_rows(spark, df, columns):
    found = exact_quantiles(df, {name: _QUANTILES for name in columns})
    rows = [(name, q, value) for name in columns for q, value in found[name].quantiles.items()]
    return spark.createDataFrame(rows, "column string, quantile double, value double").withColumn("value", F.round("value", 6))


@query("quantiles_exact", _quantile_sql("lineitem", {
    "l_extendedprice": "l_extendedprice", "l_quantity": "l_quantity", "l_orderkey": "CAST(l_orderkey AS DOUBLE)",
    "l_tax": "l_tax", "l_partkey": "CAST(l_partkey AS DOUBLE)"}))
def quantiles_exact(spark, d):
    return _quantile_rows(spark, table(spark, d, "lineitem"), ("l_extendedprice", "l_quantity", "l_orderkey", "l_tax", "l_partkey"))


@query("quantiles_nan_null", _quantile_sql(INJECTED, {
    "l_quantity": "CASE WHEN NOT isnan(l_quantity) THEN l_quantity END", "l_extendedprice": "l_extendedprice"}))
def quantiles_nan_null(spark, d):
    return _quantile_rows(spark, injected(table(spark, d, "lineitem")), ("l_quantity", "l_extendedprice"))


_NEAR = {"near": "l_orderkey * 7 % 5003 + 4611686018427387904", "price": "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DECIMAL(38,10)) + CAST(100000000000000000000 AS DECIMAL(38,10))"}


@query("quantiles_whole", " UNION ALL ".join(
    f"SELECT '{name}' AS \"column\", CAST({q} AS DOUBLE) AS quantile, CAST(quantile_disc(v, {q}) AS VARCHAR) AS value FROM (SELECT {c} AS v FROM lineitem)"
    for name, c in _NEAR.items() for q in _QUANTILES))
def quantiles_whole(spark, d):
    """Numbers near 2^62 and decimals of 31 digits, which doubles do not tell apart."""
    far = F.lit("100000000000000000000").cast("decimal(38,10)")
    df = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 7 % 5003 + F.lit(2 ** 62)).alias("near"),
        (F.col("l_extendedprice").cast("decimal(18,2)").cast("decimal(38,10)") + far).cast("decimal(38,10)").alias("price"))
    found = discrete_quantiles(df, {name: _QUANTILES for name in df.columns})
    rows = [(name, q, f"{value:f}" if name == "price" else str(value)) for name, values in found.items() for q, value in values.items()]
    return spark.createDataFrame(rows, "column string, quantile double, value string")


_BOUNDS = """SELECT '{c}' AS "column", count({c}) AS count, round_even(quantile_cont({c}, 0.001), 0) AS low,
  round(quantile_cont({c}, 0.5), 6) AS median, round_even(quantile_cont({c}, 0.999), 0) AS high FROM {t}"""


@query("numeric_bounds", _BOUNDS.format(c="l_extendedprice", t="lineitem"))
def numeric_bounds(spark, d):
    return profile.numeric_bounds(table(spark, d, "lineitem"), "l_extendedprice").withColumn("median", F.round("median", 6))


def _outlier_sql(t: str, c: str) -> str:
    return f"""WITH b AS (SELECT round_even(quantile_cont({c}, 0.001), 0) AS lo, round_even(quantile_cont({c}, 0.999), 0) AS hi FROM {t}),
    low AS (SELECT row_number() OVER (ORDER BY {c}) AS rank, {c} AS value FROM {t}, b WHERE {c} < lo ORDER BY {c} LIMIT 10),
    high AS (SELECT row_number() OVER (ORDER BY {c} DESC) AS rank, {c} AS value FROM {t}, b WHERE {c} >= hi ORDER BY {c} DESC LIMIT 10)
    SELECT 'low' AS side, rank, value FROM low UNION ALL SELECT 'high', rank, value FROM high
    UNION ALL SELECT 'low', i, lo FROM b, range(1, 11) AS r(i) WHERE NOT EXISTS (SELECT 1 FROM low)"""


def _outliers(spark, d, t, c):
    df = table(spark, d, t)
    found = profile.robust_ranges(df, [c])[c].quantiles
    return profile.outliers(df, c, profile.rounded(found[0.001]), profile.rounded(found[0.999]))


@query("outliers", _outlier_sql("customer", "c_acctbal"))
def outliers(spark, d):
    return _outliers(spark, d, "customer", "c_acctbal")


@query("outliers_none_low", _outlier_sql("lineitem", "l_quantity"))
def outliers_none_low(spark, d):
    return _outliers(spark, d, "lineitem", "l_quantity")


_TIME = f"""WITH t AS (SELECT epoch_us(ts) AS v FROM events),
  q AS (SELECT quantile_cont(CAST(v AS DOUBLE), 0.01) AS q1, quantile_cont(CAST(v AS DOUBLE), 0.25) AS q25,
    quantile_cont(CAST(v AS DOUBLE), 0.5) AS q50, quantile_cont(CAST(v AS DOUBLE), 0.77) AS q77,
    quantile_cont(CAST(v AS DOUBLE), 0.99) AS q99, count(*) AS n, CAST(sum(v) AS DOUBLE) / count(*) AS mean,
    CAST(min(v) AS DOUBLE) AS lo, CAST(max(v) AS DOUBLE) AS hi FROM t),
  r AS (SELECT *, floor(q1 / {_DAY}) * {_DAY} AS rl, ceil(q99 / {_DAY}) * {_DAY} AS rh FROM q)
  SELECT 'count' AS statistic, CAST(n AS DOUBLE) AS value FROM r UNION ALL SELECT 'mean', round(mean / 1e6, 3) FROM r
  UNION ALL SELECT 'min', round(lo / 1e6, 3) FROM r UNION ALL SELECT '1%', round(q1 / 1e6, 3) FROM r
  UNION ALL SELECT '25%', round(q25 / 1e6, 3) FROM r UNION ALL SELECT '50%', round(q50 / 1e6, 3) FROM r
  UNION ALL SELECT '77%', round(q77 / 1e6, 3) FROM r UNION ALL SELECT '99%', round(q99 / 1e6, 3) FROM r
  UNION ALL SELECT 'max', round(hi / 1e6, 3) FROM r UNION ALL SELECT 'range_low', rl / 1e6 FROM r
  UNION ALL SELECT 'range_high', rh / 1e6 FROM r UNION ALL SELECT 'bins', (rh - rl) / {_DAY} FROM r"""


@query("time_stats", _TIME)
def time_stats(spark, d):
    found = profile.time_summary(table(spark, d, "events"), "ts")
    plain = F.col("statistic").isin("count", "bins")
    return found.select("statistic", F.when(plain, F.col("value")).otherwise(F.round(F.col("value") / 1e6, 3)).alias("value"))


_DESCRIBE = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({v}) AS count, round(avg({v}), 6) AS mean, round(stddev_samp({v}), 6) AS std,
    CAST(min({v}) AS DOUBLE) AS min, round(quantile_cont(CAST({v} AS DOUBLE), 0.25), 6) AS "25%", round(quantile_cont(CAST({v} AS DOUBLE), 0.5), 6) AS "50%",
    round(quantile_cont(CAST({v} AS DOUBLE), 0.75), 6) AS "75%", CAST(max({v}) AS DOUBLE) AS max FROM {INJECTED}"""
    for c, v in (("l_quantity", "CASE WHEN NOT isnan(l_quantity) THEN l_quantity END"), ("l_extendedprice", "l_extendedprice"),
                 ("l_orderkey", "l_orderkey")))


@query("describe_numeric", _DESCRIBE)
def describe_numeric(spark, d):
    found = profile.describe_numeric(injected(table(spark, d, "lineitem")), ["l_quantity", "l_extendedprice", "l_orderkey"])
    return found.withColumns({c: F.round(F.col(f"`{c}`"), 6) for c in ("mean", "std", "25%", "50%", "75%")})


@query("describe_text", f"""SELECT 'l_returnflag' AS "column", CAST(sum(n) AS BIGINT) AS count, count(*) AS "unique",
  arg_min(v, (-n, v)) AS top, max(n) AS freq
  FROM (SELECT l_returnflag AS v, count(*) AS n FROM {INJECTED} WHERE l_returnflag IS NOT NULL GROUP BY 1)""")
def describe_text(spark, d):
    return profile.describe_text(injected(table(spark, d, "lineitem")), "l_returnflag")


_SPANS = """(SELECT (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 1000000.0 AS seconds, l_quantity FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey)"""


def _spans(spark, d):
    joined = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return profile.duration(joined, "o_orderdate", "l_shipdate", "seconds").select("l_quantity", "seconds")


@query("duration", f"SELECT seconds, count(*) AS rows FROM (SELECT CAST(seconds AS DOUBLE) AS seconds FROM {_SPANS}) GROUP BY 1")
def duration(spark, d):
    return _spans(spark, d).groupBy("seconds").agg(F.count("*").alias("rows"))


def bin_sql(v: str, bins: int, low: str, high: str) -> str:
    """The bin of a value, as SQL without ``width_bucket``; NaN counts as overflow."""
    v, low, high = (f"CAST({x} AS DOUBLE)" for x in (v, low, high))
    return (f"CAST(CASE WHEN {v} IS NULL THEN NULL WHEN isnan({v}) OR {v} >= {high} THEN {bins + 1} WHEN {v} < {low} THEN 0 "
            f"ELSE floor({bins} * ({v} - {low}) / ({high} - {low})) + 1 END AS BIGINT)")


@query("density_xy", f"""WITH q AS (SELECT quantile_cont(l_quantity, 0.001) AS xl, quantile_cont(l_quantity, 0.99) AS xh,
   CAST(quantile_cont(seconds, 0.001) AS DOUBLE) AS yl, CAST(quantile_cont(seconds, 0.995) AS DOUBLE) AS yh
   FROM (SELECT l_quantity, CAST(seconds AS DOUBLE) AS seconds FROM {_SPANS}))
  SELECT {bin_sql('l_quantity', 30, 'xl', 'xh')} AS bin_x, {bin_sql('seconds', 30, 'yl', 'yh')} AS bin_y, count(*) AS count
  FROM {_SPANS}, q GROUP BY 1, 2""")
def density_xy(spark, d):
    """Three passes over the joined columns, so the join is written once."""
    return binning.density_xy(materialize(_spans(spark, d)), "l_quantity", "seconds")


@query("density_fixed", f"""SELECT {bin_sql('l_quantity', 30, '0', '2')} AS bin_x, {bin_sql('seconds', 30, '0', '200000')} AS bin_y,
  count(*) AS count FROM {_SPANS} GROUP BY 1, 2""")
def density_fixed(spark, d):
    return binning.density_xy(_spans(spark, d), "l_quantity", "seconds", x_range=(0.0, 2.0), y_range=(0.0, 200000.0))
