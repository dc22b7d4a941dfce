"""Fits. The data is reduced to a few sums, in each round of the normal curve's again; only those are solved for on the driver."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualframe.functions.columns import ref
from qualframe.operators.binning import Axis, number_column
from qualframe.session import materialize


def fit_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line as one row: points, slope, intercept, r2."""
    a, b = ref(x).cast("double"), ref(y).cast("double")
    return df.agg(
        F.regr_count(b, a).alias("n"), F.regr_slope(b, a).alias("slope"),
        F.regr_intercept(b, a).alias("intercept"), F.regr_r2(b, a).alias("r2"))


def fit_polynomial(df: DataFrame, x: str, y: str, degree: int, error: str | None = None) -> DataFrame:
    """Least-squares polynomial, weighted by 1/error^2 where an error column is given: one row per coefficient.

    x is centred and scaled before its powers are summed, which keeps the equations well conditioned.
    """
    data = df.select(ref(x).cast("double").alias("x"), ref(y).cast("double").alias("y"),
                     (F.lit(1.0) / (ref(error) * ref(error)) if error else F.lit(1.0)).alias("w"))
    if error:
        data = data.where(ref(error) != 0)
    data = data.dropna()
    shape = data.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.count("*").alias("n")).first()
    if shape.n <= degree:
        raise ValueError(f"{shape.n} points cannot fix a polynomial of degree {degree}")
    centre, scale = shape.m, shape.s or 1.0
    u = (F.col("x") - F.lit(centre)) / F.lit(scale)
    power = lambda k: _power(u, k)
    sums = [F.sum(F.col("w") * power(k)).alias(f"s{k}") for k in range(2 * degree + 1)]
    sums += [F.sum(F.col("w") * power(k) * F.col("y")).alias(f"t{k}") for k in range(degree + 1)]
    row = data.agg(*sums).first()
    matrix = np.array([[row[f"s{i + j}"] for j in range(degree + 1)] for i in range(degree + 1)])
    scaled = np.linalg.solve(matrix, np.array([row[f"t{k}"] for k in range(degree + 1)]))
    inner = np.polynomial.Polynomial([-centre / scale, 1.0 / scale])
    polynomial = np.polynomial.Polynomial([0.0])
    for k in range(degree, -1, -1):
        polynomial = polynomial * inner + scaled[k]
    coefficients = np.zeros(degree + 1)
    coefficients[: len(polynomial.coef)] = polynomial.coef[: degree + 1]
    rows = [(f"p{k}", float(value)) for k, value in enumerate(coefficients)]
    return df.sparkSession.createDataFrame(rows, "parameter string, value double")


def _power(u: Column, k: int) -> Column:
    out = F.lit(1.0)
    for _ in range(k):
        out = out * u
    return out


def fit_histogram(histogram: DataFrame, axis: Axis, degree: int) -> DataFrame:
    """A polynomial through the filled bins in range, each with the error of its count."""
    points = histogram.where(F.col("bin").between(1, axis.bins) & (F.col("count") > 0)).select(
        axis.centre(F.col("bin")).alias("x"), F.col("count").cast("double").alias("y"),
        F.sqrt("count").alias("error"))
    return fit_polynomial(points, "x", "y", degree, "error")


def fit_gauss(df: DataFrame, column: str, axis: Axis) -> DataFrame:
    """The normal curve with the moments of the values in range: entries, height, mean, sigma."""
    v = number_column(df, column)
    inside = F.when(axis.inside(v), v)
    moments = df.agg(F.count(inside).alias("n"), F.avg(inside).alias("mean"), F.stddev_pop(inside).alias("sigma"))
    height = F.col("n") * F.lit(axis.width) / F.nullif(F.col("sigma"), F.lit(0.0)) / F.lit(math.sqrt(2 * math.pi))
    return moments.select("n", height.alias("height"), "mean", "sigma")


def _normal_start(points: DataFrame) -> tuple[float, float, float] | None:
    """Height, mean and sigma by the moments of the points, y being the weight of x; none without any weight."""
    row = points.agg(F.sum("y").alias("s"), F.sum(F.col("x") * F.col("y")).alias("sx"), F.max("y").alias("top"), F.count("*").alias("n"),
                     F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    if not row.n or not row.s or row.s <= 0 or row.top <= 0:
        return None
    mean = row.sx / row.s
    spread = points.agg((F.sum(F.col("y") * (F.col("x") - mean) * (F.col("x") - mean)) / row.s).alias("v")).first().v
    return row.top, mean, math.sqrt(spread) if spread > 0 else (row.hi - row.lo or 1.0) / 4


def fit_normal(df: DataFrame, x: str = "x", y: str = "y", error: str | None = None, rounds: int = 100) -> DataFrame:
    """The normal curve through points by weighted least squares: ``height``, ``mean``, ``sigma`` and ``chi2``, and ``points``.

    The logarithm of a normal curve is a parabola. Each round fits one, by sums over the points, to the curve of the round before plus
    the relative residuals, weighted by the curve; where it comes to rest, the curve is the least-squares one. Points with y of 0 count; those
    whose error is 0 or missing do not. A step that makes the sum of squares larger is halved.
    """
    weight = F.lit(1.0) / (ref(error).cast("double") * ref(error).cast("double")) if error else F.lit(1.0)
    data = df.where(ref(error) != 0) if error else df
    data = data.select(ref(x).cast("double").alias("x"), ref(y).cast("double").alias("y"), weight.alias("w")).dropna()
    # Points of a histogram or series: written once, then only sums over them are formed.
    points = materialize(data)
    start = _normal_start(points)
    n = points.count()
    if start is None or n < 3:
        raise ValueError(f"{n} points with weight cannot fix a normal curve")
    height, centre, scale = start
    u = (F.col("x") - F.lit(centre)) / F.lit(scale)
    curve = lambda p: F.exp(F.lit(p[0]) + F.lit(p[1]) * u + F.lit(p[2]) * u * u)

    def at(p: np.ndarray) -> tuple[float, np.ndarray]:
        """Sum of squares of a curve, and the step the parabola through its working values asks for."""
        if not p[2] < 0:
            return math.inf, np.zeros(3)
        f = curve(p)
        rest = F.col("y") - f
        sums = points.agg(F.sum(F.col("w") * rest * rest).alias("q"), *[F.sum(F.col("w") * f * f * _power(u, k)).alias(f"s{k}") for k in range(5)],
                          *[F.sum(F.col("w") * f * rest * _power(u, k)).alias(f"t{k}") for k in range(3)]).first()
        numbers = [sums[c] for c in sums.asDict()]
        if any(v is None or not math.isfinite(v) for v in numbers):
            return math.inf, np.zeros(3)
        matrix = np.array([[sums[f"s{i + j}"] for j in range(3)] for i in range(3)])
        return sums.q, np.linalg.lstsq(matrix, np.array([sums[f"t{k}"] for k in range(3)]), rcond=None)[0]

    p = np.array([math.log(height), 0.0, -0.5])
    best, step = at(p)
    for _ in range(rounds):
        found, following = at(p + step)
        while not found <= best and np.abs(step).max() > 1e-13:
            step = step / 2
            found, following = at(p + step)
        if not found <= best:
            break
        rested = np.abs(step).max() <= 1e-12 or (best - found <= 1e-15 * best and np.abs(step).max() <= 1e-8)
        p, best, step = p + step, found, following
        if rested:
            break
    sigma = scale / math.sqrt(-2 * p[2])
    top = -p[1] / (2 * p[2])
    rows = [("height", math.exp(p[0] + p[1] * top / 2)), ("mean", centre + scale * top), ("sigma", sigma), ("chi2", float(best)), ("points", float(n))]
    return df.sparkSession.createDataFrame([(name, float(value)) for name, value in rows], "parameter string, value double")


def fit_histogram_normal(histogram: DataFrame, axis: Axis) -> DataFrame:
    """The normal curve through the filled bins in range, each with the error of its count."""
    points = histogram.where(F.col("bin").between(1, axis.bins) & (F.col("count") > 0)).select(
        axis.centre(F.col("bin")).alias("x"), F.col("count").cast("double").alias("y"), F.sqrt("count").alias("error"))
    return fit_normal(points, error="error")


def fit(points: DataFrame, function: str, error: str | None = None) -> DataFrame:
    """Fit a series by name, ``pol0``, ``pol1``, ... or ``gaus``; what follows a colon are display options and is ignored."""
    name = function.split(":")[0]
    if name.startswith("pol") and name[3:].isdigit():
        return fit_polynomial(points, "x", "y", int(name[3:]), error)
    if name == "gaus":
        return fit_normal(points, "x", "y", error)
    raise ValueError(f"no closed form for {function!r}")
