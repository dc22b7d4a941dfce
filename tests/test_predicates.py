import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qualframe.document import DocumentError, FieldSpec, Rule, TableSpec
from qualframe.functions.predicates import APPLICABLE, applies_to, literal, predicate
from qualframe.operators.checks import rule_checks, run_checks
from qualframe.operators.validate import split_rows, table_level, validate


def outcomes(spark, dtype, values, constraint, value, **options):
    df = spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("c", dtype)]))
    return [row.p for row in df.select(predicate(constraint, F.col("c"), dtype, value, **options).alias("p")).collect()]


NAN = float("nan")


@pytest.mark.parametrize("constraint, value, expected", [
    ("greater", "1", [False, True, False, None, True]),
    ("greater_equal", "1", [True, True, False, None, True]),
    ("less", "2", [True, False, False, None, False]),
    ("less_equal", "2", [True, True, False, None, False]),
    ("not_equal", "1", [False, True, True, None, True]),
    ("multiple_of", "0.5", [True, True, False, None, False]),
    ("allowed_values", "1,3", [True, False, False, False, False]),
])
def test_doubles_with_nan_and_null(spark, constraint, value, expected):
    assert outcomes(spark, T.DoubleType(), [1.0, 2.0, NAN, None, math.inf], constraint, value) == expected


@pytest.mark.parametrize("constraint, value, expected", [
    ("min_length", "3", [True, False, False, None]),
    ("max_length", 2, [False, True, True, None]),
    ("regex", "b", [True, False, False, None]),
    ("greater", "abc", [False, True, True, None]),
    ("allowed_values", "abc, é", [True, False, False, False]),
    ("allowed_values", ["abc", "é"], [True, True, False, False]),
])
def test_text(spark, constraint, value, expected):
    assert outcomes(spark, T.StringType(), ["abc", "é", "z", None], constraint, value) == expected


@pytest.mark.parametrize("name, good, bad", [
    ("email", "a@b.org", "a b@c"), ("uuid", "123e4567-e89b-12d3-a456-426614174000", "123e4567"),
    ("ipv4", "10.0.255.1", "10.0.256.1"), ("uri", "http://x.org/a?b", "no uri"), ("hostname", "a-b.org", "-a.org"),
    ("date", "2024-02-29", "2023-02-29"), ("time", "23:59:59", "24:00:00"),
    ("date-time", "2024-02-29T12:00:00Z", "2024-02-30T12:00:00Z"),
])
def test_formats(spark, name, good, bad):
    assert outcomes(spark, T.StringType(), [good, bad, None], "format", name) == [True, False, None]


def test_nulls_allowed(spark):
    assert outcomes(spark, T.StringType(), ["a", None], "allowed_values", "b", nulls_allowed=True) == [False, None]


@pytest.mark.parametrize("value, dtype", [
    ("5.0", T.LongType()), (5.5, T.LongType()), ("x", T.DoubleType()), ("300", T.ByteType()),
    ("2024-01-01", T.TimestampNTZType()), ("2024-01-01T00:00:00.5", T.TimestampType()), ("yes", T.BooleanType()),
    ("1.234", T.DecimalType(5, 2)), ("1000", T.DecimalType(5, 2)), ("01/02/2024", T.DateType()), ("a", T.BinaryType()),
])
def test_values_that_do_not_fit_the_type(spark, value, dtype):
    with pytest.raises(DocumentError):
        literal(value, dtype)


@pytest.mark.parametrize("constraint, dtype, value", [
    ("no_such", T.LongType(), "1"), ("multiple_of", T.StringType(), "2"), ("multiple_of", T.LongType(), "0"),
    ("min_length", T.LongType(), "2"), ("regex", T.DoubleType(), "a"), ("format", T.StringType(), "isbn"),
    ("less", T.BinaryType(), "1"), ("max_length", T.StringType(), "many"),
])
def test_constraints_that_cannot_work(spark, constraint, dtype, value):
    with pytest.raises(DocumentError):
        predicate(constraint, F.col("c"), dtype, value)


def test_error_names_field_and_constraint(spark):
    df = spark.range(3)
    spec = FieldSpec("id", "int64", rules=(Rule("less", {"warning": "ten"}),))
    with pytest.raises(DocumentError, match="id: less .warning."):
        rule_checks(df, spec)


def test_levels_and_blanks():
    assert Rule("less", {"warning": "", "error": None}).levels() == []
    assert Rule("less", {"warning": 0, "error": ""}).levels() == [("warning", 0)]
    assert Rule("less", {"warning": 1, "error": 2}, enabled=False).levels() == []


def test_all_null_column_passes(spark):
    df = spark.range(4).select(F.lit(None).cast("bigint").alias("c"))
    rows = run_checks(df, rule_checks(df, FieldSpec("c", "int64", rules=(Rule("less", {"error": "1"}), Rule("allowed_values", {"error": "1"})))))
    assert {(r.constraint, r.status, r.evaluated, r.failed) for r in rows.collect()} == {
        ("less", "Pass", 0, 0), ("allowed_values", "Fail", 4, 4)}


def test_counts_add_up(spark, lineitem):
    """true + false + null = rows, for every batch size."""
    spec = FieldSpec("l_quantity", "double", rules=tuple(Rule("less", {"warning": str(n)}) for n in range(1, 30)))
    small = run_checks(lineitem, rule_checks(lineitem, spec), batch=7)
    large = run_checks(lineitem, rule_checks(lineitem, spec))
    assert sorted(small.collect()) == sorted(large.collect())
    rows = lineitem.count()
    for row in small.collect():
        assert row.evaluated == rows
        assert row.failed == lineitem.where(F.col("l_quantity") >= float(row.value)).count()
        break


def test_registry():
    assert len(APPLICABLE) == 12
    assert applies_to("regex", {"byte_array"}) and not applies_to("regex", {"int64"})
    assert applies_to("allowed_values", {"int64", "is_categorical"})


def test_empty_frame(spark):
    df = spark.createDataFrame([], "a bigint, b string")
    spec = TableSpec("t", (FieldSpec("a", "int64", rules=(Rule("less", {"error": "1"}), Rule("unique", {"error": "true"}))),
                           FieldSpec("b", "byte_array", "string")))
    report = validate(df, spec)
    assert report.where("constraint = 'unique'").count() == 1
    assert table_level(report).first().validated == 0


def test_split_is_complete(spark, lineitem):
    spec = TableSpec("t", (FieldSpec("l_quantity", "double", rules=(Rule("less", {"warning": "2", "error": "25"}),)),))
    good, bad = split_rows(lineitem, spec)
    assert good.count() + bad.count() == lineitem.count()
    assert bad.where("l_quantity < 25").count() == 0


def test_quotes_and_backslashes_in_values(spark):
    df = spark.createDataFrame([("it's",), ("a\\b",)], "c string")
    rules = (Rule("regex", {"warning": r"^it's$"}), Rule("regex", {"warning": r"\\"}))
    rows = run_checks(df, rule_checks(df, FieldSpec("c", "byte_array", "string", rules=rules))).collect()
    assert [(r.value, r.failed) for r in rows] == [("^it's$", 1), (r"\\", 1)]
