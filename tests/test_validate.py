import pytest
from pyspark.sql import functions as F

from qualframe.document import Document, DocumentError, FieldSpec, Rule, TableSpec
from qualframe.operators.relational import links_of, orphan_keys, reference_check, validate_relational
from qualframe.operators.uniqueness import duplicate_counts, key_counts
from qualframe.operators.validate import NAME_SEVERITY, name_outcomes, table_level, type_checks, validate
from qualframe.types import leaf_types, parquet_type

COLUMNS = list("abcde")


@pytest.mark.parametrize("data, labels", [
    (COLUMNS, ["columns_validated"]),
    (COLUMNS[::-1], ["column_order"]),
    (COLUMNS + ["x"], ["extra_columns"]),
    (["a", "b", "e"], ["missing_columns"]),
    (["a", "b", "c", "x", "e"], ["different_columns", "missing_columns", "extra_columns"]),
    (["a", "b", "c", "d", "x", "y"], ["missing_columns", "extra_columns"]),
    (["a", "b", "c", "x"], ["missing_columns", "extra_columns"]),
])
def test_name_outcomes(data, labels):
    found = name_outcomes(data, COLUMNS)
    assert [label for label, _ in found] == labels
    assert all(label in NAME_SEVERITY for label, _ in found)


def test_missing_column_is_an_error_and_its_checks_are_left_out(spark):
    spec = TableSpec("t", (FieldSpec("id", "int64"), FieldSpec("gone", "int64", rules=(Rule("less", {"error": "1"}),))))
    report = validate(spark.range(3), spec)
    assert table_level(report).first().validated == 2
    assert report.where("column = 'gone'").count() == 0


def test_nulls_never_lower_a_type_mismatch(spark):
    df = spark.range(3).select(F.lit(None).cast("int").alias("a"))
    report = validate(df, TableSpec("t", (FieldSpec("a", "int64"),)))
    assert table_level(report).first().validated == 2


def test_footer_types_win(spark):
    spec = TableSpec("t", (FieldSpec("id", "int96"),))
    checks = type_checks(spark.range(1), spec, {"id": ("int96", "NONE")})
    assert [c.check for c in checks] == ["types_validated"]


def test_column_names_with_dots_and_nested_leaves(spark):
    df = spark.range(4).select(F.col("id").alias("a.b"), F.struct(F.col("id").alias("x"), F.lit("q").alias("y")).alias("st"),
                               F.array(F.lit(1), F.lit(None)).alias("l"))
    fields = tuple(FieldSpec(p, *parquet_type(t)) for p, t in leaf_types(df.schema).items())
    assert [f.raw_name for f in fields] == ["a.b", "st.x", "st.y", "l.list.element"]
    spec = TableSpec("t", fields).with_rules(**{
        "a.b": [Rule("less", {"error": "2"})], "st.x": [Rule("less", {"warning": "3"})], "l.list.element": [Rule("less", {"error": 2})]})
    rows = {(r.column, r.check): (r.severity, r.failed) for r in validate(df, spec).collect()}
    assert rows[(None, "columns_validated")] == (0, 0)
    assert rows[("a.b", "constraint")] == (2, 2)
    assert rows[("st.x", "constraint")] == (1, 1)
    assert rows[("l.list.element", "nulls")] == (1, 4)
    assert rows[("l.list.element", "constraint")] == (0, 0)


def test_grouping_column_must_not_clash(spark):
    with pytest.raises(DocumentError):
        validate(spark.range(1).withColumn("level", F.lit(1)), TableSpec("t", (FieldSpec("id", "int64"),)), by=["level"])


def test_duplicates_of_many_types(spark):
    rows = [(1, 1.0, "a", None), (1, 2.0, "b", 5), (2, 2.0, "c", 5), (3, float("nan"), "d", None), (4, float("nan"), "e", 6)]
    df = spark.createDataFrame(rows, "i bigint, d double, s string, n int").withColumn("t", F.timestamp_seconds("i"))
    found = {r["column"]: (r.evaluated, r.failed, r.repeated_values) for r in duplicate_counts(df, ["i", "d", "s", "n", "t"]).collect()}
    assert found == {"i": (5, 2, 1), "d": (5, 4, 2), "s": (5, 0, 0), "n": (3, 2, 1), "t": (5, 2, 1)}


def test_hot_key_counts(spark):
    """A third of all rows share one key."""
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"))
    assert tuple(key_counts(df, ["k"]).first()) == (30_000, 10_000, 1)


def test_references(spark):
    child = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (None, "a"), (9, "a"), (9, "a")], "k int, x string")
    parent = spark.createDataFrame([(1,), (2,), (2,), (None,)], "p int")
    assert tuple(reference_check(child, ["k"], parent, ["p"]).first()) == (5, 2, 1)
    assert [tuple(r) for r in orphan_keys(child, ["k"], parent, ["p"]).collect()] == [(9, 2)]


def test_links_from_flags(spark):
    a = TableSpec("a", (FieldSpec("k", "int64", flags={"is_key": True}), FieldSpec("v", "int64")))
    b = TableSpec("b", (FieldSpec("b", "int64", flags={"is_key": True}), FieldSpec("k", "int64", flags={"is_join": True})))
    document = Document("d", "u", (a, b), "Relational")
    assert links_of(document) == {("b", "k"): ("a", "k")}
    frames = {"a": spark.range(3).selectExpr("id AS k", "id AS v"), "b": spark.range(5).selectExpr("id AS b", "id AS k")}
    found = {(r.table, r.check): (r.evaluated, r.failed) for r in validate_relational(frames, document).where(
        "check IN ('key_unique', 'reference')").collect()}
    assert found == {("a", "key_unique"): (3, 0), ("b", "key_unique"): (5, 0), ("b", "reference"): (5, 2)}
    with pytest.raises(DocumentError):
        validate_relational({"a": frames["a"]}, document)


def test_relational_document_round_trip():
    a = TableSpec("a", (FieldSpec("k", "int64", uid="u1"),), uid="t1")
    document = Document("d", "u", (a,), "Relational")
    assert Document.from_json(document.to_json()) == document


@pytest.mark.parametrize("broken", [
    {}, {"dataset": {"name": "x", "datatype": "Tabular"}}, {"dataset": {"name": "x", "datatype": "Graph", "uid": "u"}},
    {"dataset": {"name": "x", "datatype": "Tabular", "uid": "u"}, "model": {"fields": [{"names": {"uid": "u"}}]}},
    {"dataset": {"name": "x", "datatype": "Tabular", "uid": "u"}, "model": {"fields": [
        {"names": {"uid": "u", "raw_name": "r"}, "types": {"pq_type": "int64"}, "constraints": [{"name": "less"}]}]}},
])
def test_broken_documents(broken):
    with pytest.raises(DocumentError):
        Document.from_dict(broken)


def test_long_texts_differ_in_their_last_letter(spark):
    long = "x" * 5000
    df = spark.createDataFrame([(long + "a",), (long + "b",), (long + "b",), ("s",), ("s",), (None,)], "t string")
    assert tuple(duplicate_counts(df, ["t"]).first()) == ("t", 5, 4, 2)
    assert tuple(key_counts(df, ["t"]).first()) == (5, 4, 2)
