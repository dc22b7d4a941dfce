import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from qualframe.document import Document, DocumentError, Rule
from qualframe.operators.validate import validate
from qualframe.plans.statistics import open_columns, validate_document, validate_files
from qualframe.queries.registry import spec_of
from qualframe.sources.footers import footer_profile, footer_rows


@pytest.fixture
def table(spark, tmp_path):
    df = spark.range(1000).selectExpr(
        "id", "CAST(id % 10 AS INT) AS small", "CASE WHEN id % 5 = 0 THEN NULL ELSE concat('k', id % 7) END AS text",
        "CASE WHEN id = 3 THEN double('NaN') ELSE id / 10 END AS x", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, id) AS t",
        "DATE'2024-01-01' + CAST(id % 30 AS INT) AS day", "array(id, NULL) AS l")
    path = str(tmp_path / "t")
    df.repartition(3).write.option("parquet.block.size", 4096).parquet(path)
    return path


RULES = {
    "id": [Rule("greater_equal", {"warning": "0", "error": "1"}), Rule("less", {"error": "1000"})],
    "small": [Rule("not_equal", {"warning": "10", "error": "9"}), Rule("multiple_of", {"warning": "2"})],
    "text": [Rule("greater", {"warning": "k", "error": "k0"}), Rule("allowed_values", {"warning": "k1,k2"})],
    "x": [Rule("greater_equal", {"warning": "0"}), Rule("less_equal", {"warning": "1000"})],
    "t": [Rule("less", {"warning": "2024-03-01T00:00:00", "error": "2024-01-02T00:00:00"})],
    "day": [Rule("less_equal", {"warning": "2024-01-30", "error": "2024-01-29"})],
    "l.list.element": [Rule("less", {"warning": "10"})],
}


def test_footers_and_scan_give_one_report(spark, table):
    df = spark.read.parquet(table)
    spec = spec_of(df, "t").with_rules(**RULES)
    assert sorted(map(str, validate_files(spark, table, spec).collect())) == sorted(map(str, validate(df, spec).collect()))


def test_settled_columns_are_not_read(spark, table):
    df = spark.read.parquet(table)
    spec = spec_of(df, "t").with_rules(
        id=[Rule("greater_equal", {"error": "0"})], t=[Rule("less", {"error": "2025-01-01T00:00:00"})],
        x=[Rule("less", {"error": "1000"})], small=[Rule("less", {"error": "9"})])
    assert open_columns(spark, table, spec) == ["small", "x", "l.list.element"]
    plan = validate_files(spark, table, spec)._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"ReadSchema: struct<(.*?)>+$", plan, re.M) == ["small:int,x:double,l:array<bigint"]


def scanned(report):
    """Files and columns of every scan of a plan."""
    plan = report._jdf.queryExecution().executedPlan().toString()
    return sorted(zip(re.findall(r"InMemoryFileIndex\((\d+) paths\)", plan), re.findall(r"ReadSchema: struct<(.*?)>", plan)))


def plain(report):
    return sorted(map(str, report.collect()))


@pytest.fixture
def ranged(spark, tmp_path):
    """Four files by range of ``id``; the third lacks ``b``, the fourth holds a text out of order."""
    path = tmp_path / "r"
    for i in range(4):
        df = spark.range(i * 250, i * 250 + 250).selectExpr(
            "id", "IF(id % 9 = 0, NULL, id * 2) AS b", "IF(id = 999, 'z', concat('k', id % 7)) AS t", "CAST(NULL AS INT) AS void", "id / 3 AS x")
        (df.drop("b") if i == 2 else df).coalesce(1).write.mode("append").parquet(str(path))
    return str(path), spark.read.option("mergeSchema", True).parquet(str(path))


RANGED_RULES = {
    "id": [Rule("less", {"error": "990"}), Rule("greater_equal", {"warning": "500"})],
    "b": [Rule("less_equal", {"warning": "400", "error": "2000"})],
    "t": [Rule("less", {"error": "l"})],
    "void": [Rule("greater", {"error": "1"}), Rule("allowed_values", {"warning": "1,2"})],
}


def test_only_open_files_and_columns_are_read(spark, ranged):
    path, df = ranged
    spec = spec_of(df, "r").with_rules(**RANGED_RULES)
    report = validate_files(spark, path, spec)
    # The first file: b from 0 to 498 against 400. The last: id up to 999 against 990, and a text.
    assert scanned(report) == [("1", "b:bigint"), ("1", "id:bigint,t:string")]
    names = "`check` NOT IN ('columns_validated', 'missing_columns')"  # which validate_files compares file by file
    assert plain(report.where(names)) == plain(validate(df, spec).where(names))
    assert set(open_columns(spark, path, spec)) == {"id", "b", "t"}


def test_files_share_the_last_scan(spark, ranged, monkeypatch):
    from qualframe.plans import statistics

    monkeypatch.setattr(statistics, "SCANS", 1)
    path, df = ranged
    spec = spec_of(df, "r").with_rules(**RANGED_RULES)
    report = validate_files(spark, path, spec)
    ((files, columns),) = scanned(report)
    assert files == "2" and set(columns.split(",")) == {"b:bigint", "id:bigint", "t:string"}
    names = "`check` NOT IN ('columns_validated', 'missing_columns')"
    assert plain(report.where(names)) == plain(validate(df, spec).where(names))


def test_many_open_files_are_not_listed(spark, ranged, monkeypatch):
    from qualframe.plans import statistics

    monkeypatch.setattr(statistics, "LISTED", 1)
    path, df = ranged
    spec = spec_of(df, "r").with_rules(**RANGED_RULES)
    report = validate_files(spark, path, spec)
    ((files, columns),) = scanned(report)
    assert files == "1" and set(columns.split(",")) == {"id:bigint", "t:string", "b:bigint"}  # one path: the table's own
    names = "`check` NOT IN ('columns_validated', 'missing_columns')"
    assert plain(report.where(names)) == plain(validate(df, spec).where(names))


@pytest.mark.parametrize("nulls_allowed", [False, True])
def test_proofs_agree_with_counts_for_any_bound(spark, ranged, nulls_allowed):
    path, df = ranged
    for bound in ("-1", "250", "500", "999"):
        rules = [Rule(name, {"warning": bound}) for name in ("greater", "greater_equal", "less", "less_equal", "not_equal", "multiple_of", "allowed_values")
                 if name != "multiple_of" or bound not in ("0", "-1")]
        spec = spec_of(df.select("id", "b", "void"), "r").with_rules(id=rules, b=rules, void=rules)
        names = "`check` = 'constraint' OR `check` = 'nulls'"
        found = validate_files(spark, path, spec, nulls_allowed=nulls_allowed)
        assert plain(found.where(names)) == plain(validate(df, spec, nulls_allowed=nulls_allowed).where(names))


def test_known_row_counts_and_folders_named_by_values(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(100).selectExpr("id", "id % 3 AS part", "id / 2 AS x").write.partitionBy("part").parquet(path)
    df = spark.read.parquet(path)
    spec = spec_of(df, "p").with_rules(part=[Rule("less", {"error": "2"})], id=[Rule("less", {"error": "99"})])
    spec = replace(spec, table_rules=(Rule("min_rows", {"warning": "200"}), Rule("max_rows", {"error": "99"}), Rule("expression", {"error": "id <> part"})))
    kinds = "`check` IN ('constraint', 'nulls', 'table_constraint', 'rows')"
    assert plain(validate_files(spark, path, spec).where(kinds)) == plain(validate(df, spec).where(kinds))


def test_nothing_left_to_scan(spark, table):
    df = spark.read.parquet(table).drop("l", "x")
    spec = spec_of(df, "t").with_rules(id=[Rule("greater_equal", {"error": "0"})])
    report = validate_files(spark, table, spec)
    assert "FileScan" not in report._jdf.queryExecution().executedPlan().toString()
    assert {r.check for r in report.where("severity > 0").collect()} == {"extra_columns", "nulls"}


def test_files_that_disagree(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).selectExpr("CAST(id AS INT) AS a").write.parquet(path)
    spark.range(5).selectExpr("id AS a").write.mode("append").parquet(path)
    spec = spec_of(spark.range(1).selectExpr("CAST(id AS INT) AS a"), "t")
    checks = {r.check: r.value for r in validate_files(spark, path, spec).where("column = 'a'").collect()}
    assert checks["parquet_type"] == "int32:mixed"


def test_dispatch(spark):
    df = spark.range(2)
    tabular = Document("d", "u", (spec_of(df, "t"),))
    assert validate_document(tabular, df).where("severity > 0").count() == 0
    relational = Document("d", "u", (spec_of(df, "t"),), "Relational")
    assert validate_document(relational, {"t": df}).where("severity > 0").count() == 0
    with pytest.raises(DocumentError):
        validate_document(relational, df)
    with pytest.raises(DocumentError):
        validate_document(tabular, {"t": df})


def test_files_that_lack_a_column(spark, tmp_path):
    """Nulls of rows whose file has no such column, as ``validate`` counts them; the names are checked file by file."""
    import pandas as pd

    pd.DataFrame({"id": range(10), "b": [None, *range(9)]}).astype({"b": "Int64"}).to_parquet(tmp_path / "1.parquet", index=False)
    pd.DataFrame({"id": range(20)}).to_parquet(tmp_path / "2.parquet", index=False)
    df = spark.read.option("mergeSchema", True).parquet(str(tmp_path))
    spec = spec_of(df, "t").with_rules(b=[Rule("greater_equal", {"error": "0"})], id=[Rule("less", {"error": "5"})])
    plain = lambda report: {(r["column"], r.check, r["constraint"]): (r.evaluated, r.failed) for r in report.collect()}
    by_files, by_data = plain(validate_files(spark, str(tmp_path), spec)), plain(validate(df, spec))
    assert by_files.pop((None, "missing_columns", None)) == (1, 1) and by_data.pop((None, "columns_validated", None)) == (1, 0)
    assert by_files == by_data and by_files["b", "nulls", None] == (30, 21)


def test_row_groups_without_statistics(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    for name, stats in (("1", True), ("2", False)):
        pq.write_table(pa.table({"id": pa.array([1, None, 3], pa.int64()), "t": pa.array([None] * 3, pa.string())}), tmp_path / f"{name}.parquet", write_statistics=stats)
    df = spark.read.parquet(str(tmp_path))
    spec = spec_of(df, "t").with_rules(id=[Rule("less", {"error": "3"})])
    plain = lambda report: sorted(map(str, report.select("column", "check", "evaluated", "failed").collect()))
    assert plain(validate_files(spark, str(tmp_path), spec)) == plain(validate(df, spec))
    assert {r["column"]: r.nulls for r in footer_profile(footer_rows(spark, str(tmp_path))).collect()} == {"id": None, "t": None}


def test_only_numbers_without_ranges_are_scanned(spark, tmp_path, monkeypatch):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from qualframe.sources import inference

    seen, bounds = [], inference.data_bounds
    monkeypatch.setattr(inference, "data_bounds", lambda df, columns: seen.append(list(columns)) or bounds(df, columns))
    whole = pa.table({"id": pa.array([4, 9], pa.int64()), "x": pa.array([0.5, None]), "t": pa.array([None, None], pa.string())})
    pq.write_table(whole, tmp_path / "1.parquet")
    document = inference.infer_document(spark, str(tmp_path), "d")
    assert seen == []
    pq.write_table(whole, tmp_path / "2.parquet", write_statistics=["x", "t"])
    again = inference.infer_document(spark, str(tmp_path), "d")
    assert seen == [["id"]] and again.table.fields == document.table.fields


def test_ranges_of_open_files_hold_a_bounded_number_of_rows(spark, data, tmp_path, monkeypatch):
    """A task sorts a range in memory, so there are more of them for more rows."""
    from qualframe.queries import validation

    path, plain_report = str(tmp_path / "ranged"), validation.validate_open_files(spark, data)
    monkeypatch.setattr(validation, "RANGE_ROWS", 300, raising=False)
    monkeypatch.setattr(validation, "scratch_path", lambda *_: path)
    assert plain(validation.validate_open_files(spark, data)) == plain(plain_report)
    per_file = [row["count"] for row in spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()]
    assert sum(per_file) == spark.read.parquet(f"{data}/lineitem.parquet").count() and max(per_file) < 2 * 300
