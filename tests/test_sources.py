import hashlib
import json
from pathlib import Path
from urllib.parse import unquote, urlparse

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from qualframe.document import Document, DocumentError
from qualframe.functions.fingerprint import row_fingerprint
from qualframe.functions.transforms import latlon_to_cell
from qualframe.functions.uid import decode_uid, encode_uid, largest, with_uid
from qualframe.functions.columns import fill_template, part_number
from qualframe.queries.catalog import queries
from qualframe.sources import catalog, files, footers, hashes, inference, metadata


def test_uid_known_values(spark):
    known = {0: "11111111", 61: "1111111z", 62: "11111121", largest(): "SOYTZ1AR"}
    df = spark.createDataFrame([(n,) for n in (*known, -1, largest() + 1)], "n bigint").select("n", encode_uid(F.col("n")).alias("u"))
    assert {r.n: r.u for r in df.collect()} == {**known, -1: None, largest() + 1: None}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(numbers=st.lists(st.integers(0, 99999999999999), min_size=1, max_size=30))
def test_uid_round_trip(spark, numbers):
    df = spark.createDataFrame([(n,) for n in numbers], "n bigint")
    assert df.where(decode_uid(encode_uid(F.col("n"))) != F.col("n")).count() == 0


@pytest.mark.parametrize("text, number", [
    ("", 0), ("z", 61), ("21", 62), ("zzzzzzzz", None), ("111111111", None), ("a-b", None), ("abc\n", None), (None, None)])
def test_uid_decode(spark, text, number):
    assert spark.createDataFrame([(text,)], "t string").select(decode_uid(F.col("t"))).first()[0] == number


def test_uid_depends_on_keys_only(spark):
    a = with_uid(spark.range(50), ["id"]).collect()
    assert sorted(a) == sorted(with_uid(spark.range(50).repartition(7), ["id"]).collect())


def test_fingerprint_ignores_order_but_not_content(spark):
    df = spark.range(100).selectExpr("id", "CASE WHEN id % 3 = 0 THEN NULL ELSE id END AS a", "CASE WHEN id % 3 = 0 THEN id END AS b")
    one = row_fingerprint(df).first()
    assert row_fingerprint(df.repartition(5)).first() == one
    assert row_fingerprint(df.select("id", F.col("b").alias("a"), F.col("a").alias("b"))).first().fingerprint != one.fingerprint
    assert row_fingerprint(df.where("id < 99")).first().fingerprint != one.fingerprint


def test_small_helpers(spark):
    row = spark.range(1).select(part_number(F.lit(10)), part_number(F.lit(123456)), fill_template("data/{x}/raw/{x}", "z")).first()
    assert tuple(row) == ("0010", "123456", "data/z/raw/z")
    cell = lambda lat, lon: spark.range(1).select(latlon_to_cell(F.lit(lat), F.lit(lon), 1.0)).first()[0]
    assert cell(0.5, -0.5) == "90_179" and cell(91.0, 0.0) is None


def test_csv_rules(spark, tmp_path):
    path = tmp_path / "delivery.csv_files.csv"
    path.write_text('a,b,c\n1,x,1.5\n2,"",\n,y,2.5\n')
    inferred = files.read_csv(spark, str(path))
    assert [f.dataType.simpleString() for f in inferred.schema.fields] == ["bigint", "string", "double"]
    assert sorted(map(str, inferred.collect())) == sorted(map(str, files.read_csv(spark, str(path), "a bigint, b string, c double").collect()))
    kept = files.read_csv(spark, str(path), "a bigint, b string, c double", keep_empty=True)
    assert [r.b for r in kept.collect()] == ["x", "", "y"]
    assert files.parquet_path(str(path)) == str(tmp_path / "delivery.csv_files.parquet")
    loaded = files.load_data(spark, str(path), ["c", "a"])
    assert loaded.columns == ["c", "a"] and loaded.count() == 3
    path.write_text("broken")  # the Parquet table is there by now and is what gets read
    assert files.load_data(spark, str(path)).count() == 3


def test_projection(spark):
    df = spark.range(1).selectExpr("id AS `a.b`", "id AS c", "id AS d")
    assert files.project(df, ["d", "a.b"]).columns == ["d", "a.b"]
    with pytest.raises(DocumentError):
        files.project(df, ["x"])


def test_hash_is_that_of_the_file(spark, tmp_path):
    spark.range(1000).repartition(3).write.parquet(str(tmp_path / "t"))
    found = {Path(r.path).name: r.sha256 for r in hashes.content_hashes(spark, str(tmp_path / "t")).collect()}
    assert found == {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in (tmp_path / "t").glob("*.parquet")}
    assert len(found) == 3


def test_footers_of_many_types(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(1000).selectExpr(
        "id", "CAST(id AS INT) AS i", "CAST(id AS SMALLINT) AS s", "CAST(id AS DECIMAL(9,2)) AS d", "id % 2 = 0 AS b",
        "CASE WHEN id % 4 = 0 THEN NULL ELSE concat('x', id) END AS t", "DATE'2024-01-01' + CAST(id AS INT) AS day",
        "timestamp_seconds(id) AS ts", "struct(id AS x, array(id) AS l) AS st")
    df.repartition(2).write.option("parquet.block.size", 4096).parquet(path)
    profile = footers.with_bounds(footers.footer_profile(footers.footer_rows(spark, path)))
    rows = {r["column"]: r for r in profile.collect()}
    assert list(r["column"] for r in profile.orderBy("position").collect()) == [
        "id", "i", "s", "d", "b", "t", "day", "ts", "st.x", "st.l.list.element"]
    assert all(r.rows == 1000 and r.complete and r.types == 1 for r in rows.values())
    assert (rows["id"].min, rows["id"].max) == ("0", "999")
    assert rows["t"].nulls == 250 and rows["day"].max == "2026-09-26" and rows["ts"].max == "1970-01-01T00:16:39"
    from qualframe.types import leaf_types, parquet_type

    assert footers.physical_types(profile) == {c: parquet_type(t) for c, t in leaf_types(df.schema).items()}


def test_footers_and_data_agree(spark, data):
    document = inference.infer_document(spark, f"{data}/orders.parquet", "orders")
    again = inference.infer_from_data(spark.read.parquet(f"{data}/orders.parquet"), "orders")
    assert document == again
    field = document.table.field("o_totalprice")
    assert [rule.name for rule in field.rules] == ["greater_equal", "less_equal"] and not field.rules[0].enabled
    assert document.table.field("o_orderstatus").rules == ()
    assert Document.from_json(document.to_json()) == document


def test_selected_columns(spark, data):
    document = inference.infer_document(spark, f"{data}/orders.parquet", "orders", ["o_custkey"])
    assert document.table.columns == ["o_custkey"]


def test_metadata_rules(spark, tmp_path):
    df = spark.range(3).withMetadata("id", {"other": 1})
    df = metadata.set_column_metadata(df, "id", "names", {"a": 1})
    df = metadata.set_column_metadata(df, "id", "names", {"a": 2, "b": 3})
    df = metadata.set_column_metadata(df, "id", "constraints", [1])
    df = metadata.set_column_metadata(df, "id", "constraints", [2])
    df.write.parquet(str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.schema["id"].metadata["other"] == 1
    assert metadata.read_column_metadata(back, "id") == {"names": {"a": 2, "b": 3}, "constraints": [2]}
    assert metadata.read_column_metadata(back, "id", "flags") == {}
    assert metadata.read_column_metadata(spark.range(1), "id") == {}
    computed = back.withColumn("id", F.col("id") + 1)
    assert metadata.read_column_metadata(metadata.keep_metadata(computed, back), "id", "constraints") == [2]
    listed = footers.harvested_documents(footers.harvest_metadata(spark, str(tmp_path / "t"))).collect()
    assert listed and all(r.columns == 1 and json.loads(r.fields)[0]["column"] == "id" for r in listed)


def test_metadata_written_by_arrow(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    field = pa.field("a", pa.int64(), metadata={metadata.SECTION_KEY: json.dumps({"names": {"x": 1}})})
    pq.write_table(pa.table({"a": [1, 2], "b": [1, 2]}, schema=pa.schema([field, pa.field("b", pa.int64())])), tmp_path / "t.parquet")
    rows = footers.harvest_metadata(spark, str(tmp_path)).collect()
    assert [(r["column"], r.section, r.json) for r in rows] == [("a", "names", '{"x": 1}')]


def test_catalog_of_files(spark, data, tmp_path):
    good = inference.infer_document(spark, f"{data}/orders.parquet", "orders")
    (tmp_path / "good.json").write_text(good.to_json())
    lacking = json.loads(good.to_json())
    del lacking["model"]["fields"][0]["types"]["pq_type"], lacking["dataset"]["datatype"]
    lacking["model"]["fields"][1]["names"]["uid"] = lacking["model"]["fields"][2]["names"]["uid"]
    lacking["model"]["fields"][1]["constraints"][0]["name"] = "min_length"
    (tmp_path / "lacking.json").write_text(json.dumps(lacking))
    (tmp_path / "broken.json").write_text('{"dataset": ')
    wrong = json.loads(good.to_json())
    wrong["dataset"] = {"name": 5, "datatype": "Tabular", "uid": "other"}
    wrong["model"]["fields"][1]["flags"]["is_raw"] = "yes"
    wrong["model"]["fields"][2]["names"] = ["a"]
    del wrong["model"]["table_data"], wrong["model"]["status"]
    (tmp_path / "wrong.json").write_text(json.dumps(wrong))
    (tmp_path / "empty.json").write_text('{"dataset": {"name": "a", "datatype": "Tabular", "uid": "b"}, "model": {}}')
    found = catalog.lint_documents(catalog.read_documents(spark, str(tmp_path))).collect()
    by_file = {}
    for r in found:
        by_file.setdefault(r.document.split("/")[-1], set()).add((r.issue, r.detail))
    assert by_file["lacking.json"] == {
        ("missing", "dataset.datatype"), ("missing", "types.pq_type"), ("duplicate_field_uid", None),
        ("constraint_not_applicable", "min_length")}
    assert ("not_readable", None) in by_file["broken.json"]
    assert {detail for issue, detail in by_file["wrong.json"] if issue == "wrong_type"} == {
        "dataset.name", "model.fields[1].flags.is_raw", "model.fields[2].names"}
    assert by_file["empty.json"] == {("missing", f"model.{path}") for path in ("table_data.name", "table_data.uid", "status.status", "fields")}
    assert by_file["good.json"] == {("duplicate_dataset_uid", good.uid)}


def test_footprint(spark, data):
    rows = {r.kind: r for r in files.footprint(spark, {"parquet": f"{data}/orders.parquet"}, spark.read.parquet(f"{data}/orders.parquet")).collect()}
    assert rows["parquet"].megabytes == Path(f"{data}/orders.parquet").stat().st_size / 1e6
    assert rows["memory"].rows == 1500 and rows["memory"].columns == 6 and rows["memory"].megabytes > 0


def test_xml_is_written_in_short_files(spark, data, monkeypatch):
    """No reader splits XML, so the length of a file is the work of one task."""
    monkeypatch.setattr(files, "XML_FILE", 2_000, raising=False)
    found = queries()["xml_round_trip"](spark, data)
    lengths = [Path(unquote(urlparse(name).path)).stat().st_size for name in found.inputFiles()]
    assert sum(lengths) > 10 * 2_000 and max(lengths) < 2 * 2_000
    part = spark.read.parquet(f"{data}/part.parquet")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, part.select(found.columns).collect()))


def test_xml_of_odd_rows_in_short_files(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(files, "XML_FILE", 400)
    rows = [(i, None if i % 7 == 0 else "</row> <row> & é" * (i % 5 + 1), [i, i + 1], (f"s{i}",)) for i in range(60)]
    schema = "n bigint, t string, list array<bigint>, s struct<u: string>"
    df = spark.createDataFrame(rows, schema)
    files.write_xml(df, str(tmp_path / "x"), "row", "rows")
    assert sorted(map(str, files.read_xml(spark, str(tmp_path / "x"), "row", schema).collect())) == sorted(map(str, df.collect()))
    files.write_xml(df.limit(0), str(tmp_path / "none"), "row", "rows")
    assert files.read_xml(spark, str(tmp_path / "none"), "row", schema).count() == 0
