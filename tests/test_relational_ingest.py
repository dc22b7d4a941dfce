"""Deliveries of several tables: all or nothing, references to the delivery itself and to what is published."""

import pytest
from pyspark.sql import functions as F

from qualframe.document import Document, DocumentError, Rule
from qualframe.operators.relational import links_of, validate_relational
from qualframe.plans.relational_ingest import RelationalDataset
from qualframe.queries.registry import spec_of

CUSTOMER = "ingestion string, region int, number bigint, name string"
ORDER = "ingestion string, region int, number bigint, id bigint, price double"


def document(spark, **rules):
    """Customers by region and number; orders refer to them by both."""
    customer = spec_of(spark.createDataFrame([], CUSTOMER), "customer", ["ingestion"])
    order = spec_of(spark.createDataFrame([], ORDER), "order", ["ingestion"]).with_rules(**rules)
    for name in ("region", "number"):
        customer = customer.replace_field(customer.field(name).with_flags(is_key=True))
        order = order.replace_field(order.field(name).with_flags(is_join=True))
    order = order.replace_field(order.field("id").with_flags(is_key=True))
    return Document("shop", "shop0001", (customer, order), "Relational")


def frames(spark, customers, orders):
    return {"customer": spark.createDataFrame(customers, CUSTOMER), "order": spark.createDataFrame(orders, ORDER)}


def status(rows):
    return {r.ingestion: (r.status, r.rows) for r in rows.collect()}


def visible(dataset, name):
    return sorted(tuple(r)[:-2] + (r.ingestion,) for r in dataset.read_table(name).collect())


def test_compound_references(spark):
    doc = document(spark)
    assert links_of(doc) == {("order", ("region", "number")): ("customer", ("region", "number"))}
    tables = {name: df.drop("ingestion") for name, df in frames(
        spark, [("a", 1, 1, "x"), ("a", 1, 2, "y")], [("a", 1, 1, 1, 5.0), ("a", 2, 1, 2, 5.0), ("a", None, 1, 3, 5.0), ("a", 1, 2, 4, 5.0)]).items()}
    found = {r["column"]: (r.evaluated, r.failed, r.value) for r in validate_relational(tables, doc).where("check = 'reference'").collect()}
    assert found == {"region,number": (3, 1, "customer.region,number")}


def test_an_orphan_refuses_the_whole_delivery(spark, tmp_path):
    dataset = RelationalDataset(spark, str(tmp_path / "d"), document(spark))
    first = frames(spark, [("a", 1, 1, "x"), ("a", 1, 2, "y"), ("b", 1, 7, "z"), ("c", 2, 1, "w")],
                   [("a", 1, 1, 1, 5.0), ("a", 1, 2, 2, 5.0), ("b", 1, 7, 3, 5.0), ("b", 1, 8, 4, 5.0), ("c", 1, 1, 5, 1.0)])
    assert status(dataset.ingest_tables(first)) == {"a": ("accepted", 4), "b": ("rejected", 3), "c": ("rejected", 2)}  # c refers to a, which is not published yet
    assert visible(dataset, "customer") == [(1, 1, "x", "a"), (1, 2, "y", "a")] and len(visible(dataset, "order")) == 2
    again = frames(spark, [("c", 2, 1, "w")], [("c", 1, 1, 5, 1.0), ("d", 1, 2, 6, 1.0), ("e", 1, 7, 7, 1.0)])
    assert status(dataset.ingest_tables(again)) == {"c": ("accepted", 2), "d": ("accepted", 1), "e": ("rejected", 1)}  # the customer of e was refused
    assert {r[-1] for r in visible(dataset, "order")} == {"a", "c", "d"} and {r[-1] for r in visible(dataset, "customer")} == {"a", "c"}
    failed = dataset.reports().where("severity = 2").select("ingestion", "table", "check", "failed").collect()
    assert sorted(map(tuple, failed)) == [("b", "order", "reference", 1), ("c", "order", "reference", 1), ("e", "order", "reference", 1)]
    assert [(r.ingestion, r.part_no) for r in dataset.history().where("part_no IS NOT NULL").orderBy("part_no").collect()] == [("a", 10), ("c", 20), ("d", 30)]


def test_a_delivery_that_comes_again_takes_its_parents_along(spark, tmp_path):
    dataset = RelationalDataset(spark, str(tmp_path / "d"), document(spark))
    dataset.ingest_tables(frames(spark, [("a", 1, 1, "x"), ("a", 1, 2, "y")], [("a", 1, 1, 1, 5.0)]))
    shorter = frames(spark, [("a", 1, 1, "x")], [("a", 1, 2, 1, 5.0)])
    assert status(dataset.ingest_tables(shorter)) == {"a": ("rejected", 2)}
    assert len(visible(dataset, "customer")) == 2
    assert status(dataset.ingest_tables(frames(spark, [("a", 1, 3, "x")], [("a", 1, 3, 1, 5.0)]))) == {"a": ("accepted", 2)}
    assert visible(dataset, "customer") == [(1, 3, "x", "a")]


def test_rules_keys_and_missing_columns_refuse_too(spark, tmp_path):
    dataset = RelationalDataset(spark, str(tmp_path / "d"), document(spark, price=[Rule("greater", {"error": "0"})]))
    first = frames(spark, [("a", 1, 1, "x"), ("b", 1, 1, "x"), ("b", 1, 1, "twice"), ("c", 1, 1, "x")], [("a", 1, 1, 1, 5.0), ("b", 1, 1, 1, 5.0), ("c", 1, 1, 1, -5.0)])
    assert status(dataset.ingest_tables(first)) == {"a": ("accepted", 2), "b": ("rejected", 3), "c": ("rejected", 2)}
    broken = {**frames(spark, [("f", 1, 9, "x")], []), "order": spark.createDataFrame([("f", 1)], "ingestion string, region int")}
    assert status(dataset.ingest_tables(broken)) == {"f": ("rejected", 2)}
    with pytest.raises(DocumentError):
        dataset.ingest_tables({"customer": broken["customer"]})


def test_repeating_an_attempt_and_a_job_that_dies(spark, tmp_path, monkeypatch):
    dataset = RelationalDataset(spark, str(tmp_path / "d"), document(spark))
    data = frames(spark, [("a", 1, 1, "x")], [("a", 1, 1, i, 5.0) for i in range(3_000)])
    with monkeypatch.context() as patch:
        patch.setattr(RelationalDataset, "_commit", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            dataset.ingest_tables(data, token="t")
    assert dataset.manifest().count() == 0 and visible(dataset, "customer") == []
    assert status(dataset.ingest_tables(data, token="t")) == {"a": ("accepted", 3_001)}
    assert dataset.ingest_tables(data, token="t").count() == 0 and dataset.manifest().count() == 1
    assert dataset.reports().groupBy("ingestion", "table", "column", "check").count().where("count > 1").count() == 0


def test_two_runs_do_not_share_numbers(spark, tmp_path, monkeypatch):
    from qualframe.plans import ingest

    monkeypatch.setattr(ingest, "COMMIT_WAIT", 1)
    dataset = RelationalDataset(spark, str(tmp_path / "d"), document(spark))
    data = frames(spark, [("a", 1, 1, "x")], [])
    with dataset._alone("another run"):
        with pytest.raises(DocumentError, match="another run"):
            dataset.ingest_tables(data, token="mine")
    assert dataset.manifest().count() == 0
    (tmp_path / "d" / "committing").write_text("mine")  # the claim of this attempt, which died
    assert status(dataset.ingest_tables(data, token="mine")) == {"a": ("accepted", 1)}
    assert not (tmp_path / "d" / "committing").exists()
