"""Deliveries in pieces: complete by number, by marker or by time, and taken in once."""

import time

import pytest
from pyspark.sql import functions as F

from qualframe.document import Document
from qualframe.plans.ingest import Dataset
from qualframe.queries.registry import spec_of
from qualframe.streaming.pieces import ingest_whole_deliveries, late_files

KEY = r"^([a-z]+)"


@pytest.fixture
def place(spark, tmp_path):
    df = spark.range(10)
    source = tmp_path / "in"
    source.mkdir()
    dataset = Dataset(spark, str(tmp_path / "dataset"), Document("n", "n0000001", (spec_of(df, "n"),)))

    def arrive(name, rows):
        spark.range(rows).toPandas().to_parquet(source / f"{name}.parquet", index=False)

    def run(**options):
        query = ingest_whole_deliveries(dataset, str(source), str(tmp_path / "state"), KEY, **options)
        query.awaitTermination()

    return dataset, source, arrive, run


def taken(dataset):
    return sorted((r.ingestion, r.status, r.rows) for r in dataset.manifest().collect())


def test_a_number_of_files_over_three_triggers_gives_one_row(place):
    dataset, _, arrive, run = place
    for i in range(3):
        arrive(f"a-{i}-of-3", 10)
        arrive(f"b-{i}-of-4", 5)
        run(count_pattern=r"-of-(\d+)")
        assert taken(dataset) == ([("a", "accepted", 30)] if i == 2 else [])
    run(count_pattern=r"-of-(\d+)")
    arrive("b-3-of-4", 5)
    arrive("a-3-of-3", 7)  # one too many, after the delivery was taken in
    run(count_pattern=r"-of-(\d+)")
    assert taken(dataset) == [("a", "accepted", 30), ("b", "accepted", 20)]
    assert [(r.ingestion, r.path.rsplit("/", 1)[1]) for r in late_files(dataset).collect()] == [("a", "a-3-of-3.parquet")]
    assert dataset.read().where("ingestion = 'a'").count() == 30


def test_a_marker_ends_a_delivery(place):
    dataset, source, arrive, run = place
    arrive("a-0", 3), arrive("c-0", 1)
    run(end_pattern=r"\.done$", files_per_batch=1)
    arrive("a-1", 4)
    (source / "a.done").write_text("done")
    (source / "d.done").write_text("done")  # a marker alone is no delivery
    run(end_pattern=r"\.done$")
    assert taken(dataset) == [("a", "accepted", 7)]


def test_a_delivery_is_complete_when_nothing_more_comes(place):
    dataset, _, arrive, run = place
    arrive("a-0", 3), arrive("a-1", 3)
    run(wait_seconds=0.5)
    assert taken(dataset) == []
    time.sleep(1)
    arrive("b-0", 2)  # any later trigger lets the timer of the first delivery go off
    run(wait_seconds=0.5)
    assert taken(dataset) == [("a", "accepted", 6)]


def test_a_batch_that_dies_is_taken_in_once(place, monkeypatch):
    dataset, _, arrive, run = place
    arrive("a-0-of-1", 3)
    with monkeypatch.context() as patch:
        patch.setattr(Dataset, "_commit", lambda *a: 1 / 0)
        with pytest.raises(Exception, match="division"):
            run(count_pattern=r"-of-(\d+)")
    run(count_pattern=r"-of-(\d+)")
    run(count_pattern=r"-of-(\d+)")
    assert taken(dataset) == [("a", "accepted", 3)]
    assert dataset.reports().groupBy("ingestion", "column", "check").count().where(F.col("count") > 1).count() == 0
