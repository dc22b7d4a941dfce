from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from qualframe.document import Document, DocumentError, Rule
from qualframe.plans.ingest import Dataset, part_name, row_trend, split_by_gate
from qualframe.queries.registry import spec_of
from qualframe.streaming.incremental import ingest_incremental, ingest_new_files, new_files


@pytest.fixture
def orders(spark, data):
    return spark.read.parquet(f"{data}/orders.parquet").withColumn("ingestion", F.date_format("o_orderdate", "yyyy"))


def make(spark, tmp_path, df, **rules):
    spec = spec_of(df, "orders", ["ingestion"]).with_rules(**rules)
    return Dataset(spark, str(tmp_path / "dataset"), Document("orders", "orders01", (spec,)))


def test_names_and_gate():
    assert part_name(10, "2021-06", "abc", "xyz") == "part_0010_2021-06_abc_xyz"
    assert split_by_gate({"b": 1, "a": 0, "c": 2}) == (["a", "b"], ["c"])


def test_refused_deliveries_are_not_published(spark, tmp_path, orders):
    bad = orders.withColumn("o_totalprice", F.when(F.col("ingestion") == "1996", -1.0).otherwise(F.col("o_totalprice")))
    dataset = make(spark, tmp_path, bad, o_totalprice=[Rule("greater", {"error": "0"})])
    status = {r.ingestion: r for r in dataset.ingest(bad).collect()}
    assert status["1996"].status == "rejected" and status["1996"].path is None
    accepted = [r for r in status.values() if r.status == "accepted"]
    assert sorted(r.part_no for r in accepted) == [10 * (i + 1) for i in range(len(accepted))]
    assert dataset.read().where("ingestion = '1996'").count() == 0
    assert dataset.read().count() == orders.where("ingestion <> '1996'").count()
    assert dataset.reports().where("ingestion = '1996' AND NOT accepted").count() > 0


def test_repeating_an_attempt_adds_nothing(spark, tmp_path, orders):
    dataset = make(spark, tmp_path, orders)
    dataset.ingest(orders, token="one")
    before = dataset.manifest().count(), dataset.reports().count()
    assert dataset.ingest(orders, token="one").count() == 0
    assert (dataset.manifest().count(), dataset.reports().count()) == before
    assert dataset.read().count() == orders.count()


def test_newer_delivery_replaces_older(spark, tmp_path, orders):
    dataset = make(spark, tmp_path, orders)
    dataset.ingest(orders, time="2026-01-01")
    dataset.ingest(orders.where("ingestion = '1996' AND o_orderstatus = 'F'"), time="2026-01-02")
    kept = dataset.read()
    assert kept.where("ingestion = '1996' AND o_orderstatus <> 'F'").count() == 0
    assert kept.where("ingestion = '1997'").count() == orders.where("ingestion = '1997'").count()
    assert dataset.history().count() == orders.select("ingestion").distinct().count()


def test_extra_columns_warn_and_are_dropped_missing_ones_refuse(spark, tmp_path, orders):
    dataset = make(spark, tmp_path, orders)
    dataset.ingest(orders.withColumn("extra", F.lit(1)).where("ingestion = '1996'"))
    assert "extra" not in dataset.read().columns
    assert dataset.history().first().validated == 1
    refused = dataset.ingest(orders.drop("o_custkey").where("ingestion = '1997'")).collect()
    assert [r.status for r in refused] == ["rejected"]


def test_only_some(spark, tmp_path, orders):
    dataset = make(spark, tmp_path, orders)
    assert dataset.ingest(orders, only=["1996", "1997"]).count() == 2


def test_keys_that_need_escaping(spark, tmp_path, orders):
    odd = orders.where("ingestion = '1996'").withColumn("ingestion", F.lit("a/b=c d"))
    dataset = make(spark, tmp_path, odd)
    row = dataset.ingest(odd).first()
    assert row.status == "accepted" and row.files >= 1
    assert dataset.read().count() == odd.count()


def test_keys_that_look_like_numbers_stay_text(spark, tmp_path, orders):
    odd = orders.where("ingestion = '1996'").withColumn("ingestion", F.lit("007")).withColumn("uid", F.lit(1))
    dataset = Dataset(spark, str(tmp_path / "dataset"), Document("o", "o", (spec_of(odd, "o", ["ingestion"]),)))
    dataset.ingest(odd)
    found = dataset.read()
    assert [r.ingestion for r in found.select("ingestion").distinct().collect()] == ["007"]
    assert found.agg(F.sum("uid")).first()[0] == odd.count()


def test_rows_without_a_delivery_are_an_error(spark, tmp_path, orders):
    dataset = make(spark, tmp_path, orders)
    with pytest.raises(DocumentError):
        dataset.ingest(orders.withColumn("ingestion", F.when(F.col("o_orderkey") > 5, F.col("ingestion"))))


def test_the_newest_attempt_is_read_with_one_column_order(spark, tmp_path, orders):
    dataset = make(spark, tmp_path, orders)
    dataset.ingest(orders, time="2026-01-01")
    dataset.ingest(orders.where("ingestion = '1996' AND o_orderkey < 500"), time="2026-01-02")
    found = dataset.read()
    assert found.columns == [c for c in orders.columns if c != "ingestion"] + ["ingestion", "attempt"]
    assert found.where("ingestion = '1996'").agg(F.max("o_orderkey")).first()[0] < 500


def test_a_retried_attempt_writes_its_report_once(spark, tmp_path, orders, monkeypatch):
    dataset = make(spark, tmp_path, orders)
    with monkeypatch.context() as patch:  # the job dies between report and manifest
        patch.setattr(Dataset, "_manifest_rows", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            dataset.ingest(orders, token="t")
    assert dataset.manifest().count() == 0
    dataset.ingest(orders, token="t")
    assert dataset.reports().groupBy("ingestion", "column", "check").count().where("count > 1").count() == 0
    assert dataset.reports().select("ingestion").distinct().count() == dataset.manifest().count()


def faulty_files(spark, folder, orders):
    """One file per delivery: fine, without a column, with another type, with one more column, in another order; one of two files."""
    part = lambda year: orders.where(F.col("ingestion") == year).drop("ingestion").limit(50).toPandas()
    folder.mkdir(exist_ok=True)
    frames = {
        "a": part("1995"), "b": part("1996").drop(columns="o_totalprice"),
        "c": part("1995").assign(o_custkey=lambda f: f.o_custkey.astype("int32")), "d": part("1996").assign(x=1),
        "e": part("1995")[["o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]],
        "f-1": part("1995"), "f-2": part("1996").drop(columns="o_orderstatus"),
    }
    for name, frame in frames.items():
        frame.to_parquet(folder / f"{name}.parquet", coerce_timestamps="us", index=False)


NAMES = {"a": {("columns_validated", 0)}, "b": {("missing_columns", 2)}, "c": {("columns_validated", 0)}, "d": {("extra_columns", 1)},
         "e": {("column_order", 1)}, "f": {("missing_columns", 2)}}


@pytest.mark.parametrize("streamed", [False, True])
def test_files_are_checked_one_by_one(spark, tmp_path, orders, streamed):
    dataset, source = make(spark, tmp_path, orders), tmp_path / "in"
    faulty_files(spark, source, orders)
    if streamed:
        ingest_new_files(dataset, str(source), str(tmp_path / "state"), r"^([a-z])", files_per_batch=3).awaitTermination()
    else:
        dataset.ingest_files(str(source), r"^([a-z])")
    report = dataset.reports().join(dataset.history().select("uid"), "uid", "left_semi").collect()
    found = {}
    for r in report:
        if r.check in ("columns_validated", "missing_columns", "extra_columns", "column_order", "different_columns"):
            found.setdefault(r.ingestion, set()).add((r.check, r.severity))
    assert found == NAMES
    assert {(r.ingestion, r.value) for r in report if r.check == "parquet_type"} == {("c", "int64:int32")}
    assert {r.ingestion: (r.status, r.rows) for r in dataset.history().collect()} == {
        "a": ("accepted", 50), "b": ("rejected", 50), "c": ("rejected", 50), "d": ("accepted", 50), "e": ("accepted", 50), "f": ("rejected", 100)}
    assert dataset.read().groupBy("ingestion").count().orderBy("ingestion").collect() == [("a", 50), ("d", 50), ("e", 50)]


def test_a_delivery_in_two_batches_is_whole(spark, tmp_path, orders):
    dataset, source = make(spark, tmp_path, orders), tmp_path / "in"
    source.mkdir()
    run = lambda: ingest_new_files(dataset, str(source), str(tmp_path / "state"), r"^([a-z])").awaitTermination()
    for number in (1, 2):
        orders.drop("ingestion").where(F.col("o_orderkey") % 2 == number - 1).toPandas().to_parquet(
            source / f"g-{number}.parquet", coerce_timestamps="us", index=False)
        run()
    assert dataset.read().count() == orders.count()


def test_a_second_part_is_refused_loudly(spark, tmp_path, orders):
    dataset, source = make(spark, tmp_path, orders), tmp_path / "in"
    source.mkdir()
    rows = orders.drop("ingestion")
    run = lambda: ingest_incremental(
        dataset, new_files(dataset, str(source), rows.schema, r"^([a-z])"), str(tmp_path / "state")).awaitTermination()
    rows.limit(5).toPandas().to_parquet(source / "g-1.parquet", coerce_timestamps="us", index=False)
    run()
    rows.limit(6).toPandas().to_parquet(source / "g-2.parquet", coerce_timestamps="us", index=False)
    with pytest.raises(Exception, match="taken in before"):
        run()


def test_types_of_published_files(spark, tmp_path, orders):
    """Our own files pass our own type check, timestamps included."""
    dataset = make(spark, tmp_path, orders)
    dataset.ingest(orders.where("ingestion = '1996'"))
    from qualframe.sources.footers import footer_profile, footer_rows, physical_types

    types = physical_types(footer_profile(footer_rows(spark, dataset.published_path)))
    assert types["o_orderdate"] == ("int64", "timestamp")


def test_trend_over_gaps(spark):
    counts = spark.createDataFrame([("2021-02", 5), ("2021-01", 7), ("2021-05", 5)], "ingestion string, rows bigint")
    assert [tuple(r) for r in row_trend(counts).orderBy("x").collect()] == [
        (1, "2021-01", 7, None), (2, "2021-02", 5, -2), (3, "2021-05", 5, 0)]


def test_stream_takes_each_file_once(spark, tmp_path, data):
    events = spark.read.parquet(f"{data}/events.parquet")
    source, state = tmp_path / "in", str(tmp_path / "state")
    source.mkdir()
    spec = spec_of(events, "events").with_rules(value=[Rule("less_equal", {"warning": "1"})])
    dataset = Dataset(spark, str(tmp_path / "dataset"), Document("events", "events01", (replace(spec, name="events"),)))

    def arrive(i):
        events.where(F.col("event_id") % 3 == i).toPandas().to_parquet(source / f"day_{i}.parquet", coerce_timestamps="us")

    def run():
        query = ingest_incremental(dataset, new_files(dataset, str(source), events.schema, files_per_batch=1), state)
        query.awaitTermination()

    arrive(0), arrive(1)
    run(), run()
    assert dataset.manifest().count() == 2
    arrive(2)
    run()
    assert sorted(r.ingestion for r in dataset.manifest().collect()) == ["day_0", "day_1", "day_2"]
    assert dataset.read().count() == events.count()


def test_nothing_accepted_yet(spark, tmp_path, orders):
    dataset = make(spark, tmp_path, orders, o_totalprice=[Rule("less", {"error": "0"})])
    assert dataset.history().count() == 0
    dataset.ingest(orders)
    empty = dataset.read()
    assert empty.count() == 0
    assert set(empty.columns) == set(orders.columns) | {"attempt"}
    assert empty.schema["o_orderdate"].dataType == orders.schema["o_orderdate"].dataType


def test_raw_data_is_read_once(spark, tmp_path, orders):
    """Every raw row goes through the plan of an ingestion once, refused deliveries included."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    bad = orders.withColumn("o_totalprice", F.when(F.col("ingestion") == "1996", -1.0).otherwise(F.col("o_totalprice")))
    raw = bad.mapInArrow(count, bad.schema)
    dataset = make(spark, tmp_path, bad, o_totalprice=[Rule("greater", {"error": "0"})])
    status = {r.status for r in dataset.ingest(raw).collect()}
    assert "rejected" in status and seen.value == orders.count()


def test_jobs_and_plans_do_not_grow_with_the_deliveries(spark, tmp_path, orders, monkeypatch):
    plans, jobs, tracker = {}, {}, spark.sparkContext.statusTracker()
    commit = Dataset._commit

    def watched(self, rows, token):
        plans[token] = len(rows._jdf.queryExecution().optimizedPlan().toString())
        return commit(self, rows, token)

    monkeypatch.setattr(Dataset, "_commit", watched)
    for number in (3, 120):
        dataset = make(spark, tmp_path / str(number), orders)
        spark.sparkContext.setJobGroup(f"deliveries-{number}", "ingest")
        added = dataset.ingest(orders.withColumn("ingestion", (F.col("o_orderkey") % number).cast("string")), token=f"n{number:04}")
        assert added.count() == number
        jobs[number] = len(tracker.getJobIdsForGroup(f"deliveries-{number}"))
    assert abs(plans["n0003"] - plans["n0120"]) < 200 and jobs[120] <= jobs[3] + 2, (plans, jobs)


def test_leftovers_are_files_nobody_reads(spark, tmp_path, orders):
    bad = orders.withColumn("o_totalprice", F.when(F.col("ingestion") == "1996", -1.0).otherwise(F.col("o_totalprice")))
    dataset = make(spark, tmp_path, bad, o_totalprice=[Rule("greater", {"error": "0"})])
    assert dataset.leftovers().count() == 0
    dataset.ingest(bad)
    left = [r.path for r in dataset.leftovers().collect()]
    assert left and all("ingestion=1996" in path for path in left)
