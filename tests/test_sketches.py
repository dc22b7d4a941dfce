"""United sketches of deliveries against exact figures of everything that is visible."""

import pytest
from pyspark.sql import functions as F

from qualframe.document import Document
from qualframe.plans.ingest import Dataset
from qualframe.plans.sketches import DISTINCT_ERROR, RANK_ERROR, SketchHistory
from qualframe.queries.registry import spec_of


@pytest.fixture
def deliveries(spark):
    return spark.range(30_000).selectExpr(
        "concat('d', id % 7) AS ingestion", "id", "CAST(id % 13 AS INT) AS few", "IF(id % 5 = 0, NULL, concat('t', id % 9000)) AS t",
        "CASE WHEN id % 11 = 0 THEN double('NaN') WHEN id % 2 = 0 THEN 0.0 ELSE -0.0 END AS zero", "id / 7.0 AS share",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(id AS INT)) AS at", "DATE'2024-01-01' + CAST(id % 400 AS INT) AS day",
        "CAST(NULL AS DOUBLE) AS nothing", "id % 2 = 0 AS flag", "CAST(id AS DECIMAL(12,2)) AS exact")


def check(profile, df):
    for name, row in {r["column"]: r for r in profile.collect()}.items():
        c = F.col(name)
        kind = dict(df.dtypes)[name]
        usable = df.where(c.isNotNull() & ~F.isnan(c)) if kind == "double" else df.where(c.isNotNull())
        n, exact = usable.count(), usable.select(c + 0.0 if kind == "double" else c).distinct().count()
        assert (row["rows"], row["nulls"] + row["nan"]) == (df.count(), df.count() - n), name
        assert abs(row["distinct"] - exact) <= max(4 * DISTINCT_ERROR * exact, 0), name
        if kind in ("string", "boolean") or not n:
            assert row["quantiles"] is None
            continue
        value = F.unix_micros(c.cast("timestamp")).cast("double") if kind in ("timestamp_ntz", "date") else c.cast("double")
        for q, found in row["quantiles"].items():
            below, upto = usable.select(F.count_if(value < found) / n, F.count_if(value <= found) / n).first()
            assert below - 2 * RANK_ERROR <= q <= upto + 2 * RANK_ERROR, (name, q)
        assert usable.select(F.min(value), F.max(value)).first() == (row["low"], row["high"])


def test_history_is_the_union_of_its_deliveries(spark, tmp_path, deliveries):
    dataset = Dataset(spark, str(tmp_path / "d"), Document("s", "s0000001", (spec_of(deliveries, "s", ["ingestion"]),)))
    history = SketchHistory(dataset)
    assert history.refresh() == 0 and history.profile().count() == 0
    dataset.ingest(deliveries.where("ingestion < 'd4'"))
    assert history.refresh() == 4 and history.refresh() == 0
    dataset.ingest(deliveries.where("ingestion >= 'd4'"))
    assert history.refresh() == 3
    check(history.profile([0.01, 0.5, 0.99]), deliveries)
    # A delivery that comes again takes the place of its sketches.
    shorter = deliveries.where("ingestion = 'd0' AND id < 700")
    dataset.ingest(shorter)
    assert history.refresh() == 1
    check(history.profile(), deliveries.where("ingestion <> 'd0'").unionByName(shorter))
    plan = history.profile()._jdf.queryExecution().executedPlan().toString()
    assert "published" not in plan
    each = {(r.ingestion, r["column"]): r.rows for r in history.profile(by=["ingestion"]).collect()}
    assert each["d0", "id"] == 100 and len(each) == 7 * 10
