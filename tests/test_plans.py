"""What the plans must and must not contain."""

import re

import pytest

import __spark_entry__ as entry_points

DATA = "/root/testdata/sf0.001"
BATCH_QUERIES = sorted(set(entry_points.queries()) - {
    "ingest_batch", "gate", "listing", "history_latest", "report_history", "report_json", "ingest_incremental"})


def plan(spark, name):
    return entry_points.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH_QUERIES)
def test_no_pairs_of_everything(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_validation_is_one_scan_and_one_exchange(spark):
    text = plan(spark, "validate_lineitem")
    assert len(re.findall("FileScan", text)) == 1
    assert len(re.findall("Exchange ", text)) == 1


def test_monthly_validation_is_one_scan_and_one_exchange(spark):
    text = plan(spark, "validate_by_month")
    assert len(re.findall("FileScan", text)) == 1
    assert len(re.findall("Exchange ", text)) == 1


@pytest.mark.parametrize("name, columns", [
    ("hist_fixed", "l_extendedprice:double"), ("hist2d", "l_quantity:double,l_extendedprice:double"),
    ("value_counts", "l_linenumber:int"), ("fit_linear", "l_quantity:double,l_extendedprice:double"),
])
def test_only_needed_columns_are_read(spark, name, columns):
    assert set(re.findall(r"ReadSchema: struct<(.*?)>", plan(spark, name))) == {columns}


def test_no_python_in_validation_and_charts(spark):
    for name in ("validate_lineitem", "hist2d", "profile_x", "uid_encode", "row_fingerprint", "catalog_lint"):
        assert "Python" not in plan(spark, name) and "MapInPandas" not in plan(spark, name)
