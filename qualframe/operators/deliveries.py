"""Name and type checks of every delivery, from the footers of its own files.

A frame over many files has one schema, which hides that a file lacks a column, has one more or stores another type. Here each file is
compared with the specification by what its footer says; a delivery is as good as the worst of its files. The files are read by
tasks, the comparison is an aggregate over one row per file and column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualframe.document import TableSpec
from qualframe.operators.checks import result_columns
from qualframe.operators.validate import NAME_SEVERITY

STATED = (*NAME_SEVERITY, "types_validated", "parquet_type", "logical_type")


def _rows(found: DataFrame, by: str, column: Column, check: Column, value: Column, severity: Column) -> DataFrame:
    nothing = F.lit(None).cast("string")
    failed = (severity > 0).cast("bigint")
    return found.select(by, column.alias("column"), check.alias("check"), nothing.alias("constraint"), nothing.alias("level"),
                        value.alias("value"), *result_columns(F.lit(1).cast("bigint"), failed, severity))


def name_rows(footers: DataFrame, spec: TableSpec, by: str = "ingestion") -> DataFrame:
    """Outcomes of the name check per delivery; ``footers`` has a row per file (``path``), row group and leaf column."""
    columns = list(spec.columns)
    wanted = F.array(*[F.lit(c) for c in columns])
    # Leaves of lists and structs that the specification does not name stand for their column.
    name = F.when(F.col("column").isin(columns), F.col("column")).otherwise(F.split("column", r"\.")[0])
    found = footers.groupBy(by, "path").agg(F.array_sort(F.collect_set(F.struct("position", name.alias("c")))).alias("s")).select(
        by, "path", F.array_distinct(F.transform("s", lambda x: x["c"])).alias("names"))
    each = found.select(by, "path", "names", F.array_except(wanted, "names").alias("missing"), F.array_except("names", wanted).alias("extra"))
    gathered = lambda c: F.array_distinct(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("path", c))), lambda x: x[c])))
    whole = each.groupBy(by).agg(
        gathered("missing").alias("missing"), gathered("extra").alias("extra"), F.min(F.struct("path", "names"))["names"].alias("first"),
        F.bool_and(F.col("names") == wanted).alias("same"),
        F.bool_or((F.size("missing") > 0) & (F.size("names") == len(columns))).alias("different"))
    listed = lambda c: F.array_join(c, ",")
    outcome = lambda when, label, value: F.when(when, F.struct(
        F.lit(label).alias("check"), value.cast("string").alias("value"), F.lit(NAME_SEVERITY[label]).alias("fail")))
    missing, extra = F.size("missing") > 0, F.size("extra") > 0
    labels = F.array(
        outcome(F.col("same"), "columns_validated", F.lit(None)), outcome(~F.col("same") & ~missing & ~extra, "column_order", listed(F.col("first"))),
        outcome(F.col("different"), "different_columns", listed(F.col("first"))), outcome(missing, "missing_columns", listed(F.col("missing"))),
        outcome(extra, "extra_columns", listed(F.col("extra"))))
    each = whole.select(by, F.inline(F.filter(labels, lambda x: x.isNotNull())))
    return _rows(each, by, F.lit(None).cast("string"), F.col("check"), F.col("value"), F.col("fail"))


def type_rows(footers: DataFrame, spec: TableSpec, by: str = "ingestion") -> DataFrame:
    """Outcomes of the type check per delivery and column that any of its files has."""
    stated = F.array(*[F.struct(F.lit(f.raw_name).alias("column"), F.lit(f.pq_type).alias("pq"), F.lit(f.logical_type).alias("lg"))
                       for f in spec.fields])
    fields = footers.sparkSession.range(1).select(F.inline(stated))  # as many rows as the table has columns
    kinds = footers.select(by, "column", "physical", "logical").distinct().join(F.broadcast(fields), "column")
    wrong = lambda label, expected, found: F.when(F.col(expected) != F.col(found), F.struct(
        F.lit(label).alias("check"), F.concat_ws(":", expected, found).alias("value")))
    faults = F.filter(F.array(wrong("parquet_type", "pq", "physical"), wrong("logical_type", "lg", "logical")), lambda x: x.isNotNull())
    whole = kinds.groupBy(by, "column").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(faults)))).alias("faults"))
    fine = F.array(F.struct(F.lit("types_validated").alias("check"), F.lit(None).cast("string").alias("value")))
    each = whole.select(by, "column", F.inline(F.when(F.size("faults") > 0, F.col("faults")).otherwise(fine)))
    severity = F.when(F.col("check") == "types_validated", 0).otherwise(2)
    return _rows(each, by, F.col("column"), F.col("check"), F.col("value"), severity)


def row_rows(footers: DataFrame, by: str = "ingestion") -> DataFrame:
    """Rows of every delivery, as its footers count them."""
    groups = footers.groupBy(by, "path", "row_group").agg(F.max("rows").alias("n"))
    counted = groups.groupBy(by).agg(F.sum("n").alias("n"))
    nothing = F.lit(None).cast("string")
    return counted.select(by, nothing.alias("column"), F.lit("rows").alias("check"), nothing.alias("constraint"), nothing.alias("level"),
                          nothing.alias("value"), *result_columns(F.col("n"), F.lit(0).cast("bigint"), F.lit(0)))


def stated_rows(footers: DataFrame, spec: TableSpec, by: str = "ingestion") -> DataFrame:
    return reduce(DataFrame.unionByName, [name_rows(footers, spec, by), type_rows(footers, spec, by)])
