"""Validate a frame against a table specification."""

from __future__ import annotations

from functools import reduce
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualframe.document import LEVELS, DocumentError, TableSpec
from qualframe.functions.columns import has_column, leaf, ref, roots
from qualframe.functions.predicates import leaf_predicate
from qualframe.operators.checks import (
    Check, null_check, result_columns, rule_checks, run_checks, stated_check, table_checks,
)
from qualframe.operators.uniqueness import duplicate_counts, key_counts
from qualframe.types import leaf_types, parquet_type

# Outcomes of the column-name check and their severity.
NAME_SEVERITY = {
    "columns_validated": 0, "column_order": 1, "extra_columns": 1, "different_columns": 2, "missing_columns": 2,
}


def name_outcomes(data_columns: Sequence[str], schema_columns: Sequence[str]) -> list[tuple[str, list[str]]]:
    """Outcomes of comparing column names, each with the columns concerned.

    Sets are compared, so missing and extra columns are both reported; ``different_columns`` says that the
    counts agree although the names do not.
    """
    missing = [c for c in schema_columns if c not in data_columns]
    extra = [c for c in data_columns if c not in schema_columns]
    if not missing and not extra:
        if list(data_columns) == list(schema_columns):
            return [("columns_validated", [])]
        return [("column_order", list(data_columns))]
    outcomes = []
    if missing and len(data_columns) == len(schema_columns):
        outcomes.append(("different_columns", list(data_columns)))
    if missing:
        outcomes.append(("missing_columns", missing))
    if extra:
        outcomes.append(("extra_columns", extra))
    return outcomes


def name_checks(data_columns: Sequence[str], spec: TableSpec) -> list[Check]:
    return [
        stated_check(None, label, NAME_SEVERITY[label], ",".join(columns) or None)
        for label, columns in name_outcomes(data_columns, roots(spec.columns, data_columns))
    ]


def type_checks(df: DataFrame, spec: TableSpec, physical: Mapping[str, tuple[str, str]] | None = None) -> list[Check]:
    """Compare physical and logical type; ``physical`` holds exact footer types where they are known."""
    leaves = {path: parquet_type(dtype) for path, dtype in leaf_types(df.schema).items()}
    leaves.update(physical or {})
    checks = []
    for field in spec.fields:
        if field.raw_name not in leaves:
            continue
        pq_type, logical = leaves[field.raw_name]
        found = []
        if field.pq_type != pq_type:
            found.append(stated_check(field.raw_name, "parquet_type", 2, f"{field.pq_type}:{pq_type}"))
        if field.logical_type != logical.lower():
            found.append(stated_check(field.raw_name, "logical_type", 2, f"{field.logical_type}:{logical.lower()}"))
        checks += found or [stated_check(field.raw_name, "types_validated", 0)]
    return checks


def unique_rows(df: DataFrame, spec: TableSpec, by: Sequence[str], present: set[str]) -> list[DataFrame]:
    """Results of the ``unique`` constraints, on columns and on lists of columns."""
    groups = [ref(c) for c in by]
    out = []
    wanted = [(f.raw_name, level, str(value)) for f in spec.fields if f.raw_name in present
              for rule in f.rules if rule.name == "unique" for level, value in rule.levels()
              if str(value).lower() not in ("false", "0")]
    if wanted:
        counts = duplicate_counts(df, sorted({column for column, _, _ in wanted}), by)
        labels = F.array(*[
            F.struct(F.lit(column).alias("c"), F.lit(level).alias("level"), F.lit(value).alias("value"),
                     F.lit(LEVELS[level]).alias("s"))
            for column, level, value in wanted
        ])
        rows = counts.withColumn("_l", F.explode(labels)).where(F.col("_l.c") == F.col("column"))
        out.append(rows.select(
            *groups, "column", F.lit("constraint").alias("check"), F.lit("unique").alias("constraint"),
            "_l.level", "_l.value", *result_columns(F.col("evaluated"), F.col("failed"), F.col("_l.s")),
        ))
    for rule in spec.table_rules:
        for level, value in rule.levels() if rule.name == "unique" else ():
            columns = [c.strip() for c in value.split(",")] if isinstance(value, str) else list(value)
            counts = key_counts(df, columns, by)
            out.append(counts.select(
                *groups, F.lit(None).cast("string").alias("column"), F.lit("table_constraint").alias("check"),
                F.lit("unique").alias("constraint"), F.lit(level).alias("level"),
                F.lit(",".join(columns)).alias("value"),
                *result_columns(F.col("evaluated"), F.col("failed"), F.lit(LEVELS[level])),
            ))
    return out


def validate(
    df: DataFrame,
    spec: TableSpec,
    by: Sequence[str] = (),
    physical: Mapping[str, tuple[str, str]] | None = None,
    nulls_allowed: bool = False,
    delivered: Sequence[str] | None = None,
) -> DataFrame:
    """The validation report: one row per check, and per group of ``by`` (such as one delivery).

    Names are checked on the frame as it was delivered (or on the names ``delivered``, where the frame has been projected since);
    columns that are missing are reported and then left out of the per-column checks. ``by`` columns are no part of the data.
    """
    unknown = [c for c in by if c not in df.columns]
    if unknown:
        raise DocumentError(f"no grouping column {unknown}")
    data_columns = [c for c in (df.columns if delivered is None else delivered) if c not in by or c in spec.columns]
    rows = Check(None, "rows", F.count(F.lit(1)), 0, 0)
    checks = [rows, *name_checks(data_columns, spec), *type_checks(df, spec, physical)]
    present = set()
    for field in spec.fields:
        if not has_column(df.schema, field.raw_name):
            continue
        present.add(field.raw_name)
        checks.append(null_check(df, field.raw_name))
        checks += rule_checks(df, field, nulls_allowed)
    checks += table_checks(df, spec)
    parts = [run_checks(df, checks, by), *unique_rows(df, spec, by, present)]
    return reduce(DataFrame.unionByName, parts)


def column_levels(report: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The worst severity of every column."""
    levels = report.where(F.col("column").isNotNull())
    return levels.groupBy(*[ref(c) for c in by], "column").agg(F.max("severity").alias("column_level"))


def table_level(report: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The worst severity of the whole table: 0 fine, 1 with warnings, 2 rejected."""
    return report.groupBy(*[ref(c) for c in by]).agg(F.max("severity").alias("validated"))


def findings(report: DataFrame) -> DataFrame:
    """The constraint results alone; counts are null where nothing failed."""
    failed = F.col("status") == "Fail"
    rows = report.where(F.col("constraint").isNotNull())
    return rows.withColumn("failed", F.when(failed, F.col("failed"))).withColumn(
        "percent", F.when(failed, F.col("percent")))


def column_summary(report: DataFrame, spec: TableSpec, by: Sequence[str] = ()) -> DataFrame:
    """Per column: worst severity, types by the document, percentage of nulls, number of failed constraints."""
    def of(check: str, c: Column) -> Column:
        return F.max(F.when(F.col("check") == check, c))

    rows = report.where(F.col("column").isNotNull())
    summary = rows.groupBy(*[ref(c) for c in by], "column").agg(
        F.max("severity").alias("column_level"),
        of("nulls", F.col("percent")).alias("null_percent"),
        F.count_if((F.col("check") == "constraint") & (F.col("status") == "Fail")).alias("failed_constraints"),
    )
    types = F.create_map(*[F.lit(x) for f in spec.fields for x in (f.raw_name, f.pq_type)])
    logical = F.create_map(*[F.lit(x) for f in spec.fields for x in (f.raw_name, f.logical_type)])
    return summary.withColumn("pq_type", F.try_element_at(types, F.col("column"))).withColumn(
        "logical_type", F.try_element_at(logical, F.col("column")))


def _error_tests(df: DataFrame, spec: TableSpec, nulls_allowed: bool) -> list[Column]:
    tests = []
    for field in spec.fields:
        for rule in field.rules:
            for level, value in rule.levels():
                if level == "error" and rule.name != "unique":
                    c, dtype, is_list = leaf(df.schema, field.raw_name)
                    tests.append(leaf_predicate(rule.name, c, dtype, is_list, value, nulls_allowed))
    for rule in spec.table_rules:
        for level, value in rule.levels():
            if level == "error" and rule.name == "expression":
                tests.append(F.expr(str(value)))
    return tests


def mark_rows(df: DataFrame, spec: TableSpec, name: str = "accepted", nulls_allowed: bool = False) -> DataFrame:
    """Add whether a row passes every row-level constraint at error level; one scan serves both sides of a split."""
    tests = _error_tests(df, spec, nulls_allowed)
    return df.withColumn(name, reduce(lambda a, b: a & b, [F.coalesce(test, F.lit(True)) for test in tests], F.lit(True)))


def split_rows(df: DataFrame, spec: TableSpec, nulls_allowed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rows by the row-level constraints at error level: a narrow filter, no shuffle."""
    marked = mark_rows(df, spec, "_accepted", nulls_allowed)
    return marked.where("_accepted").drop("_accepted"), marked.where("NOT _accepted").drop("_accepted")
