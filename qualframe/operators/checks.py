"""Many checks, one scan: compile checks to aggregates and stack the results to one row per check.

Every check is a pair of counts. All pairs of a batch sit in one ``agg``: one file scan, one exchange
of one row per task (or per task and group), whatever the size of the data.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualframe.document import LEVELS, DocumentError, FieldSpec, TableSpec
from qualframe.functions.columns import leaf, ref
from qualframe.functions.predicates import leaf_predicate

# More checks than this in one aggregate make its generated code too long to be compiled, so a long list is cut.
# Checks come in order of columns: a batch reads its own columns only, and all batches together read each about once.
BATCH = 50

REPORT_COLUMNS = ("column", "check", "constraint", "level", "value", "severity", "status", "evaluated", "failed", "percent")


@dataclass(frozen=True)
class Check:
    """What to count and how to label the counts.

    ``evaluated`` and ``failed`` are aggregate expressions, or numbers known beforehand; ``fail_severity`` is what
    one failure means.
    """

    column: str | None
    check: str
    evaluated: Column | int
    failed: Column | int
    fail_severity: int
    constraint: str | None = None
    level: str | None = None
    value: str | None = None


def _text(value: Any) -> str:
    return ",".join(map(str, value)) if isinstance(value, (list, tuple)) else str(value)


def stated_check(column: str | None, check: str, severity: int, value: str | None = None) -> Check:
    """A result known from the schema alone; it rides along with the counted ones, once per group."""
    return Check(column, check, 1, 1 if severity else 0, severity, value=value)


def null_check(df: DataFrame, column: str) -> Check:
    """Nulls from two counts the other checks need anyway; a list with a null in it counts as null."""
    c, _, is_list = leaf(df.schema, column)
    whole = F.when(~F.exists(c, lambda x: x.isNull()), F.lit(1)) if is_list else c
    return Check(column, "nulls", F.count(F.lit(1)), F.count(F.lit(1)) - F.count(whole), 1)


def rule_checks(df: DataFrame, spec: FieldSpec, nulls_allowed: bool = False) -> list[Check]:
    """One check per enabled constraint and non-blank level of a field (``unique`` excluded: it needs a shuffle)."""
    c, dtype, is_list = leaf(df.schema, spec.raw_name)
    checks = []
    for rule in spec.rules:
        for level, value in rule.levels():
            if level not in LEVELS:
                raise DocumentError(f"{spec.raw_name}: unknown level {level!r}")
            if rule.name == "unique":
                continue
            try:
                passes = leaf_predicate(rule.name, c, dtype, is_list, value, nulls_allowed)
            except DocumentError as error:
                raise DocumentError(f"{spec.raw_name}: {rule.name} ({level}): {error}") from error
            # Only allowed_values judges nulls; for the others the non-null count of a column is shared.
            judges_nulls = rule.name == "allowed_values" and not nulls_allowed and not is_list
            evaluated = F.count(F.lit(1)) if judges_nulls else F.count(c)
            checks.append(Check(spec.raw_name, "constraint", evaluated, F.count_if(~passes), LEVELS[level],
                                rule.name, level, _text(value)))
    return checks


def table_checks(df: DataFrame, spec: TableSpec) -> list[Check]:
    """Row-level SQL expressions and row counts stated for the whole table (``unique`` excluded)."""
    checks = []
    for rule in spec.table_rules:
        for level, value in rule.levels():
            severity = LEVELS[level]
            rows = F.count(F.lit(1))
            if rule.name == "expression":
                test = F.expr(str(value))
                counts = (F.count(test), F.count_if(~test))
            elif rule.name == "min_rows":
                counts = (rows, F.greatest(F.lit(int(value)).cast("bigint") - rows, F.lit(0).cast("bigint")))
            elif rule.name == "max_rows":
                counts = (rows, F.greatest(rows - F.lit(int(value)).cast("bigint"), F.lit(0).cast("bigint")))
            elif rule.name == "unique":
                continue
            else:
                raise DocumentError(f"unknown table constraint {rule.name!r}")
            checks.append(Check(None, "table_constraint", *counts, severity, rule.name, level, _text(value)))
    return checks


def sql_text(value: str | None) -> str:
    """A text as a SQL literal."""
    if value is None:
        return "CAST(NULL AS STRING)"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def result_columns(evaluated: Column, failed: Column, fail_severity: Column) -> list[Column]:
    """Severity, status and percentage from a pair of counts."""
    bad = failed > 0
    percent = F.when(bad, failed.cast("double") / F.greatest(evaluated, F.lit(1)).cast("double") * F.lit(100.0))
    return [
        F.when(bad, fail_severity).otherwise(F.lit(0)).cast("int").alias("severity"),
        F.when(bad, F.lit("Fail")).otherwise(F.lit("Pass")).alias("status"),
        evaluated.alias("evaluated"),
        failed.alias("failed"),
        F.coalesce(percent, F.lit(0.0)).alias("percent"),
    ]


def _counted(df: DataFrame, checks: Sequence[Check], by: Sequence[str] = ()) -> tuple[DataFrame, list[tuple[str, str]]]:
    """All counts of a batch in one wide row (per group), and the names of each check's pair of counts."""
    # Equal counts (rows, values of a column) appear several times here; Spark computes each one once.
    counts: list[Column] = []

    def counted(c: Column | int) -> str:
        if isinstance(c, int):
            return str(c)
        counts.append(c.alias(f"_n{len(counts)}"))
        return f"_n{len(counts) - 1}"

    names = [(counted(check.evaluated), counted(check.failed)) for check in checks]
    counts = counts or [F.count(F.lit(1)).alias("_n0")]
    return df.groupBy(*[ref(c) for c in by]).agg(*counts), names


def _run_batch(df: DataFrame, checks: Sequence[Check], by: Sequence[str]) -> DataFrame:
    wide, names = _counted(df, checks, by)
    # One text for the whole stack: building hundreds of literals one by one costs seconds on the driver.
    rows = ", ".join(
        f"named_struct('column', {sql_text(check.column)}, 'check', {sql_text(check.check)}, "
        f"'constraint', {sql_text(check.constraint)}, 'level', {sql_text(check.level)}, 'value', {sql_text(check.value)}, "
        f"'fail_severity', {check.fail_severity}, 'evaluated', CAST({evaluated} AS BIGINT), 'failed', CAST({failed} AS BIGINT))"
        for check, (evaluated, failed) in zip(checks, names)
    )
    long = wide.select(*[ref(c) for c in by], F.expr(f"inline(array({rows}))"))
    return long.select(
        *[ref(c) for c in by], "column", "check", "constraint", "level", "value",
        *result_columns(F.col("evaluated"), F.col("failed"), F.col("fail_severity")),
    )


def counts_of(df: DataFrame, checks: Mapping[int, Check], batch: int = BATCH) -> list[DataFrame]:
    """``number, evaluated, failed`` of numbered checks, to be added to counts from elsewhere."""
    numbers, frames = sorted(checks), []
    for i in range(0, len(numbers), batch):
        part = numbers[i:i + batch]
        wide, names = _counted(df, [checks[n] for n in part])
        rows = ", ".join(f"named_struct('number', {n}, 'evaluated', CAST({evaluated} AS BIGINT), 'failed', CAST({failed} AS BIGINT))"
                         for n, (evaluated, failed) in zip(part, names))
        frames.append(wide.select(F.expr(f"inline(array({rows}))")))
    return frames


def run_checks(df: DataFrame, checks: Sequence[Check], by: Sequence[str] = (), batch: int = BATCH) -> DataFrame:
    """Count all checks over the whole frame, or per group of ``by``; one row per check (and group)."""
    if not checks:
        raise DocumentError("nothing to check")
    if taken := sorted(set(by) & set(REPORT_COLUMNS)):
        raise DocumentError(f"a report has columns {taken} of its own: rename the grouping column")
    batches = [checks[i:i + batch] for i in range(0, len(checks), batch)]
    return reduce(DataFrame.unionByName, [_run_batch(df, part, by) for part in batches])

