"""Named queries over the given tables, each with the SQL another engine can check it by."""

from __future__ import annotations

from typing import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from qualframe.document import TableSpec, FieldSpec
from qualframe.session import configure
from qualframe.types import leaf_types, parquet_type

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(configure(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql.strip()
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spec_of(df: DataFrame, name: str, leave_out: Sequence[str] = ()) -> TableSpec:
    """A specification that states the types a frame has."""
    fields = [FieldSpec(path, *parquet_type(dtype)) for path, dtype in leaf_types(df.schema).items() if path not in leave_out]
    return TableSpec(name, tuple(fields))


def text(value: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if value is None else "'" + value.replace("'", "''") + "'"


def check_row(source: str, column: str | None, check: str, evaluated: str, failed: str, severity: int,
              constraint: str | None = None, level: str | None = None, value: str | None = None, by: str | None = None) -> str:
    group = f"{by} AS ingestion, " if by else ""
    return (
        f'SELECT {group}{text(column)} AS "column", {text(check)} AS "check", {text(constraint)} AS "constraint", '
        f'{text(level)} AS "level", {text(value)} AS "value", {severity} AS sev, '
        f"CAST({evaluated} AS BIGINT) AS evaluated, CAST({failed} AS BIGINT) AS failed FROM {source}"
        + (f" GROUP BY {by}" if by else "")
    )


def report_of(rows: Sequence[str], by: bool = False, columns: Sequence[str] = ()) -> str:
    """Severity, status and percentage on top of counted rows."""
    extra = ("ingestion, " if by else "") + "".join(f'"{c}", ' for c in columns)
    return (
        f'SELECT {extra}"column", "check", "constraint", "level", "value", '
        "CAST(CASE WHEN failed > 0 THEN sev ELSE 0 END AS INTEGER) AS severity, "
        "CASE WHEN failed > 0 THEN 'Fail' ELSE 'Pass' END AS status, evaluated, failed, "
        "CASE WHEN failed > 0 THEN CAST(failed AS DOUBLE) / CAST(evaluated AS DOUBLE) * 100.0 ELSE 0.0 END AS percent "
        "FROM (" + "\nUNION ALL ".join(rows) + ")"
    )


Rule = tuple[str, str, str, str, str, str]
_SEVERITY = {"warning": 1, "error": 2}


def rule_row(source: str, column: str | None, constraint: str, level: str, value: str, fails: str,
             evaluated: str | None = None, by: str | None = None, check: str = "constraint") -> str:
    """``fails`` is the condition of a failed row; a null column is not evaluated unless ``evaluated`` says so."""
    counted = evaluated or f"count({column})"
    return check_row(source, column, check, counted, f"count(*) FILTER (WHERE {fails})", _SEVERITY[level],
                     constraint, level, value, by)


def base_rows(source: str, columns: Sequence[str], names: Mapping[str, tuple[int, str | None]] | None = None,
              types: Mapping[str, Sequence[tuple[str, str]]] | None = None, by: str | None = None,
              nulls: Mapping[str, str] | None = None) -> list[str]:
    """What every report says besides constraints: rows, names, types and nulls.

    ``types`` holds mismatches only; ``nulls`` holds another expression for columns the source calls differently.
    """
    rows = [check_row(source, None, "rows", "count(*)", "0", 0, by=by)]
    for label, (severity, value) in (names or {"columns_validated": (0, None)}).items():
        rows.append(check_row(source, None, label, "1" if not by else "max(1)", str(int(severity > 0)), severity, value=value, by=by)
                    if by else _single(None, label, severity, value))
    for column in columns:
        found = (types or {}).get(column) or [("types_validated", None)]
        for check, value in found:
            severity = 0 if check == "types_validated" else 2
            rows.append(check_row(source, column, check, "max(1)", str(int(severity > 0)), severity, value=value, by=by)
                        if by else _single(column, check, severity, value))
        rows.append(check_row(source, column, "nulls", "count(*)", f"count(*) FILTER (WHERE {(nulls or {}).get(column, column)} IS NULL)", 1, by=by))
    return rows


def _single(column: str | None, check: str, severity: int, value: str | None) -> str:
    return check_row("(SELECT 1)", column, check, "1", str(int(severity > 0)), severity, value=value)
