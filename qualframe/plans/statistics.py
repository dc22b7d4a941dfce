"""Validate files: what footers prove is not counted again.

Footers hold row counts, null counts and the range of every column per row group. For every check they may show, file by file and row
group by row group, that no value fails or that all do. Only files with a column that is still open are read, and of those the open columns
only: files are grouped by what is open, each group is one scan, and its counts are added to those from the footers of the others.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce
from typing import Any, Mapping, NamedTuple, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qualframe.document import Document, DocumentError, TableSpec
from qualframe.functions.columns import has_column, leaf
from qualframe.functions.predicates import parsed_value
from qualframe.operators.checks import Check, counts_of, null_check, result_columns, rule_checks, run_checks, table_checks
from qualframe.operators.deliveries import name_rows
from qualframe.operators.relational import Links, validate_relational
from qualframe.operators.validate import name_checks, type_checks, unique_rows, validate
from qualframe.session import materialize
from qualframe.sources.footers import footer_profile, footer_rows
from qualframe.sources.remote import hadoop_path
from qualframe.types import is_time

# Scans at most; files with rarer sets of open columns share the last one. Open files that are listed at most.
SCANS, LISTED = 8, 10_000

_EPOCH = dt.datetime(1970, 1, 1)
# By constraint, when a range shows that every value passes, and when it shows that every value fails.
_ALL_PASS = {
    "greater": lambda low, high, v: low > v,
    "greater_equal": lambda low, high, v: low >= v,
    "less": lambda low, high, v: high < v,
    "less_equal": lambda low, high, v: high <= v,
    "not_equal": lambda low, high, v: (v < low) | (v > high),
}
_ALL_FAIL = {
    "greater": lambda low, high, v: high <= v,
    "greater_equal": lambda low, high, v: high < v,
    "less": lambda low, high, v: low >= v,
    "less_equal": lambda low, high, v: low > v,
}
_CHECKS_DDL = "number int, column string, kind string, constraint string, judges_nulls boolean, long_bound bigint, text_bound string"
_LABELS_DDL = "number int, column string, check string, constraint string, level string, value string, fail_severity int, known bigint, known_failed bigint"


def _comparable(value: Any, dtype: T.DataType) -> Any:
    """A constraint value in the form footers state ranges: whole numbers, microseconds, days, text."""
    parsed = parsed_value(value, dtype)
    if is_time(dtype):
        return (dt.datetime.fromisoformat(parsed) - _EPOCH) // dt.timedelta(microseconds=1)
    if isinstance(dtype, T.DateType):
        return (dt.date.fromisoformat(parsed) - _EPOCH.date()).days
    return parsed


def _provable(number: int, check: Check, df: DataFrame, types: int, nulls_allowed: bool) -> tuple:
    """What a footer has to show for a check. ``kind`` says by which range: ``long``, ``text``, or none but that of nulls.

    Fractions have no kind: ranges leave NaN out, and NaN fails every comparison. Lists are ``never`` proven.
    """
    _, dtype, is_list = leaf(df.schema, check.column)
    judges_nulls = check.constraint == "allowed_values" and not nulls_allowed
    kind, whole, text = "none", None, None
    if is_list or not types:  # no footer knows the column by this name
        kind = "never"
    elif check.check == "nulls":
        kind = "nulls"
    elif types == 1 and check.constraint in _ALL_PASS:
        if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType)) or is_time(dtype):
            kind, whole = "long", _comparable(check.value, dtype)
        elif isinstance(dtype, T.StringType):
            kind, text = "text", _comparable(check.value, dtype)
    return number, check.column, kind, check.constraint, judges_nulls, whole, text


def file_proofs(footers: DataFrame, checks: Sequence[tuple]) -> DataFrame:
    """Per file, row group and check: whether the footer settles it, and the counts it then states.

    ``checks`` are rows of ``_CHECKS_DDL``, as many as the document states. Row groups of a file without the column hold nulls.
    """
    stated = footers.sparkSession.createDataFrame(checks, _CHECKS_DDL)
    wanted = F.array(*[F.lit(c) for c in sorted({row[1] for row in checks})])
    groups = footers.groupBy("path", "row_group").agg(F.max("rows").alias("rows"), F.collect_set("column").alias("have"))
    absent = groups.select("path", "row_group", "rows", F.explode(F.array_except(wanted, "have")).alias("column"))
    ranges = ["min_long", "max_long", "min_text", "max_text"]
    known = footers.select("path", "row_group", "column", "rows", "nulls", "has_stats", *ranges).unionByName(
        absent.select("path", "row_group", "column", "rows", F.col("rows").alias("nulls"), F.lit(False).alias("has_stats")), allowMissingColumns=True)
    each = known.join(F.broadcast(stated), "column")

    def shown(tests: Mapping) -> Column:
        found = [F.when((F.col("kind") == slot) & (F.col("constraint") == name), test(F.col(f"min_{slot}"), F.col(f"max_{slot}"), F.col(f"{slot}_bound")))
                 for slot in ("long", "text") for name, test in tests.items()]
        return F.col("has_stats") & F.coalesce(*found, F.lit(False))

    rows, nulls, none = F.col("rows"), F.col("nulls"), F.lit(0).cast("bigint")
    empty, judged = nulls == rows, F.col("judges_nulls")
    passes, fails = shown(_ALL_PASS), shown(_ALL_FAIL)
    pair = lambda evaluated, failed: F.struct(evaluated.alias("evaluated"), failed.alias("failed"))
    counts = F.when(F.col("kind") == "nulls", pair(rows, nulls)).when(empty & judged, pair(rows, rows)).when(empty, pair(none, none)).when(
        passes, pair(rows - nulls, none)).when(fails, pair(rows - nulls, rows - nulls))
    counts = F.when(F.col("kind") != "never", counts)
    settled = nulls.isNotNull() & counts.isNotNull()
    return each.select("path", "row_group", "number", "column", settled.alias("settled"), F.when(settled, counts["evaluated"]).alias("evaluated"),
                       F.when(settled, counts["failed"]).alias("failed"))


class Scan(NamedTuple):
    """One scan: the columns it counts, and its files (none: all files of the table)."""

    columns: tuple[str, ...]
    paths: tuple[str, ...] | None


def scans_of(per_file: DataFrame, files: int) -> tuple[list[Scan], Column]:
    """Files with open columns, grouped by them, and the columns that are scanned in a file, given its ``open`` columns.

    Beyond ``LISTED`` open files no file is listed any more: the columns that are open anywhere are scanned in all of them.
    """
    opened = open_files(per_file)
    literal = lambda names: F.array(*[F.lit(n) for n in names]).cast("array<string>")
    rows = opened.limit(LISTED + 1).collect()
    if len(rows) > LISTED:
        columns = tuple(sorted(row.c for row in opened.select(F.explode("open").alias("c")).distinct().collect()))  # columns of the table
        return [Scan(columns, None)], literal(columns)
    # Paths of files that are read; Spark's own file index holds them on the driver as well.
    groups: dict[tuple[str, ...], list[str]] = {}
    for row in rows:
        groups.setdefault(tuple(row.open), []).append(row.path)
    ordered = sorted(groups, key=lambda columns: (-len(groups[columns]), columns))
    common, rare = ordered[:SCANS - 1], ordered[SCANS - 1:]
    scans = {columns: groups[columns] for columns in common}
    rest = tuple(sorted({c for columns in rare for c in columns}))
    if rare:
        scans[rest] = [*scans.get(rest, []), *[path for columns in rare for path in groups[columns]]]
    scanned = F.when(F.col("open").isNull(), literal(()))
    for columns in common:
        scanned = scanned.when(F.col("open") == literal(columns), literal(columns))
    return ([Scan(columns, None if len(paths) == files else tuple(sorted(paths))) for columns, paths in scans.items()], scanned.otherwise(literal(rest)))


def open_files(per_file: DataFrame) -> DataFrame:
    """``path, open``: the columns of each file that its footer does not settle; files without any are left out."""
    columns = per_file.groupBy("path", "column").agg(F.bool_and("settled").alias("settled")).where("NOT settled")
    return columns.groupBy("path").agg(F.sort_array(F.collect_list("column")).alias("open"))  # no more than the document has columns


def file_statistics(footers: DataFrame) -> tuple[dict[str, Row], int, int]:
    """One row per column, as many as the table is wide; the rows of all files, and their number."""
    groups = footers.groupBy("path", "row_group").agg(F.max("rows").alias("n"))
    whole = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_distinct("path").alias("files")).first()
    return {row["column"]: row for row in footer_profile(footers).collect()}, whole.n, whole.files


def _columns_of_all(spark: SparkSession, path: str, stats: Mapping[str, Row]) -> DataFrame:
    """The table with the columns of all its files; with those of one file where they disagree about a type."""
    agree = all(row.types == 1 for row in stats.values())
    return spark.read.option("mergeSchema", agree).parquet(path)


def _proofs(spark: SparkSession, footers: DataFrame, df: DataFrame, stats: Mapping[str, Row], spec: TableSpec,
            nulls_allowed: bool) -> tuple[dict[int, Check], DataFrame]:
    """The numbered checks of the columns, and what the footers of each file say about them."""
    found: list[Check] = []
    for field in spec.fields:
        if has_column(df.schema, field.raw_name):
            found += [null_check(df, field.raw_name), *rule_checks(df, field, nulls_allowed)]
    checks = dict(enumerate(found))
    types = lambda column: stats[column].types if column in stats else 0
    provable = [_provable(n, c, df, types(c.column), nulls_allowed) for n, c in checks.items()]
    per_file = file_proofs(footers, provable).groupBy("path", "column", "number").agg(
        F.bool_and("settled").alias("settled"), F.sum("evaluated").alias("evaluated"), F.sum("failed").alias("failed"))
    return checks, materialize(per_file)


def _files(spark: SparkSession, df: DataFrame, path: str, paths: Sequence[str] | None) -> DataFrame:
    """Some files of a table as the table's own columns; folders named by values stay columns."""
    if paths is None:
        return df
    return spark.read.schema(df.schema).option("basePath", path).parquet(*[hadoop_path(p) for p in paths])


def validate_files(spark: SparkSession, path: str, spec: TableSpec, nulls_allowed: bool = False) -> DataFrame:
    """The same report as ``validate`` gives for the table at ``path``, with exact file types and as little reading as possible.

    Names are checked file by file: a column that some of the files lack is missing.
    """
    footers = materialize(footer_rows(spark, path))
    stats, total, files = file_statistics(footers)
    df = _columns_of_all(spark, path, stats)
    checks, per_file = _proofs(spark, footers, df, stats, spec, nulls_allowed)
    scans, scanned = scans_of(per_file, files)
    # Every file and column is counted once: by its footer, or by the scan that reads it.
    by_file = per_file.join(open_files(per_file), "path", "left").where(~F.array_contains(scanned, F.col("column")))
    counts = [by_file.groupBy("number").agg(F.sum("evaluated").alias("evaluated"), F.sum("failed").alias("failed"))]
    for scan in scans:
        counts += counts_of(_files(spark, df, path, scan.paths), {n: c for n, c in checks.items() if c.column in scan.columns})

    # Files that disagree about a column's type have no type the document could state.
    physical = {c: ("mixed", "mixed") if row.types > 1 else (row.physical, row.logical) for c, row in stats.items()}
    stated = {len(checks) + i: c for i, c in enumerate([Check(None, "rows", total, 0, 0), *type_checks(df, spec, physical)])}
    whole = {len(checks) + len(stated) + i: c for i, c in enumerate(table_checks(df, spec))}
    for number, check in list(whole.items()):
        if check.constraint in ("min_rows", "max_rows"):  # the number of rows is known
            over = int(check.value) - total if check.constraint == "min_rows" else total - int(check.value)
            stated[number] = Check(None, check.check, total, max(over, 0), check.fail_severity, check.constraint, check.level, check.value)
            del whole[number]
    counts += counts_of(df, whole) if whole else []
    labels = spark.createDataFrame([(n, c.column, c.check, c.constraint, c.level, c.value, c.fail_severity, *(
        (c.evaluated, c.failed) if n in stated else (0, 0))) for n, c in sorted({**checks, **stated, **whole}.items())], _LABELS_DDL)
    summed = reduce(DataFrame.unionByName, counts).groupBy("number").agg(F.sum("evaluated").alias("evaluated"), F.sum("failed").alias("failed"))
    filled = lambda counted, known: F.coalesce(F.col(counted), F.col(known))
    parts = [labels.join(summed, "number", "left").select("column", "check", "constraint", "level", "value", *result_columns(
        filled("evaluated", "known"), filled("failed", "known_failed"), F.col("fail_severity")))]
    named = name_rows(footers.withColumn("files", F.lit("")), spec, "files").drop("files")
    parts.append(named if stats else run_checks(spark.range(1), name_checks(df.columns, spec)))  # files without rows have no footers to compare
    parts += unique_rows(df, spec, (), {check.column for check in checks.values()})
    return reduce(DataFrame.unionByName, parts)


def validate_document(document: Document, data: DataFrame | Mapping[str, DataFrame],
                      links: Links | None = None) -> DataFrame:
    """Validate by the kind of dataset: one frame for ``Tabular``, one per table for ``Relational``."""
    if document.datatype == "Relational":
        if isinstance(data, DataFrame):
            raise DocumentError("a relational dataset needs a frame per table")
        return validate_relational(data, document, links)
    if not isinstance(data, DataFrame):
        raise DocumentError("a tabular dataset is one frame")
    return validate(data, document.table)


def open_columns(spark: SparkSession, path: str, spec: TableSpec) -> list[str]:
    """Columns ``validate_files`` still has to read in some of the files, without starting it."""
    footers = materialize(footer_rows(spark, path))
    stats, _, files = file_statistics(footers)
    df = _columns_of_all(spark, path, stats)
    _, per_file = _proofs(spark, footers, df, stats, spec, False)
    read = {column for scan in scans_of(per_file, files)[0] for column in scan.columns}
    return [field.raw_name for field in spec.fields if field.raw_name in read]
