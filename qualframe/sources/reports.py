"""Validation reports: appended to one table, read back as a history."""

from __future__ import annotations

import hashlib
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Folder of one attempt.
BATCH = "batch"
STAMPS = ("ingestion", "uid", "ingest_time", "accepted")


def append_report(report: DataFrame, path: str) -> None:
    """A report has a few rows per delivery, so deliveries share files instead of having a folder each."""
    report.write.mode("append").parquet(path)


def batch_of(token: str) -> str:
    """The name of the folders of one attempt."""
    return hashlib.sha256(token.encode()).hexdigest()


def write_report(report: DataFrame, path: str, token: str) -> DataFrame:
    """The report of one attempt, in a folder of its own: written again, it takes the place of what is there. Returns what was written."""
    folder = f"{path}/{BATCH}={batch_of(token)}"
    report.write.mode("overwrite").parquet(folder)
    return report.sparkSession.read.schema(report.schema).parquet(folder)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BATCH)


def report_json(report: DataFrame, by: Sequence[str] = ("ingestion",)) -> DataFrame:
    """One JSON text per group: the worst severity and the checks of every column.

    A report has as many rows as there are checks, which the documents bound, not the data.
    """
    checks = F.struct("check", "constraint", "level", "value", "severity", "status", "evaluated", "failed", "percent")
    columns = report.groupBy(*by, "column").agg(
        F.max("severity").alias("column_level"), F.sort_array(F.collect_list(checks)).alias("checks"))
    rows = F.struct("column", "column_level", "checks")
    tables = columns.groupBy(*by).agg(F.max("column_level").alias("validated"), F.sort_array(F.collect_list(rows)).alias("columns"))
    return tables.select(*by, "validated", F.to_json(F.struct(*by, "validated", "columns")).alias("json"))


def write_report_json(report: DataFrame, path: str, by: Sequence[str] = ("ingestion",)) -> None:
    report_json(report, by).select(*by, F.col("json").alias("value")).write.mode("overwrite").partitionBy(*by).text(path)


def latest(rows: DataFrame, key: str = "ingestion", time: str = "ingest_time", tie: str = "uid") -> DataFrame:
    """The newest row per key; an aggregate, so a key with very many rows is reduced before the shuffle."""
    newest = F.max_by(F.struct(*rows.columns), F.struct(time, tie)).alias("r")
    return rows.groupBy(F.col(key).alias("_key")).agg(newest).select("r.*")
