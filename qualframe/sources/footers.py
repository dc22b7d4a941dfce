"""Parquet footers as a table: what the files say about themselves, without reading their data.

Tasks read the footers; files may have any number of row groups. A footer is kilobytes, so a million files cost a
few gigabytes of reads spread over the cluster.
"""

from __future__ import annotations

import json
import sys
from typing import Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qualframe.sources.files import list_files, spread_files
from qualframe.sources.metadata import SECTION_KEY
from qualframe.sources.remote import open_file

ROW_DDL = (
    "path string, row_group int, position int, column string, physical string, logical string, rows bigint, "
    "has_stats boolean, nulls bigint, min_long bigint, max_long bigint, min_double double, max_double double, "
    "min_text string, max_text string, bytes bigint, arrow string"
)
META_DDL = "path string, position int, column string, section string, json string"


def _slots(value) -> tuple[int | None, float | None, str | None]:
    """A statistic in the slot of its type; time in microseconds, dates in days."""
    import datetime as dt
    import decimal

    if value is None:
        return None, None, None
    if isinstance(value, bool):
        return int(value), None, None
    if isinstance(value, int):
        return value, None, None
    if isinstance(value, float):
        return None, value + 0.0, None  # writers store a least value of zero as -0.0
    if isinstance(value, dt.datetime):
        whole = value.replace(tzinfo=value.tzinfo or dt.timezone.utc) - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
        return whole // dt.timedelta(microseconds=1), None, None
    if isinstance(value, dt.date):
        return (value - dt.date(1970, 1, 1)).days, None, None
    if isinstance(value, decimal.Decimal):
        return None, None, str(value)
    if isinstance(value, bytes):
        return None, None, value.hex()
    return None, None, str(value)


def _arrow_type(schema, path: str) -> str | None:
    """The Arrow type of a leaf; members of lists and maps by their place, whatever their names in the file are."""
    first, *rest = path.split(".")
    if schema.get_field_index(path) >= 0:
        return str(schema.field(path).type)
    if schema.get_field_index(first) < 0:
        return None
    kind = schema.field(first).type
    while rest:
        step = rest.pop(0)
        if hasattr(kind, "value_type") and not hasattr(kind, "key_type"):
            kind, rest = kind.value_type, rest[1:] if rest else rest
        elif hasattr(kind, "key_type"):
            if rest:
                kind, rest = (kind.key_type if rest[0] == "key" else kind.item_type), rest[1:]
        elif hasattr(kind, "get_field_index") and kind.get_field_index(step) >= 0:
            kind = kind.field(step).type
    return str(kind)


def _footer_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import pyarrow.parquet as pq

    names = [part.split(" ")[0] for part in ROW_DDL.split(", ")]
    for batch in batches:
        for path in batch["path"]:
            with open_file(path) as source:
                file = pq.ParquetFile(source)
                footer, schema = file.metadata, file.schema_arrow
            rows = []
            for group in range(footer.num_row_groups):
                part = footer.row_group(group)
                for position in range(part.num_columns):
                    column = part.column(position)
                    stats = column.statistics if column.is_stats_set else None
                    ranged = stats is not None and stats.has_min_max
                    low, high = _slots(stats.min if ranged else None), _slots(stats.max if ranged else None)
                    nulls = stats.null_count if stats is not None and stats.has_null_count else None
                    rows.append((
                        path, group, position, column.path_in_schema, column.physical_type.lower(),
                        footer.schema.column(position).logical_type.type.lower(), part.num_rows, ranged, nulls,
                        low[0], high[0], low[1], high[1], low[2], high[2], column.total_compressed_size,
                        _arrow_type(schema, column.path_in_schema),
                    ))
            frame = pd.DataFrame(rows, columns=names)
            for name in ("nulls", "min_long", "max_long"):
                frame[name] = pd.array([row[names.index(name)] for row in rows], dtype="Int64")
            yield frame


def footer_rows(spark: SparkSession, path: str | list[str], pattern: str = "*.parquet") -> DataFrame:
    """One row per file, row group and leaf column."""
    return footers_of(list_files(spark, path, pattern).select("path"))


def footers_of(files: DataFrame) -> DataFrame:
    """The same for the files of a frame with ``path``."""
    return spread_files(files).mapInPandas(_footer_rows, ROW_DDL)


def footer_profile(rows: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Per column over all files: types, rows, row groups, nulls, least and greatest value.

    ``types`` counts the distinct type pairs (more than one means the files disagree); ``complete`` says
    whether every row group states its range or holds nulls only. ``nulls`` is null unless every row group states them.
    """
    if columns is not None:
        rows = rows.where(F.col("column").isin(list(columns)))
    return rows.groupBy(*by, "column").agg(
        F.min("position").alias("position"), F.min("physical").alias("physical"), F.min("logical").alias("logical"),
        F.count_distinct("physical", "logical").alias("types"),
        F.sum("rows").alias("rows"), F.count("*").alias("row_groups"), F.when(F.bool_and(F.col("nulls").isNotNull()), F.sum("nulls")).alias("nulls"),
        F.bool_and(F.col("has_stats") | F.coalesce(F.col("nulls") == F.col("rows"), F.lit(False))).alias("complete"),
        F.min("arrow").alias("arrow_type"),
        F.min("min_long").alias("min_long"), F.max("max_long").alias("max_long"),
        F.min("min_double").alias("min_double"), F.max("max_double").alias("max_double"),
        F.min("min_text").alias("min_text"), F.max("max_text").alias("max_text"),
    )


def _text(logical: Column, whole: Column, fraction: Column, text: Column) -> Column:
    stamp = F.date_format(F.timestamp_micros(whole), "yyyy-MM-dd'T'HH:mm:ss")
    day = F.date_add(F.lit("1970-01-01").cast("date"), whole.cast("int")).cast("string")
    return (F.when(logical == "timestamp", stamp).when(logical == "date", day)
            .otherwise(F.coalesce(whole.cast("string"), fraction.cast("string"), text)))


def with_bounds(profile: DataFrame) -> DataFrame:
    """Add ``min`` and ``max`` as text, in the form constraint values have."""
    side = lambda s: _text(F.col("logical"), F.col(f"{s}_long"), F.col(f"{s}_double"), F.col(f"{s}_text"))
    return profile.withColumn("min", side("min")).withColumn("max", side("max"))


def physical_types(profile: DataFrame) -> dict[str, tuple[str, str]]:
    """Exact types per column for the type check: as many rows as the table has columns."""
    return {row["column"]: (row.physical, row.logical) for row in profile.select("column", "physical", "logical").collect()}


def _metadata_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import pyarrow.parquet as pq

    for batch in batches:
        for path in batch["path"]:
            with open_file(path) as source:
                schema = pq.ParquetFile(source).schema_arrow
            table = schema.metadata or {}
            spark_fields = json.loads(table.get(b"org.apache.spark.sql.parquet.row.metadata", b"{}")).get("fields", [])
            found = {f["name"]: f["metadata"].get(SECTION_KEY) for f in spark_fields if f.get("metadata")}
            rows = []
            for position, field in enumerate(schema):
                own = (field.metadata or {}).get(SECTION_KEY.encode())
                sections = json.loads(own) if own else found.get(field.name)
                for section, value in (sections or {}).items():
                    rows.append((path, position, field.name, section, json.dumps(value, sort_keys=True)))
            yield pd.DataFrame(rows, columns=[part.split(" ")[0] for part in META_DDL.split(", ")])


def harvest_metadata(spark: SparkSession, path: str | list[str], pattern: str = "*.parquet") -> DataFrame:
    """Column metadata kept in footers, one row per file, column and section; columns without any give none."""
    return spread_files(list_files(spark, path, pattern).select("path")).mapInPandas(_metadata_rows, META_DDL)


def harvested_documents(harvest: DataFrame) -> DataFrame:
    """One row per file: its columns with metadata, in file order, as a JSON list of fields."""
    fields = harvest.groupBy("path", "position", "column").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("section", "json")))).alias("sections"))
    listed = fields.groupBy("path").agg(F.array_sort(
        F.collect_list(F.struct("position", "column", "sections")), lambda a, b: a["position"] - b["position"]).alias("fields"))
    return listed.select("path", F.size("fields").cast("bigint").alias("columns"), F.to_json("fields").alias("fields"))


# Tasks get the functions above with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
