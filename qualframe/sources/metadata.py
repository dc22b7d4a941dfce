"""Metadata of single columns, kept by section in the schema; it travels with Parquet files."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

SECTION_KEY = "qualframe"


def set_column_metadata(df: DataFrame, column: str, section: str, value: dict | list, key: str = SECTION_KEY) -> DataFrame:
    """Merge a dict into a section of a column, or replace the section by a list; other sections and keys stay."""
    metadata = dict(df.schema[column].metadata or {})
    sections = dict(metadata.get(key) or {})
    old = sections.get(section)
    merged = {**old, **value} if isinstance(value, dict) and isinstance(old, dict) else value
    sections[section] = merged
    return df.withMetadata(column, {**metadata, key: sections})


def read_column_metadata(df: DataFrame, column: str, section: str | None = None, key: str = SECTION_KEY) -> Any:
    """All sections of a column, or one of them; ``{}`` where there is none."""
    sections = (df.schema[column].metadata or {}).get(key) or {}
    return sections if section is None else sections.get(section, {})


def keep_metadata(df: DataFrame, source: DataFrame) -> DataFrame:
    """Give computed columns back the metadata their namesakes had, which expressions lose."""
    for field in source.schema.fields:
        if field.name in df.columns and field.metadata and not df.schema[field.name].metadata:
            df = df.withMetadata(field.name, field.metadata)
    return df
