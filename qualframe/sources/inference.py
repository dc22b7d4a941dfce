"""A first schema document from what a table already says about itself."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qualframe.document import Document, FieldSpec, Rule, TableSpec
from qualframe.functions.columns import as_number, leaf, quoted, resolve, usable
from qualframe.functions.predicates import APPLICABLE
from qualframe.functions.uid import encode_uid, key_hash, largest
from qualframe.sources.footers import footer_profile, footer_rows, with_bounds
from qualframe.types import NUMERIC_PHYSICAL, is_time, leaf_types, parquet_type


def minimal_fields(profile: DataFrame, dataset: str, algorithm: str = "xxhash64") -> DataFrame:
    """One row per column: identifier, names, types, status and flags of a field nobody has edited yet."""
    number = key_hash(F.lit(dataset), F.col("column"), algorithm=algorithm) % F.lit(largest() + 1)
    return profile.select(
        "position", encode_uid(number).alias("uid"), F.col("column").alias("raw_name"),
        F.col("column").alias("display_name"), F.col("physical").alias("pq_type"), F.col("logical").alias("logical_type"),
        F.lit("raw").alias("status"), F.lit(True).alias("is_raw"),
        F.col("physical").isin(*NUMERIC_PHYSICAL).alias("is_numeric"),
    )


def default_constraints(profile: DataFrame) -> DataFrame:
    """Two disabled constraints per numeric column: at least the least and at most the greatest value seen."""
    rule = lambda name, value: F.struct(
        F.lit(name).alias("constraint"), F.lit("warning").alias("level"), value.alias("value"), F.lit(False).alias("enabled"))
    rules = F.array(rule("greater_equal", F.col("min")), rule("less_equal", F.col("max")))
    numeric = profile.where(F.col("physical").isin(*NUMERIC_PHYSICAL))
    return numeric.select("column", F.explode(rules).alias("r")).select("column", "r.*")


def data_bounds(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The profile a footer would give, from one aggregate over the data: for files without statistics."""
    leaves = leaf_types(df.schema)
    names = [c for c in (columns or leaves) if c in leaves]
    aggregates, rows = [F.count(F.lit(1)).alias("rows")], []
    for i, name in enumerate(names):
        c, dtype, is_list = leaf(df.schema, name)
        physical, logical = parquet_type(dtype)
        if is_list:  # a footer counts a null or empty list as one null, and every null in a list
            values = F.filter(c, lambda x: usable(x, dtype).isNotNull())
            nulls = F.sum(F.when(c.isNull() | (F.size(c) == 0), F.lit(1)).otherwise(
                F.size(F.filter(c, lambda x: x.isNull()))).cast("bigint"))
            low, high = F.min(F.array_min(values)), F.max(F.array_max(values))
        else:
            nulls, low, high = F.count_if(c.isNull()), F.min(usable(c, dtype)), F.max(usable(c, dtype))
        aggregates += [nulls.alias(f"n{i}"), low.alias(f"lo{i}"), high.alias(f"hi{i}")]
        text = (lambda x: F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss")) if is_time(dtype) else (lambda x: x.cast("string"))
        rows.append(F.struct(
            F.lit(i).alias("position"), F.lit(name).alias("column"), F.lit(physical).alias("physical"),
            F.lit(logical).alias("logical"), F.col("rows"), F.col(f"n{i}").alias("nulls"),
            text(F.col(f"lo{i}")).alias("min"), text(F.col(f"hi{i}")).alias("max")))
    return df.agg(*aggregates).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def infer_table(profile: DataFrame, name: str) -> TableSpec:
    """Bring a profile (one row per column) into a table specification."""
    fields = {row.raw_name: row for row in minimal_fields(profile, name).orderBy("position").collect()}
    rules: dict[str, list[Rule]] = {}
    for row in default_constraints(profile).collect():
        if row.value is not None:
            rules.setdefault(row["column"], []).append(
                Rule(row.constraint, {row.level: row.value, "error": ""}, row.enabled))
    return TableSpec(name=name, status="raw", fields=tuple(
        FieldSpec(
            raw_name=row.raw_name, uid=row.uid, pq_type=row.pq_type, logical_type=row.logical_type, status=row.status,
            flags={"is_raw": row.is_raw, "is_numeric": row.is_numeric},
            rules=tuple(sorted(rules.get(row.raw_name, ()), key=lambda r: r.name)), names={"display_name": row.display_name},
            types={"arrow_type": row.pq_type, "representation": row.pq_type},
        )
        for row in fields.values()
    ))


def _uid(spark: SparkSession, text: str) -> str:
    number = key_hash(F.lit(text)) % F.lit(largest() + 1)
    return spark.range(1).select(encode_uid(number).alias("u")).first().u


def infer_document(spark: SparkSession, path: str, name: str, columns: Sequence[str] | None = None) -> Document:
    """A document from the footers of all files below a path; ranges of numbers that footers lack come from a scan of those columns."""
    profile = with_bounds(footer_profile(footer_rows(spark, path), columns))
    lacking = profile.where(~F.col("complete") & F.col("physical").isin(*NUMERIC_PHYSICAL)).select("column").collect()
    if lacking:  # as many as the table has columns
        names = [row["column"] for row in lacking]
        agree = profile.agg(F.max("types")).first()[0] == 1
        bounds = data_bounds(spark.read.option("mergeSchema", agree).parquet(path), names).select(
            "column", F.col("min").alias("_min"), F.col("max").alias("_max"))
        profile = profile.join(bounds, "column", "left").withColumns(
            {side: F.when(F.col("column").isin(names), F.col(f"_{side}")).otherwise(F.col(side)) for side in ("min", "max")})
    return Document(name=name, uid=_uid(spark, name), tables=(infer_table(profile, name),))


def infer_from_data(df: DataFrame, name: str, columns: Sequence[str] | None = None) -> Document:
    """A document of any frame."""
    return Document(name=name, uid=_uid(df.sparkSession, name), tables=(infer_table(data_bounds(df, columns), name),))


def applicable_constraints(names: Column) -> Column:
    """Constraint names that fit a field, given the array of its type names and set flags."""
    fits = [F.when(F.arrays_overlap(names, F.array(*[F.lit(t) for t in types])), F.lit(constraint))
            for constraint, types in APPLICABLE.items()]
    return F.array_compact(F.array(*fits))


def type_constraints(fields: DataFrame, types: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per field and constraint that can be put on it; ``types`` are columns of type and flag names."""
    names = F.array_compact(F.array(*[F.col(quoted(t)) for t in types]))
    return fields.select(*keep, F.explode(applicable_constraints(names)).alias("constraint"))


def value_range(df: DataFrame, column: str) -> DataFrame:
    """Least and greatest usable value as doubles."""
    c, dtype = resolve(df.schema, column)
    v = as_number(usable(c, dtype), dtype)
    return df.agg(F.min(v).alias("low"), F.max(v).alias("high"))
