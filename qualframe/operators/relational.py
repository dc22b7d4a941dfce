"""Several tables that refer to each other."""

from __future__ import annotations

from functools import reduce
from typing import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualframe.document import Document, DocumentError
from qualframe.functions.columns import ref
from qualframe.operators.checks import result_columns
from qualframe.operators.uniqueness import key_counts
from qualframe.operators.validate import validate

# (table, column or columns) -> (parent table, key column or columns)
Links = Mapping[tuple[str, str | Sequence[str]], tuple[str, str | Sequence[str]]]


def orphan_keys(child: DataFrame, columns: Sequence[str], parent: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of ``child`` that ``parent`` does not hold, with their number of rows.

    The child is counted per key before the join, so a key that fills a third of its rows is one row by
    then, and the join (which Spark may turn into a broadcast if the parent is small) sees distinct keys.
    """
    names = [f"_k{i}" for i in range(len(columns))]
    counted = child.groupBy(*[ref(c).alias(n) for c, n in zip(columns, names)]).agg(F.count("*").alias("rows"))
    counted = counted.where(reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names]))  # NaN is a key
    known = parent.select(*[ref(k).alias(n) for k, n in zip(keys, names)])
    orphans = counted.join(known, names, "left_anti")
    return orphans.select(*[F.col(n).alias(c) for n, c in zip(names, columns)], "rows")


def reference_check(child: DataFrame, columns: Sequence[str], parent: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows with a complete reference, rows whose reference leads nowhere, and how many keys that are."""
    names = [f"_k{i}" for i in range(len(columns))]
    counted = child.groupBy(*[ref(c).alias(n) for c, n in zip(columns, names)]).agg(F.count("*").alias("rows"))
    counted = counted.where(reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names]))  # NaN is a key
    known = parent.select(*[ref(k).alias(n) for k, n in zip(keys, names)]).distinct().withColumn("_known", F.lit(True))
    joined = counted.join(known, names, "left")
    orphan = F.col("_known").isNull()
    return joined.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("evaluated"),
        F.coalesce(F.sum(F.when(orphan, F.col("rows"))), F.lit(0)).alias("failed"),
        F.count_if(orphan).alias("orphan_keys"),
    )


def references_by_delivery(child: DataFrame, columns: Sequence[str], parents: DataFrame, arriving: DataFrame, keys: Sequence[str],
                           by: str = "ingestion") -> DataFrame:
    """Per delivery of ``child``: rows with a complete reference, and rows whose reference leads nowhere.

    A reference may lead to ``parents``, which are there for every delivery, or to ``arriving`` ones of the same delivery (a frame with ``by``).
    The child is counted per delivery and key first, so a key that fills a third of its rows is one row when it is joined.
    """
    names = [f"_k{i}" for i in range(len(columns))]
    counted = child.groupBy(by, *[ref(c).alias(n) for c, n in zip(columns, names)]).agg(F.count("*").alias("rows"))
    counted = counted.where(reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names]))
    renamed = [ref(k).alias(n) for k, n in zip(keys, names)]
    own = arriving.select(by, *renamed).distinct().withColumn("_own", F.lit(True))
    known = parents.select(*renamed).distinct().withColumn("_known", F.lit(True))
    joined = counted.join(own, [by, *names], "left").join(known, names, "left")
    orphan = F.col("_own").isNull() & F.col("_known").isNull()
    return joined.groupBy(by).agg(F.sum("rows").alias("evaluated"), F.coalesce(F.sum(F.when(orphan, F.col("rows"))), F.lit(0)).alias("failed"))


def names_of(columns: str | Sequence[str]) -> tuple[str, ...]:
    """One column or several, as a tuple."""
    return (columns,) if isinstance(columns, str) else tuple(columns)


def links_of(document: Document) -> Links:
    """References a document states itself: ``is_join`` columns named like the key of exactly one other table, the whole of it."""
    owners: dict[tuple[str, ...], list[str]] = {}
    for table in document.tables:
        if table.keys():
            owners.setdefault(tuple(table.keys()), []).append(table.name)
    links = {}
    for table in document.tables:
        joins = {field.raw_name for field in table.fields if field.flag("is_join")}
        for keys, names in owners.items():
            others = [name for name in names if name != table.name]
            if joins.issuperset(keys) and len(others) == 1:
                columns = keys[0] if len(keys) == 1 else keys
                links[(table.name, columns)] = (others[0], columns)
    return links


def result_rows(counts: DataFrame, table: str, column: str, check: str, value: str | None, by: Sequence[str] = ()) -> DataFrame:
    """Counts as rows of a report, an error where any failed."""
    text = lambda v: F.lit(v).cast("string")
    return counts.select(
        *by, text(table).alias("table"), text(column).alias("column"), text(check).alias("check"),
        text(None).alias("constraint"), text("error").alias("level"), text(value).alias("value"),
        *result_columns(F.col("evaluated"), F.col("failed"), F.lit(2)),
    )


def validate_relational(
    tables: Mapping[str, DataFrame],
    document: Document,
    links: Links | None = None,
) -> DataFrame:
    """Every table by itself, the uniqueness of its ``is_key`` columns, and every reference between tables.

    ``links`` maps ``(table, column)`` to ``(parent table, key column)``, or several columns to a compound key; without it the
    document's ``is_join`` flags say what refers to what.
    """
    absent = [t.name for t in document.tables if t.name not in tables]
    if absent:
        raise DocumentError(f"no data for tables {absent}")
    parts = []
    for spec in document.tables:
        report = validate(tables[spec.name], spec)
        parts.append(report.select(F.lit(spec.name).alias("table"), *report.columns))
        if spec.keys():
            counts = key_counts(tables[spec.name], spec.keys())
            parts.append(result_rows(counts, spec.name, ",".join(spec.keys()), "key_unique", None))
    for (child, column), (parent, key) in (links if links is not None else links_of(document)).items():
        columns, keys = names_of(column), names_of(key)
        counts = reference_check(tables[child], columns, tables[parent], keys)
        parts.append(result_rows(counts, child, ",".join(columns), "reference", f"{parent}.{','.join(keys)}"))
    return reduce(DataFrame.unionByName, parts)
