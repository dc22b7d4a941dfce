"""Reading and writing tables."""

from __future__ import annotations

import posixpath
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qualframe.document import DocumentError, TableSpec
from qualframe.functions.columns import ref, roots

MEGABYTE = 1_000_000
# Bytes of one XML file we write: no reader splits XML, so each file is the work of one task.
XML_FILE = 16 * MEGABYTE


def widened(df: DataFrame) -> DataFrame:
    """Whole numbers as ``bigint``: the type every text format infers the same for small and large files."""
    small = (T.ByteType, T.ShortType, T.IntegerType)
    return df.select(*[
        ref(f.name).cast("bigint").alias(f.name, metadata=f.metadata) if isinstance(f.dataType, small) else ref(f.name)
        for f in df.schema.fields
    ])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, keep_empty: bool = False) -> DataFrame:
    """CSV with a header. With a schema the file is read once; without one an extra pass infers it.

    ``keep_empty`` keeps empty text empty instead of null (empty numbers are null either way).
    """
    reader = spark.read.option("header", True)
    if keep_empty:
        reader = reader.option("nullValue", "\u0000").option("emptyValue", "")
    if schema is not None:
        return reader.schema(schema).csv(path)
    return widened(reader.option("inferSchema", True).csv(path))


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """JSON lines."""
    reader = spark.read
    return reader.schema(schema).json(path) if schema is not None else reader.json(path)


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: T.StructType | str | None = None) -> DataFrame:
    """XML with one element per row. A file is read by one task, however long it is; ``write_xml`` writes short ones."""
    reader = spark.read.option("rowTag", row_tag)
    return reader.schema(schema).xml(path) if schema is not None else widened(reader.xml(path))


def write_xml(df: DataFrame, path: str, row_tag: str, root_tag: str) -> None:
    """XML with one element per row, in files of about ``XML_FILE`` bytes, each written by one task.

    The text is measured first, so the number of files follows from the rows, whatever the layout of their source.
    """
    size = F.sum(F.octet_length(F.to_xml(F.struct("*"), {"rowTag": row_tag})).cast("bigint"))
    written = df.agg(size).first()[0] or 0
    placed = df.repartition(max(1, -(-written // XML_FILE)))
    placed.write.option("rowTag", row_tag).option("rootTag", root_tag).format("xml").save(path)


def parquet_path(path: str) -> str:
    """The Parquet sibling of a source file: only the suffix changes."""
    stem, suffix = posixpath.splitext(path)
    return stem + ".parquet" if suffix.lower() in (".csv", ".json", ".xml") else path + ".parquet"


def csv_to_parquet(spark: SparkSession, csv_path: str, out: str | None = None,
                   schema: T.StructType | str | None = None) -> str:
    """Convert, uncompressed; returns where the Parquet table is."""
    out = out or parquet_path(csv_path)
    read_csv(spark, csv_path, schema).write.mode("overwrite").option("compression", "none").parquet(out)
    return out


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path)


def load_data(spark: SparkSession, csv_path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The Parquet table next to a CSV file, converted first if there is none yet; only the columns asked for are read."""
    table = parquet_path(csv_path)
    if not path_exists(spark, table):
        csv_to_parquet(spark, csv_path, table)
    df = spark.read.parquet(table)
    return df.select(*[ref(c) for c in columns]) if columns else df


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns of a specification in its order; others are not even read, and a missing one is an error."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise DocumentError(f"missing columns {absent}")
    return df.select(*[ref(c) for c in columns])


def project_to(df: DataFrame, spec: TableSpec) -> DataFrame:
    return project(df, roots(spec.columns, df.columns))


def write_partitions(df: DataFrame, path: str, by: Sequence[str] = ("ingestion",), mode: str = "overwrite",
                     balanced: bool = True) -> None:
    """Write one folder per value of ``by``, replacing only the folders this frame has rows for.

    The rebalance hint lets Spark split a folder that holds most of the rows over several tasks and files,
    and join small ones, instead of one task per folder. Without ``balanced`` rows stay in the tasks they are in.
    """
    placed = df.hint("rebalance", *[ref(c) for c in by]) if balanced else df
    placed.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def preview(df: DataFrame, n: int = 20, order: Sequence[str | Column] = ()) -> DataFrame:
    """The first rows; the same ones every time if an order is given."""
    return (df.orderBy(*order) if order else df).limit(n)


def list_files(spark: SparkSession, path: str | list[str], pattern: str | None = None) -> DataFrame:
    """``path, length`` of every file below a path; contents are not read.

    Spark plans the listing like a scan; for millions of files ``spark.sql.files.maxPartitionNum`` bounds its tasks.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", "length")


def spread_files(files: DataFrame) -> DataFrame:
    """Files over all cores; hashing paths keeps big and small files apart evenly."""
    spark = files.sparkSession
    # Executors may still be starting up, so the configured width counts as well as the cores there are now.
    width = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return files.repartition(width, "path")


def plan_bytes(df: DataFrame) -> int:
    """Size of a frame as the optimizer estimates it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def footprint(spark: SparkSession, paths: Mapping[str, str], df: DataFrame) -> DataFrame:
    """Rows, columns and megabytes: of the files of each named path, and of the frame in memory (estimated)."""
    sizes = None
    for kind, path in paths.items():
        part = list_files(spark, path).agg(
            F.lit(kind).alias("kind"), F.count("*").alias("files"),
            (F.coalesce(F.sum("length"), F.lit(0)) / F.lit(MEGABYTE)).alias("megabytes"))
        sizes = part if sizes is None else sizes.unionByName(part)
    memory = df.agg(
        F.lit("memory").alias("kind"), F.lit(0).cast("bigint").alias("files"),
        F.lit(plan_bytes(df) / MEGABYTE).alias("megabytes"), F.count("*").alias("rows"),
        F.lit(len(df.columns)).alias("columns"))
    return memory if sizes is None else sizes.unionByName(memory, allowMissingColumns=True)
