"""A corpus prepared for training: quality rules, toxicity, line and near-duplicate removal, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows of ``docs``, which is what the stage before it kept; all but the last return
the columns of ``docs``. Between stages the rows are written as Parquet to the shared scratch folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qualframe.llm import line_dedup, near_dedup, packing, quality, queries, toxicity
from qualframe.llm.common import stored, table
from qualframe.operators.ordering import rank_groups


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the default policy."""
    return quality.ledger(docs).where(quality.passes(quality.DEFAULT_POLICY)).select(*docs.columns)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold; the model learns from the labelled part of the whole table."""
    return toxicity.score(docs, queries.toxicity_model(spark, sf_dir), to="_toxic").where(F.col("_toxic") < toxicity.THRESHOLD).select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines an earlier line stands for; documents left with too few words for the quality rules go.

    What is left of a near copy of another document is a few lines, which no later stage would find to be near anything.
    """
    rest = line_dedup.without_duplicates(docs)
    few = F.col("fail_bits").bitwiseAND(F.lit(quality.mask(["few_words"])).cast("bigint")) != 0
    kept = quality.ledger(rest).where(~few).select(*docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates, once.

    Rows that share an id, or have none, are told apart by a digest of their text, equal ones being one row; behind
    the largest id they have numbers of their own, so a row with an id of its own stays before them.
    """
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("_rows")).where("_rows > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("_id"))
    repeated = stored(repeated, "repeated-ids")
    shared = stored(docs.join(repeated, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").withColumn(
        "_digest", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).dropDuplicates(["doc_id", "_digest"]), "shared-ids")
    numbers = rank_groups(shared.select("doc_id", "_digest"), [F.col("doc_id").asc_nulls_last(), F.col("_digest").asc()], "_number")
    last = docs.agg(F.coalesce(F.max("doc_id"), F.lit(0))).first()[0]
    own = docs.join(repeated, F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti").withColumn("_key", F.col("doc_id"))
    told = numbers.withColumnRenamed("doc_id", "_id").withColumnRenamed("_digest", "_told")
    rest = shared.join(told, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_told"))).withColumn("_key", F.col("_number") + last + 1)
    keyed = own.select(*docs.columns, "_key").unionByName(rest.select(*docs.columns, "_key"))
    gone = near_dedup.near_duplicates(keyed.select("_key", "text"), "_key").where("NOT kept").select("_key")
    return keyed.join(gone, "_key", "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 2,048 tokens."""
    return packing.pack(docs, added=queries.added_tokens())


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("minhash_dedup", without_near_copies),
    ("packing", packed),
]
# Models and approximate candidates are beyond SQL; the stages are tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
