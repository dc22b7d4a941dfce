"""Content hashes of published files."""

from __future__ import annotations

import hashlib
import sys
from typing import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qualframe.sources.files import list_files, spread_files
from qualframe.sources.remote import open_file

BLOCK = 4 * 1024 * 1024


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        digests = []
        for path in batch["path"]:
            digest = hashlib.sha256()
            with open_file(path) as source:
                while block := source.read(BLOCK):
                    digest.update(block)
            digests.append(digest.hexdigest())
        yield batch.assign(sha256=digests)


def content_hashes(spark: SparkSession, path: str | list[str], pattern: str = "*.parquet") -> DataFrame:
    """``path, length, sha256`` of every file: read in blocks inside the tasks, never as a whole."""
    return hashes_of(list_files(spark, path, pattern))


def hashes_of(files: DataFrame) -> DataFrame:
    """The same for the files of a frame with ``path`` and ``length``."""
    return spread_files(files.select("path", "length")).mapInPandas(_digests, "path string, length bigint, sha256 string")


def folder_hash(files: DataFrame, by: list[str]) -> DataFrame:
    """Files, bytes and one number per group of files: the sum of the first 60 bits of every hash.

    A sum needs no order and no list of files in one place; the hash of each file stays the exact record.
    """
    leading = F.conv(F.substring("sha256", 1, 15), 16, 10).cast("decimal(38,0)")
    return files.groupBy(*by).agg(
        F.count("*").alias("files"), F.sum("length").alias("bytes"), F.sum(leading).cast("string").alias("digest"))


# Tasks get the functions above with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
