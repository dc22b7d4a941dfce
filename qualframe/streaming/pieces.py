"""Deliveries whose files arrive one after the other.

A stream of file names keeps a state of a few numbers for every delivery: files seen, files expected, whether an end marker came. A delivery is taken in
once, as a whole, when it is complete: all expected files are there, its marker is, or nothing new came for some time. Files that come after
that are not lost silently: they are listed by ``late_files``.
"""

from __future__ import annotations

import sys
from typing import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from qualframe.plans.ingest import Dataset
from qualframe.sources.files import path_exists

# A binary file stream has one row per file; contents are not read unless asked for.
FILE_DDL = "path string, modificationTime timestamp, length bigint, content binary"
STATE_DDL = "seen bigint, expected bigint, ended boolean, released boolean"
OUTCOME_DDL = "ingestion string, outcome string, files bigint, path string"
NAME = r"([^/]*)$"


def arrivals(dataset: Dataset, source: str, key_pattern: str, count_pattern: str | None = None, end_pattern: str | None = None,
             files_per_batch: int | None = None) -> DataFrame:
    """A stream with one row per file: ``ingestion, path, expected, ends``.

    ``key_pattern`` takes the delivery from a file's name, ``count_pattern`` the number of its files, and a name that ``end_pattern`` is found in is a
    marker, no file of the delivery. A marker must hold something, since Spark's listing leaves empty files out.
    """
    reader = dataset.spark.readStream.format("binaryFile").schema(FILE_DDL)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    name = F.regexp_extract("path", NAME, 1)
    expected = F.nullif(F.regexp_extract(name, count_pattern, 1), F.lit("")).cast("bigint") if count_pattern else F.lit(None).cast("bigint")
    return reader.load(source).select(
        F.regexp_extract(name, key_pattern, 1).alias("ingestion"), "path", expected.alias("expected"),
        (name.rlike(end_pattern) if end_pattern else F.lit(False)).alias("ends"))


def outcomes(files: DataFrame, wait_seconds: float | None = None) -> DataFrame:
    """One row per delivery that is complete (``released``) and per file that came after that (``late``).

    With ``wait_seconds`` a delivery is complete as well when no file of it came for that time.
    """
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, expected, ended, released = state.get if state.exists else (0, None, False, False)
        late = []
        for frame in frames:
            for path, number, ends in zip(frame["path"], frame["expected"], frame["ends"]):
                if released:
                    late.append(path)
                    continue
                seen += not ends
                ended = ended or bool(ends)
                if not pd.isna(number):
                    expected = int(number)
        rows = [(key[0], "late", None, path) for path in late]
        # A marker with a known number of files waits for the files; a file beyond the number is no reason to wait.
        complete = seen >= expected if expected is not None else ended
        if not released and seen and (complete or state.hasTimedOut):
            rows.append((key[0], "released", seen, None))
            released = True
        state.update((seen, expected, ended, released))
        if wait_seconds is not None and not released:
            state.setTimeoutDuration(int(wait_seconds * 1000))
        frame = pd.DataFrame(rows, columns=["ingestion", "outcome", "files", "path"])
        yield frame.astype({"files": "Int64"})

    timer = GroupStateTimeout.NoTimeout if wait_seconds is None else GroupStateTimeout.ProcessingTimeTimeout
    return files.groupBy("ingestion").applyInPandasWithState(step, OUTCOME_DDL, STATE_DDL, "append", timer)


def late_path(dataset: Dataset) -> str:
    return f"{dataset.root}/late"


def late_files(dataset: Dataset) -> DataFrame:
    """``ingestion, path, batch`` of files that came after their delivery had been taken in."""
    ddl = "ingestion string, path string, batch bigint"
    if not path_exists(dataset.spark, late_path(dataset)):
        return dataset.spark.createDataFrame([], ddl)
    return dataset.spark.read.schema(ddl).parquet(late_path(dataset))


def ingest_whole_deliveries(dataset: Dataset, source: str, checkpoint: str, key_pattern: str, count_pattern: str | None = None,
                            end_pattern: str | None = None, wait_seconds: float | None = None, files_per_batch: int | None = None,
                            every: str | None = None) -> StreamingQuery:
    """Take in every delivery once it is complete: of what has arrived, or for good, ``every`` so often (``"30 seconds"``).

    With ``wait_seconds`` alone one batch looks at all that has arrived and at all timers; a stream with timers never runs out of batches. The batch number is the attempt's token, so a batch that is run again after a failure is taken in once.
    """
    def take(batch: DataFrame, number: int) -> None:
        found = batch.persist()
        try:
            if not found.where("outcome = 'released'").isEmpty():
                dataset.ingest_files(source, key_pattern, only=found.where("outcome = 'released'"), token=f"batch-{number}")
            if not found.where("outcome = 'late'").isEmpty():
                found.where("outcome = 'late'").select("ingestion", "path").coalesce(1).write.mode("overwrite").parquet(f"{late_path(dataset)}/batch={number}")
        finally:
            found.unpersist()

    stream = outcomes(arrivals(dataset, source, key_pattern, count_pattern, end_pattern, files_per_batch), wait_seconds)
    writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    if every:
        return writer.trigger(processingTime=every).start()
    return (writer.trigger(availableNow=True) if wait_seconds is None else writer.trigger(once=True)).start()


# Tasks get the functions above with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
