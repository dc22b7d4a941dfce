"""Take in files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from qualframe.document import DocumentError
from qualframe.plans.ingest import FILE_KEY, Dataset


def new_files(dataset: Dataset, source: str, schema: StructType | str, key_pattern: str = FILE_KEY,
              file_format: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """A stream of rows tagged with the delivery they belong to: by default, each file is one.

    ``key_pattern`` takes the delivery from the file name. ``ingest_new_files`` takes deliveries of several files, whenever they arrive.
    """
    reader = dataset.spark.readStream.format(file_format).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(source).withColumn("ingestion", F.regexp_extract(F.col("_metadata.file_name"), key_pattern, 1))


def ingest_incremental(dataset: Dataset, stream: DataFrame, checkpoint: str) -> StreamingQuery:
    """Ingest everything that is new, then stop. The checkpoint remembers which files were seen.

    The batch number is the attempt's token, so a batch that is run again after a failure is taken in once.
    """
    def take(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        token = f"batch-{number}"
        keys = batch.select("ingestion").distinct().withColumn("own", dataset.uid_of(F.col("ingestion"), token))
        earlier = dataset.manifest().where("status = 'accepted'").join(keys, "ingestion").where("uid <> own").select("ingestion").first()
        if earlier:
            raise DocumentError(f"more of delivery {earlier.ingestion!r}, which was taken in before: use ingest_new_files")
        dataset.ingest(batch, token=token)

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_new_files(dataset: Dataset, source: str, checkpoint: str, key_pattern: str = FILE_KEY,
                     files_per_batch: int | None = None) -> StreamingQuery:
    """Ingest the Parquet files that are new, file by file checked for names and types, then stop.

    A delivery of several files that arrive at different times is taken in again as a whole each time one of them arrives, so the
    newest attempt has all its rows.
    """
    def take(batch: DataFrame, number: int) -> None:
        dataset.ingest_files(source, key_pattern, only=batch.select("ingestion"), token=f"batch-{number}")

    # Only the names of files are used, so files of any schema can arrive.
    names = dataset.spark.readStream.format("parquet").schema("`_none` string")
    if files_per_batch:
        names = names.option("maxFilesPerTrigger", files_per_batch)
    arrived = names.load(source).select(F.regexp_extract(F.col("_metadata.file_name"), key_pattern, 1).alias("ingestion"))
    return arrived.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
