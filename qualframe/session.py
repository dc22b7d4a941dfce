"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # INT96 (the default) has no statistics and fails the type check on our own files.
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
}


# The scratch folder of each application.
_SCRATCH: dict[str, str] = {}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings results depend on; everything else stays the cluster's choice."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder the session names; one of our own only for a local session without any."""
    context = spark.sparkContext
    named = context.getCheckpointDir()
    if named:
        return named
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="qualframe-checkpoint-")
    context.setCheckpointDir(named)
    return named


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and go on from the written files.

    Used where a later step must see the very same partitions again (offsets per partition)
    or where several small queries follow one large scan. Survives the loss of executors.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder, for files a job writes and reads again; removed when the driver ends."""
    context = spark.sparkContext
    top = _SCRATCH.get(context.applicationId)
    if top is None:
        top = f"{checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"
        folder = context._jvm.org.apache.hadoop.fs.Path(top)
        system = folder.getFileSystem(context._jsc.hadoopConfiguration())
        system.mkdirs(folder)
        system.deleteOnExit(folder)
        _SCRATCH[context.applicationId] = top
    return f"{top}/{name}-{uuid.uuid4().hex}"
