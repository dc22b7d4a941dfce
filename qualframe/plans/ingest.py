"""Take in deliveries: check, gate, publish, fingerprint, report.

Raw data is read once: all deliveries of a batch are written into folders nobody reads until the manifest names them, and what was
written is validated by one aggregate grouped by delivery. The manifest rows are written last, all at once, so a job that dies leaves
nothing half visible, and running it again does no harm.
"""

from __future__ import annotations

import datetime as dt
from contextlib import contextmanager
from dataclasses import dataclass
from time import monotonic, sleep
from typing import Iterator, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qualframe.document import Document, DocumentError
from qualframe.functions.columns import quoted, ref, roots
from qualframe.functions.uid import encode_uid, key_hash, largest
from qualframe.operators.deliveries import STATED, row_rows, stated_rows
from qualframe.operators.ordering import rank_groups
from qualframe.operators.relational import result_rows
from qualframe.operators.validate import name_checks, type_checks, validate
from qualframe.session import materialize
from qualframe.sources.files import list_files, path_exists, project, write_partitions
from qualframe.sources.footers import footers_of
from qualframe.sources.hashes import folder_hash, hashes_of
from qualframe.sources.remote import hadoop_path
from qualframe.sources.reports import BATCH, batch_of, latest, read_reports, write_report
from qualframe.types import ddl_type

MANIFEST_DDL = (
    "ingestion string, uid string, status string, validated int, part_no bigint, part_name string, path string, "
    "rows bigint, columns int, files bigint, bytes bigint, digest string, ingest_time string"
)
PART_STEP = 10
# Partition column that tells attempts at one delivery apart.
ATTEMPT = "attempt"
# Seconds a run waits for another that is adding to the manifest.
COMMIT_WAIT = 600
# The folder of rows whose partition column is null or empty.
_NO_NAME = "__HIVE_DEFAULT_PARTITION__"
_NO_DELIVERY = "there are rows that belong to no delivery: ingestion is null"
# By default each file is a delivery, named like it.
FILE_KEY = r"^(.*?)(\.[A-Za-z]+)*$"


def part_name(number: int, ingestion: str, dataset_uid: str, uid: str) -> str:
    """Name under which a delivery is published."""
    return f"part_{number:04}_{ingestion}_{dataset_uid}_{uid}"


def verdicts_of(report: DataFrame) -> DataFrame:
    """``ingestion, uid, validated, rows``: the worst severity and the rows of every delivery of a kept report."""
    rows = F.sum(F.when(F.col("check") == "rows", F.col("evaluated")))  # of all tables
    return report.groupBy("ingestion", "uid").agg(F.max("severity").alias("validated"), rows.alias("rows"))


def manifest_rows(verdicts: DataFrame, found: DataFrame, columns: int, time: str) -> DataFrame:
    """Rows of the manifest but for their numbers; ``place`` counts accepted and refused deliveries. One row per delivery throughout."""
    place = F.row_number().over(Window.partitionBy(F.col("validated") < 2).orderBy("ingestion"))
    return verdicts.withColumn("place", place).join(found, "uid", "left").select(
        "ingestion", "uid", F.when(F.col("validated") < 2, "accepted").otherwise("rejected").alias("status"), F.col("validated").cast("int").alias("validated"),
        "place", "path", "rows", F.lit(columns).alias("columns"), "files", "bytes", "digest", F.lit(time).alias("ingest_time"))


def split_by_gate(levels: dict[str, int]) -> tuple[list[str], list[str]]:
    """Deliveries that pass (nothing found, or warnings only) and those with an error."""
    passed = sorted(key for key, level in levels.items() if level < 2)
    return passed, sorted(set(levels) - set(passed))


@dataclass
class Dataset:
    """One dataset of deliveries below ``root``: ``published``, ``reports`` and ``manifest``."""

    spark: SparkSession
    root: str
    document: Document
    balanced: bool = True  # False for raw data that is laid out by delivery already: published without a shuffle
    unique_keys: bool = False  # whether a key column's values may occur once only in all deliveries together

    @property
    def published_path(self) -> str:
        return f"{self.root}/published"

    @property
    def reports_path(self) -> str:
        return f"{self.root}/reports"

    @property
    def manifest_path(self) -> str:
        return f"{self.root}/manifest"

    def manifest(self) -> DataFrame:
        if not path_exists(self.spark, self.manifest_path):
            return self.spark.createDataFrame([], MANIFEST_DDL)
        return self.spark.read.schema(MANIFEST_DDL).parquet(self.manifest_path)

    def reports(self) -> DataFrame:
        return read_reports(self.spark, self.reports_path)

    def uid_of(self, ingestion: Column, token: str) -> Column:
        """Identifier of one delivery: the same again for the same dataset, delivery and token."""
        return encode_uid(key_hash(F.lit(self.document.uid), ingestion, F.lit(token)) % F.lit(largest() + 1))

    def ingest_files(self, source: str, key_pattern: str = FILE_KEY, only: DataFrame | None = None, token: str | None = None,
                     time: str | None = None) -> DataFrame:
        """Take in Parquet files below ``source`` (of the deliveries in ``only``, a frame with ``ingestion``, if given).

        The name of a file says which delivery it belongs to. Names and types are checked file by file, from the footers, before any
        data is read; a delivery that lacks a column or stores another type is refused without being read.
        """
        key = lambda path: F.regexp_extract(F.regexp_extract(path, r"([^/]*)$", 1), key_pattern, 1)
        found = list_files(self.spark, source, "*.parquet").select("path", key(F.col("path")).alias("ingestion"))
        if only is not None:
            found = found.join(only.select("ingestion").distinct(), "ingestion", "left_semi")
        footers = materialize(footers_of(found.select("path")).withColumn("ingestion", key(F.col("path"))))
        spec = self.document.table
        stated = materialize(stated_rows(footers, spec))
        refused = stated.where("severity = 2").select("ingestion").distinct()
        # One path for each file to read, which Spark's own file index holds as well.
        paths = [row.path for row in footers.select("path", "ingestion").distinct().join(refused, "ingestion", "left_anti").collect()]
        fields = [f"{quoted(f.raw_name)} {ddl_type(f.pq_type, f.logical_type)}" for f in spec.fields if "." not in f.raw_name]
        plain = len(fields) == len(spec.fields)
        reader = self.spark.read.schema(", ".join(fields)) if plain else self.spark.read
        if paths:
            read = reader.parquet(*[hadoop_path(path) for path in paths])
            frame = read.withColumn("ingestion", F.regexp_extract(F.col("_metadata.file_name"), key_pattern, 1))
        else:
            frame = self.spark.createDataFrame([], ", ".join([*fields, "ingestion string"]))
        unread = row_rows(footers.join(refused, "ingestion", "left_semi"))
        return self.ingest(frame, token=token, time=time, stated=stated.unionByName(unread))

    def ingest(self, deliveries: DataFrame, only: Sequence[str] | None = None, token: str | None = None,
               time: str | None = None, stated: DataFrame | None = None) -> DataFrame:
        """Take in every delivery of a frame with an ``ingestion`` column (or ``only`` some); returns manifest rows.

        The frame is read once: its rows are written into folders nobody reads, the report is made from what was written, and the manifest
        names the deliveries that pass. Deliveries stay rows throughout, so the plan is the same for ten of them and for ten thousand.

        ``token`` tells one attempt from another. Repeating an attempt, as a restarted stream does, publishes
        into the same folders, writes its report over the earlier one and adds nothing to the manifest twice. ``stated`` holds
        name and type checks per delivery, known from its files, which take the place of those of the frame.
        """
        time = time or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None).isoformat(sep=" ")
        token = token or time
        frame = deliveries.withColumn("ingestion", F.col("ingestion").cast("string"))
        if only is not None:
            frame = frame.where(F.col("ingestion").isin(*map(str, only)))
        done = self.manifest().where(F.col("uid") == self.uid_of(F.col("ingestion"), token)).select("ingestion")
        batch = token
        if earlier := done.count():
            frame = frame.join(done, "ingestion", "left_anti")
            stated = None if stated is None else stated.join(done, "ingestion", "left_anti")
            if frame.isEmpty() and (stated is None or stated.isEmpty()):
                return self.spark.createDataFrame([], MANIFEST_DDL)
            batch = f"{token} after {earlier}"  # what the attempt has taken in keeps its folders
        report, folder = self.stage(frame, token, batch, stated)
        if self.unique_keys and folder is not None and self.document.table.keys():
            report = report.unionByName(self._key_rows(self.written(frame, folder)).select(*report.columns))
        verdicts = self._report(report, token, batch, time)
        rows = self._manifest_rows(verdicts, folder, len(deliveries.columns) - 1, time)
        return self._commit(rows, token)

    def stage(self, frame: DataFrame, token: str, batch: str, stated: DataFrame | None = None) -> tuple[DataFrame, str | None]:
        """Write deliveries where nobody reads yet and check what was written: their report, and the folder of the attempt.

        What the frame's own columns and types refuse is not written at all; its report is made from the frame.
        """
        spec = self.document.table
        names = [c for c in frame.columns if c != "ingestion" or c in spec.columns]
        known = [] if stated is not None else [*name_checks(names, spec), *type_checks(frame, spec)]
        if any(check.fail_severity == 2 and check.failed for check in known):
            report = materialize(validate(frame, spec, by=["ingestion"]))
            if not report.where("ingestion IS NULL").isEmpty():
                raise DocumentError(_NO_DELIVERY)
            return report, None
        folder = f"{self.published_path}/{BATCH}={batch_of(batch)}"
        shaped = self._shaped(frame, token)
        write_partitions(shaped, folder, ("ingestion", ATTEMPT), balanced=self.balanced)
        if path_exists(self.spark, f"{folder}/ingestion={_NO_NAME}"):
            raise DocumentError(_NO_DELIVERY)
        written = self.written(frame, folder)
        report = validate(written.drop(ATTEMPT), spec, by=["ingestion"], delivered=names)
        if stated is not None:
            report = report.where(~F.col("check").isin(*STATED)).unionByName(stated.select(*report.columns))
        return report, folder

    def _shaped(self, frame: DataFrame, token: str = "") -> DataFrame:
        kept = [c for c in roots(self.document.table.columns, frame.columns) if c != "ingestion"]
        return project(frame, [*kept, "ingestion"]).withColumn(ATTEMPT, self.uid_of(F.col("ingestion"), token))

    def written(self, frame: DataFrame, folder: str) -> DataFrame:
        """What an attempt at the deliveries of ``frame`` wrote to its folder."""
        schema = self._shaped(frame).schema
        return self.spark.read.schema(schema).parquet(folder) if path_exists(self.spark, folder) else self.spark.createDataFrame([], schema)

    def _key_rows(self, written: DataFrame) -> DataFrame:
        """Rows of the report on keys that occur again, in the same delivery or in any other."""
        from qualframe.plans.keys import KeyIndex

        index = KeyIndex(self, self.document.table.keys())
        index.refresh()
        return result_rows(index.counts(written), self.document.name, ",".join(index.keys), "key_unique", None, ["ingestion"])

    def _report(self, report: DataFrame, token: str, batch: str, time: str) -> DataFrame:
        """Keep the report; returns the verdict on every delivery, made from what was kept."""
        whole = F.max("severity").over(Window.partitionBy("ingestion"))  # as many rows as there are checks
        stamped = report.withColumn("_validated", whole).select(
            *report.columns, self.uid_of(F.col("ingestion"), token).alias("uid"), F.lit(time).alias("ingest_time"), (F.col("_validated") < 2).alias("accepted"))
        kept = write_report(stamped, self.reports_path, batch)
        return verdicts_of(kept)

    def _manifest_rows(self, verdicts: DataFrame, folder: str | None, columns: int, time: str) -> DataFrame:
        """Rows of the manifest but for their numbers, with files and hash of what was accepted."""
        return manifest_rows(verdicts, self.hashed(verdicts, folder), columns, time)

    def hashed(self, verdicts: DataFrame, folder: str | None) -> DataFrame:
        """Path, files, bytes and hash of every accepted delivery among those written to ``folder``."""
        if folder is None:
            return self.spark.createDataFrame([], "uid string, path string, files bigint, bytes bigint, digest string")
        uid = F.regexp_extract("path", f"/{ATTEMPT}=([^/]+)/[^/]*$", 1)
        below = F.regexp_extract("path", f"/(ingestion=[^/]*/{ATTEMPT}=[^/]+)/[^/]*$", 1)
        accepted = list_files(self.spark, folder, "*.parquet").withColumn("uid", uid).join(
            verdicts.where("validated < 2").select("uid"), "uid", "left_semi")
        return folder_hash(hashes_of(accepted).select("*", uid.alias("uid"), below.alias("below")), ["uid", "below"]).select(
            "uid", F.concat(F.lit(f"{folder}/"), "below").alias("path"), "files", "bytes", "digest")

    def _commit(self, rows: DataFrame, token: str) -> DataFrame:
        """Number the accepted deliveries and add all rows to the manifest, which makes them visible at once; returns what was added."""
        rows = materialize(rows)
        if rows.isEmpty():
            return self.spark.createDataFrame([], MANIFEST_DDL)
        with self._alone(token):
            last = self.manifest().agg(F.max("part_no").alias("n")).first().n or 0
            number = F.when(F.col("status") == "accepted", F.lit(last).cast("bigint") + F.col("place") * PART_STEP)
            name = F.format_string("part_%04d_%s_%s_%s", number, "ingestion", F.lit(self.document.uid), "uid")
            added = rows.withColumn("part_no", number).withColumn("part_name", F.when(number.isNotNull(), name))
            added = added.select(*[c.split(" ")[0] for c in MANIFEST_DDL.split(", ")])
            added.coalesce(1).write.mode("append").parquet(self.manifest_path)
        return added

    @contextmanager
    def _alone(self, token: str) -> Iterator[None]:
        """One run at a time reads the last number and adds to the manifest. A restarted attempt finds its own claim and goes on."""
        context = self.spark.sparkContext
        claim = context._jvm.org.apache.hadoop.fs.Path(f"{self.root}/committing")
        system = claim.getFileSystem(context._jsc.hadoopConfiguration())
        until = monotonic() + COMMIT_WAIT
        while True:
            try:
                out = system.create(claim, False)
                out.write(bytearray(token.encode()))
                out.close()
                break
            except Py4JJavaError:
                if not path_exists(self.spark, claim.toString()):
                    raise
            holder = "\n".join(row.value for row in self.spark.read.text(claim.toString(), wholetext=True).collect())
            if holder == token:
                break
            if monotonic() > until:
                raise DocumentError(f"attempt {holder!r} is adding to the manifest; if it is gone, remove {claim.toString()}")
            sleep(0.5)
        try:
            yield
        finally:
            system.delete(claim, False)

    def leftovers(self) -> DataFrame:
        """Files of attempts the manifest does not name as accepted (refused, or never finished), which nobody reads: ``path, length``."""
        if not path_exists(self.spark, self.published_path):
            return self.spark.createDataFrame([], "path string, length bigint")
        named = self.manifest().where("status = 'accepted'").select("uid")
        files = list_files(self.spark, self.published_path, "*.parquet").withColumn("uid", F.regexp_extract("path", f"/{ATTEMPT}=([^/]+)/[^/]*$", 1))
        return files.join(named, "uid", "left_anti").select("path", "length")

    def read(self) -> DataFrame:
        """The published rows: of every delivery the newest accepted attempt; the delivery's columns come last.

        A join with the manifest selects them, whatever their number; Spark prunes the folders by it where the manifest is small.
        """
        return self.attempts(latest(self.manifest().where("status = 'accepted'")).select("ingestion", F.col("uid").alias(ATTEMPT)))

    def attempts(self, named: DataFrame) -> DataFrame:
        """The rows of some attempts (``ingestion``, ``attempt``)."""
        if not path_exists(self.spark, self.published_path):
            return self._nothing()
        published = self._published()
        return published.join(named, ["ingestion", ATTEMPT], "left_semi").select(*[ref(c) for c in published.columns if c != BATCH])

    def _published(self) -> DataFrame:
        """Folder names are text: a delivery named ``007`` or an identifier of digits must not become a number."""
        found = self.spark.read.parquet(self.published_path).schema
        keys = (BATCH, "ingestion", ATTEMPT)
        as_text = T.StructType([f for f in found.fields if f.name not in keys] + [T.StructField(k, T.StringType()) for k in keys])
        return self.spark.read.schema(as_text).parquet(self.published_path)

    def _nothing(self) -> DataFrame:
        fields = [f"{quoted(f.raw_name)} {ddl_type(f.pq_type, f.logical_type)}"
                  for f in self.document.table.fields if f.raw_name != "ingestion"]
        return self.spark.createDataFrame([], ", ".join([*fields, "ingestion string", f"{ATTEMPT} string"]))

    def history(self) -> DataFrame:
        """The newest manifest row of every delivery, accepted or not."""
        return latest(self.manifest())

    def listing(self) -> DataFrame:
        """What a reader of the dataset wants to see of every delivery, newest first."""
        return self.history().select(
            "ingestion", "validated", "status", "rows", "columns", "uid", "ingest_time").orderBy(F.desc("ingestion"))

    def trend(self) -> DataFrame:
        return row_trend(self.history().where("status = 'accepted'").select("ingestion", "rows"))


def row_trend(counts: DataFrame) -> DataFrame:
    """``x`` = 1.. from the oldest delivery on, rows, and the change against the delivery before."""
    numbered = rank_groups(counts, [F.col("ingestion").asc()], "_i").select((F.col("_i") + 1).alias("x"), "ingestion", "rows")
    before = numbered.select((F.col("x") + 1).alias("x"), F.col("rows").alias("_before"))
    return numbered.join(before, "x", "left").select("x", "ingestion", "rows", (F.col("rows") - F.col("_before")).alias("change"))


def row_counts(df: DataFrame, by: str = "ingestion") -> DataFrame:
    return df.groupBy(ref(by).alias("ingestion")).agg(F.count("*").alias("rows"))
