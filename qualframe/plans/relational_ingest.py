"""Take in deliveries of several tables that refer to each other.

Every table is written and checked like a dataset of its own, in folders nobody reads. Keys and references are then checked by delivery: a
reference leads to a parent of the same delivery, or to one that is published already. One manifest row per delivery makes all its
tables visible at once; a delivery with an error in any table, key or reference leaves none of them behind.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce
from typing import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualframe.document import Document, DocumentError
from qualframe.operators.relational import Links, links_of, names_of, references_by_delivery, result_rows
from qualframe.operators.uniqueness import key_counts
from qualframe.plans.ingest import ATTEMPT, MANIFEST_DDL, Dataset, manifest_rows
from qualframe.sources.reports import latest


@dataclass
class RelationalDataset(Dataset):
    """A dataset of the tables of a relational document, below ``root/tables``; manifest and reports are common to them.

    ``links`` says what refers to what (``operators.relational``); without it the document does.
    """

    links: Links | None = None

    def table(self, name: str) -> Dataset:
        """Where one table is written; its deliveries have the identifiers of the whole."""
        return Dataset(self.spark, f"{self.root}/tables/{name}", Document(name, self.document.uid, (self._spec(name),)), self.balanced)

    def _spec(self, name: str):
        found = [spec for spec in self.document.tables if spec.name == name]
        if not found:
            raise DocumentError(f"no table {name!r}")
        return found[0]

    def ingest_tables(self, deliveries: Mapping[str, DataFrame], token: str | None = None, time: str | None = None) -> DataFrame:
        """Take in a frame for each table, each with an ``ingestion`` column; returns the manifest rows that were added.

        A delivery need not have rows in every table. Repeating an attempt adds nothing. Deliveries that refer to each other's rows come one
        after the other, since what arrives with another delivery is not published yet.
        """
        if absent := [spec.name for spec in self.document.tables if spec.name not in deliveries]:
            raise DocumentError(f"no data for tables {absent}")
        time = time or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None).isoformat(sep=" ")
        token = token or time
        done = self.manifest().where(F.col("uid") == self.uid_of(F.col("ingestion"), token)).select("ingestion")
        frames = {spec.name: deliveries[spec.name].withColumn("ingestion", F.col("ingestion").cast("string")) for spec in self.document.tables}
        batch = token
        if earlier := done.count():
            frames = {name: frame.join(done, "ingestion", "left_anti") for name, frame in frames.items()}
            if all(frame.isEmpty() for frame in frames.values()):
                return self.spark.createDataFrame([], MANIFEST_DDL)
            batch = f"{token} after {earlier}"

        staged = {name: self.table(name).stage(frame, token, batch) for name, frame in frames.items()}
        parts = [report.select("ingestion", F.lit(name).alias("table"), *[c for c in report.columns if c != "ingestion"])
                 for name, (report, _) in staged.items()]
        # Nothing where the frame itself was refused.
        written = {name: folder and self.table(name).written(frames[name], folder) for name, (_, folder) in staged.items()}
        for spec in self.document.tables:
            if spec.keys() and written[spec.name] is not None:
                counts = key_counts(written[spec.name], spec.keys(), ["ingestion"])
                parts.append(result_rows(counts, spec.name, ",".join(spec.keys()), "key_unique", None, ["ingestion"]))
        arriving = reduce(DataFrame.union, [frame.select("ingestion") for frame in written.values() if frame is not None],
                          self.spark.createDataFrame([], "ingestion string")).distinct()
        for (child, column), (parent, key) in (self.links if self.links is not None else links_of(self.document)).items():
            if written[child] is not None and written[parent] is not None:
                # A delivery that arrives again takes the place of what it published before.
                there = self.read_table(parent).join(arriving, "ingestion", "left_anti")
                counts = references_by_delivery(written[child], names_of(column), there, written[parent], names_of(key))
                label = f"{parent}.{','.join(names_of(key))}"
                parts.append(result_rows(counts, child, ",".join(names_of(column)), "reference", label, ["ingestion"]))
        verdicts = self._report(reduce(DataFrame.unionByName, parts), token, batch, time)

        found = [self.table(name).hashed(verdicts, folder) for name, (_, folder) in staged.items()]
        whole = reduce(DataFrame.unionByName, found).groupBy("uid").agg(
            F.lit(f"{self.root}/tables").alias("path"), F.sum("files").alias("files"), F.sum("bytes").alias("bytes"),
            F.sum(F.col("digest").cast("decimal(38,0)")).cast("string").alias("digest"))
        columns = sum(len(frame.columns) - 1 for frame in deliveries.values())
        return self._commit(manifest_rows(verdicts, whole, columns, time), token)

    def read_table(self, name: str) -> DataFrame:
        """The published rows of one table: of every delivery the newest accepted attempt."""
        accepted = latest(self.manifest().where("status = 'accepted'")).select("ingestion", F.col("uid").alias(ATTEMPT))
        return self.table(name).attempts(accepted)

    def read(self) -> DataFrame:
        raise DocumentError("a relational dataset is read table by table: use read_table")
