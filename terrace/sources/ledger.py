"""Incremental discovery by a ledger: a table of the files that were ingested, and a listing that is anti-joined with it.

A stream's checkpoint remembers paths for ever and nothing else. The ledger knows each file's path, length and time, so a
file that was replaced under its name is found and loaded again, the state is a table that can be queried, compacted or
corrected, and a load can be repeated exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from terrace.sinks import fs
from terrace.sinks.tables import read_batches, write_batch

SCHEMA = "path string, length long, modified timestamp, batch long"
WRITER = "ledger"


class FileLedger:
    """The files of one feed that were ingested. One loader at a time."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def rows(self) -> DataFrame:
        """Every version of every file that was ingested, and with which batch."""
        return read_batches(self.spark, self.path, StructType.fromDDL(SCHEMA))

    def listing(self, folder: str, glob: str) -> DataFrame:
        """What lies in a folder now. Contents are not read: their column is pruned."""
        files = self.spark.read.format("binaryFile").options(pathGlobFilter=glob, recursiveFileLookup=True).load(folder)
        return files.filter("length > 0").select("path", "length", F.col("modificationTime").alias("modified"))

    def pending(self, folder: str, glob: str) -> DataFrame:
        """Files that were never ingested as they are now; ``replaced`` tells those whose path was."""
        known = self.rows()
        fresh = self.listing(folder, glob).join(known.drop("batch"), ["path", "length", "modified"], "left_anti")
        seen = known.select("path").distinct().withColumn("replaced", F.lit(True))
        return fresh.join(seen, "path", "left").withColumn("replaced", F.coalesce("replaced", F.lit(False)))

    def next_batch(self) -> int:
        names = [c.rsplit("-", 1)[1] for c in fs.children(self.spark, self.path) if c.startswith("batch_id=")]
        return 1 + max((int(n) for n in names), default=-1)

    def load(self, folder: str, glob: str, at_once: int, work: Callable[[list[str], int, str], None]) -> int:
        """Give pending files to ``work(paths, batch_id, writer)``, ``at_once`` of them at a time, in order of their paths, and
        note each batch after its work. Work that was done but not noted is done again under the same id, which it has to replace.
        Only one batch's paths pass through the driver. Returns the number of batches."""
        done = 0
        while batch := self.pending(folder, glob).orderBy("path").limit(at_once).drop("replaced").collect():
            number = self.next_batch()
            work([r["path"] for r in batch], number, WRITER)
            noted = self.spark.createDataFrame([(*r, number) for r in batch], SCHEMA)
            write_batch(noted.coalesce(1), self.path, number, WRITER)
            done += 1
        return done
