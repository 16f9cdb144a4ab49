"""What the operators share: the cluster's shared folder, reading tables, slicing Arrow batches."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at a time inside a task, in bytes. A longer document is a slice of its own.
SLICE_BYTES = 4_000_000


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``. Only where that is unset (single-machine tests)
    the session's warehouse folder takes its place."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    return f"{base.rstrip('/')}/llm/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The same rows, written once to the shared folder: lost executors cost nothing that was written."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, each with underscores ahead until no column of ``df`` has it, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return tuple(out)


def spread(df: DataFrame) -> DataFrame:
    """A table of few files and few row groups is read by few tasks; heavy work on each row is then dealt
    over the cores. Asks Spark for a rebalance only, which never changes the rows."""
    return df.hint("rebalance")


def crc32_of_id(column: str = "doc_id"):
    """crc32 of an id's decimal text; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(0))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose ``column`` holds about ``limit`` bytes at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        first, held = 0, 0
        for row, size in enumerate(sizes.tolist()):
            if held and held + size > limit:
                yield batch.slice(first, row - first)
                first, held = row, 0
            held += size
        yield batch.slice(first)


def ship(spark: SparkSession) -> None:
    """Give this library to the executors' Python, once for each application, as any job does with --py-files."""
    context = spark.sparkContext
    if getattr(context, "_terrace_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='terrace-')}/terrace", "zip", root, "terrace")
    context.addPyFile(archive)
    context._terrace_shipped = True


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)
