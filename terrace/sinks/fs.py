"""Small file-system helpers over the Hadoop API that Spark itself uses, so that any store works.

They handle metadata only (listings, manifests, header lines), never table data.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _open(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names directly below ``path``; none if it does not exist."""
    fs, p = _open(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _open(spark, path)
    fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _open(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


#: Bytes within which a header line must end.
LONGEST_LINE = 1 << 20


def first_line(spark: SparkSession, path: str) -> str | None:
    """The first line of a text file, None if the file is empty. Reads a buffer, never the file: a file without a
    line break within ``LONGEST_LINE`` bytes is an error."""
    fs, p = _open(spark, path)
    stream = fs.open(p)
    try:
        held = b""
        for size in (1 << 16, LONGEST_LINE - (1 << 16)):
            more = bytes(stream.readNBytes(size))
            held += more
            if b"\n" in held or len(more) < size:
                return held.split(b"\n", 1)[0].removesuffix(b"\r").decode("utf-8", "replace") if held else None
        raise ValueError(f"no line break in the first {LONGEST_LINE} bytes of {path}")
    finally:
        stream.close()


def write_text_once(spark: SparkSession, path: str, text: str) -> None:
    """Create a file all at once (written aside, then renamed); fail if it exists already."""
    fs, target = _open(spark, path)
    _, aside = _open(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(aside, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    if fs.exists(target) or not fs.rename(aside, target):
        fs.delete(aside, False)
        raise FileExistsError(path)
