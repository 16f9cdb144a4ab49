"""Starting streams: triggers, table sinks, micro-batch upserts."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from terrace.sinks.snapshot import SnapshotTable

DRAIN = {"availableNow": True}


def every(interval: str = "30 seconds") -> dict[str, str]:
    return {"processingTime": interval}


@contextmanager
def off_heap_state(spark: SparkSession, changelog: bool = True) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB on the executors' disks, not in the JVM heap. With ``changelog``
    a batch uploads what changed instead of whole snapshots. A checkpoint keeps the provider it began with."""
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": str(changelog).lower(),
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def state_report(query: StreamingQuery) -> list[dict]:
    """For each stateful operator of the last micro-batch: its name, rows and bytes held, rows dropped as late."""
    progress = query.lastProgress
    found = json.loads(progress.json if hasattr(progress, "json") else json.dumps(progress))["stateOperators"] if progress else []
    names = {"operatorName": "operator", "numRowsTotal": "rows", "memoryUsedBytes": "bytes", "numRowsDroppedByWatermark": "late"}
    return [{new: o.get(old) for old, new in names.items()} for o in found]


def finish(query: StreamingQuery, trigger: dict, timeout: float | None = None) -> StreamingQuery:
    """Wait for a draining query to end; leave a continuous one running."""
    if "availableNow" in trigger:
        if timeout is None:
            query.awaitTermination()
        elif not query.awaitTermination(timeout):
            query.stop()
            raise TimeoutError(f"stream did not drain within {timeout} s")
    return query


def append_to_table(df: DataFrame, table: str, path: str, checkpoint: str, trigger: dict = DRAIN) -> StreamingQuery:
    """Append a stream to a table, exactly once."""
    return (
        df.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .option("path", path)
        .trigger(**trigger)
        .toTable(table)
    )


def per_batch(
    df: DataFrame,
    work: Callable[[DataFrame, int, str], None],
    checkpoint: str,
    trigger: dict = DRAIN,
    mode: str = "append",
) -> StreamingQuery:
    """Call ``work(batch, batch_id, writer)`` per micro-batch. ``writer`` identifies the checkpoint:
    batch ids start again at 0 when a stream is given a new one."""

    def call(batch: DataFrame, batch_id: int) -> None:
        work(batch, batch_id, batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "")

    return (
        df.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .foreachBatch(call)
        .start()
    )


def upsert_into(
    df: DataFrame, target: SnapshotTable, checkpoint: str, trigger: dict = DRAIN, mode: str = "update"
) -> StreamingQuery:
    """Upsert every micro-batch; in update mode a window is sent again whenever it changes."""
    return per_batch(df, lambda batch, i, writer: target.upsert(batch, i, writer), checkpoint, trigger, mode)
