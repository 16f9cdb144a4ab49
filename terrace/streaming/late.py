"""Late events as a result: which rows came after the watermark had passed them, kept instead of dropped.

Spark's own watermark drops late rows inside stateful operators, uncounted. Here each micro-batch is split before that, by the same
law: a row is late if its time lies before the greatest event time of all earlier batches, less the delay. That greatest time is
the only state: one number a batch, written with the batch's rows, so that a repeated batch is split as it was.
"""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from terrace.sinks import fs
from terrace.sinks.tables import read_batches, write_batch
from terrace.streaming.run import DRAIN, per_batch


class LateSplit:
    """On-time and late rows of a stream, appended exactly once below ``path``."""

    def __init__(self, spark: SparkSession, path: str, time: str = "event_ts", delay: str = "10 minutes") -> None:
        self.spark, self.path, self.time, self.delay = spark, path.rstrip("/"), time, delay

    def _mark(self, writer: str, batch_id: int) -> str:
        return f"{self.path}/marks/{writer or 'any'}-{batch_id:010d}.json"

    def _latest_before(self, writer: str, batch_id: int) -> int | None:
        if batch_id == 0 or not fs.exists(self.spark, self._mark(writer, batch_id - 1)):
            return None
        return json.loads(fs.read_text(self.spark, self._mark(writer, batch_id - 1)))["latest"]

    def split(self, batch: DataFrame, batch_id: int, writer: str = "") -> None:
        """Append a micro-batch. Rows without a time are never late."""
        before = self._latest_before(writer, batch_id)
        moment = F.unix_micros(F.col(self.time).cast("timestamp"))
        late = F.lit(False)
        if before is not None:
            mark = F.unix_micros(F.timestamp_micros(F.lit(before)) - F.expr(f"interval {self.delay}"))
            late = F.coalesce(moment < mark, F.lit(False))
        seen = Observation()
        rows = batch.withColumn("_late", late).observe(seen, F.max(moment).alias("latest"))
        write_batch(rows, f"{self.path}/rows", batch_id, writer)
        latest = [x for x in (before, seen.get.get("latest")) if x is not None]
        if not fs.exists(self.spark, self._mark(writer, batch_id)):
            fs.write_text_once(self.spark, self._mark(writer, batch_id), json.dumps({"latest": max(latest) if latest else None}))

    def start(self, stream: DataFrame, checkpoint: str, trigger: dict = DRAIN) -> StreamingQuery:
        return per_batch(stream, self.split, checkpoint, trigger)

    def _rows(self, schema: StructType, late: bool) -> DataFrame:
        stored = read_batches(self.spark, f"{self.path}/rows", StructType([*schema.fields]).add("_late", "boolean"))
        return stored.filter(F.col("_late") == late).drop("_late")

    def on_time(self, schema: StructType) -> DataFrame:
        return self._rows(schema, False)

    def late(self, schema: StructType) -> DataFrame:
        return self._rows(schema, True)

    def marks(self) -> list[datetime]:
        """The greatest event time after each batch, in order."""
        names = [n for n in fs.children(self.spark, f"{self.path}/marks") if n.endswith(".json")]
        found = [json.loads(fs.read_text(self.spark, f"{self.path}/marks/{n}"))["latest"] for n in names]
        return [datetime.fromtimestamp(x / 1e6) for x in found if x is not None]
