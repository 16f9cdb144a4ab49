"""The three-hop event job: raw events, deduplicated events, live windows."""

from __future__ import annotations

from contextlib import nullcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from terrace.lake import Lake, create_schemas
from terrace.sinks.snapshot import SnapshotTable
from terrace.sinks.tables import name_for_sql
from terrace.sources.files import text_events
from terrace.streaming.events import WINDOW_KEY, airport_delays, dedupe_events, parse_events
from terrace.streaming.late import LateSplit
from terrace.streaming.run import DRAIN, append_to_table, finish, off_heap_state, per_batch

RAW = "flight_events_raw"
EVENTS = "flight_events"
WINDOWS = "live_airport_delays"


def live_windows(spark: SparkSession, lake: Lake) -> SnapshotTable:
    return SnapshotTable(spark, lake.path("gold", WINDOWS), WINDOW_KEY, ("window_start", "day"), check_keys=False)


def land_events(source: DataFrame, lake: Lake, trigger: dict = DRAIN) -> StreamingQuery:
    """Hop 1: event bodies as they are, plus arrival time."""
    arrived = source.withColumn("_ingest_ts", F.current_timestamp())
    return append_to_table(
        arrived, lake.table("bronze", RAW), lake.path("bronze", RAW), lake.checkpoint("events", "bronze"), trigger
    )


def _valid(spark: SparkSession, lake: Lake) -> DataFrame:
    return parse_events(spark.readStream.table(lake.table("bronze", RAW)))


def late_events(spark: SparkSession, lake: Lake) -> LateSplit:
    """Valid events by whether they came within ten minutes of the latest one seen before."""
    return LateSplit(spark, lake.path("silver", f"{EVENTS}_by_lateness"))


def refine_events(spark: SparkSession, lake: Lake, trigger: dict = DRAIN, spread: int = 0) -> StreamingQuery:
    """Hop 2: parse, validate, drop repeats."""
    raw = spark.readStream.table(lake.table("bronze", RAW))
    return append_to_table(
        dedupe_events(parse_events(raw), spread=spread),
        lake.table("silver", EVENTS),
        lake.path("silver", EVENTS),
        lake.checkpoint("events", "silver"),
        trigger,
    )


def publish_windows(spark: SparkSession, lake: Lake, trigger: dict = DRAIN) -> StreamingQuery:
    """Hop 3: windows per airport, upserted whenever they change."""
    events = spark.readStream.table(lake.table("silver", EVENTS))
    target = live_windows(spark, lake)

    def upsert_and_name(batch: DataFrame, batch_id: int, writer: str) -> None:
        target.upsert(batch, batch_id, writer)
        if target.exists():
            name_for_sql(spark, lake.gold(WINDOWS), target.folders(), target.schema())

    return per_batch(airport_delays(events), upsert_and_name, lake.checkpoint("events", "gold"), trigger, "update")


def run_events(
    spark: SparkSession, lake: Lake, source: DataFrame | None = None, trigger: dict = DRAIN, timeout: float | None = None,
    spread: int = 0, files_per_batch: int | None = None, off_heap: bool = False, keep_late: bool = False,
) -> list[StreamingQuery]:
    """Run the hops. When draining, each ends before the next begins; otherwise all three keep running,
    each with its own checkpoint, until stopped. The default source is the landing folder, ``files_per_batch`` files at a time.
    ``off_heap`` keeps state in RocksDB; ``keep_late`` also splits valid events into on-time and late ones (:func:`late_events`).
    ``spread``: slices of the first pass that removes repeats of an event a source sends very often."""
    create_schemas(spark, lake)
    source = text_events(spark, lake.landing("events"), per_batch=files_per_batch) if source is None else source
    hops = (
        lambda: land_events(source, lake, trigger),
        lambda: refine_events(spark, lake, trigger, spread),
        lambda: publish_windows(spark, lake, trigger),
    )
    if keep_late:
        hops = (*hops, lambda: late_events(spark, lake).start(_valid(spark, lake), lake.checkpoint("events", "late"), trigger))
    with off_heap_state(spark) if off_heap else nullcontext():
        return [finish(start(), trigger, timeout) for start in hops]
