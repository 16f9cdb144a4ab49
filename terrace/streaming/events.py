"""Event operators. Each works the same on a batch and on a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from terrace.operators.clean import REASON, any_failed, reasons
from terrace.spec import Measure, Rule, one_of, required

# The event body and the statuses that count.
EVENT_SCHEMA = (
    "event_id string, event_ts timestamp, carrier_code string, flight_number string, "
    "origin_airport string, dest_airport string, status string, delay_min int"
)
STATUSES = ("DEPARTED", "ARRIVED", "CANCELLED")

EVENT_RULES = (
    required("event_id"),
    required("event_ts"),
    required("origin_airport", "missing_origin"),
    one_of("status", STATUSES, "bad_status"),
)

EVENT_KEY = ("event_id", "event_ts")
WINDOW_KEY = ("window_start", "origin_airport")

WINDOW_MEASURES = (
    Measure("departures", "count_if(status = 'DEPARTED')"),
    Measure("cancellations", "count_if(status = 'CANCELLED')"),
    Measure("avg_dep_delay_min", "round(avg(delay_min) filter (where status = 'DEPARTED'), 2)"),
    Measure("max_dep_delay_min", "max(delay_min) filter (where status = 'DEPARTED')"),
)


def typed_events(raw: DataFrame, body: str = "body", schema: str = EVENT_SCHEMA) -> DataFrame:
    """JSON text to columns. Malformed text gives NULLs throughout, a mistyped field only its own.

    The parsed struct is unfolded by a generator. Plain field access would let the optimizer merge the
    validity filter with the parsing, and every field that the filter tests would parse the text again.
    """
    parsed = F.from_json(F.col(body), schema)
    return raw.select(F.inline(F.array(parsed)), F.col(body).alias("_body"))


def split_events(
    raw: DataFrame, body: str = "body", schema: str = EVENT_SCHEMA, rules: Sequence[Rule] = EVENT_RULES
) -> tuple[DataFrame, DataFrame]:
    """(valid events, refused events with their body and reasons)."""
    typed = typed_events(raw, body, schema)
    valid = typed.filter(~any_failed(rules)).drop("_body")
    refused = typed.filter(any_failed(rules)).select(F.col("_body").alias(body), reasons(rules).alias(REASON))
    return valid, refused


def parse_events(raw: DataFrame, body: str = "body") -> DataFrame:
    return split_events(raw, body)[0]


def _on_clock(df: DataFrame, column: str, watermark: str | None) -> DataFrame:
    """Attach a watermark. A stream needs an instant for that, so a zoneless time is converted."""
    if isinstance(df.schema[column].dataType, TimestampNTZType):
        df = df.withColumn(column, F.col(column).cast("timestamp"))
    return df.withWatermark(column, watermark) if watermark else df


def dedupe_events(
    events: DataFrame, watermark: str | None = "10 minutes", key: Sequence[str] = EVENT_KEY, spread: int = 0
) -> DataFrame:
    """Drop repeats of (id, time). The watermark bounds how long ids are remembered, so the event time,
    the last key column, must be part of the key.

    On a stream every copy of an id goes to one state partition. If a source repeats one event very
    often, ``spread`` puts a first pass in front that removes repeats in that many slices of the
    input; the second pass, which decides, then sees at most ``spread`` copies. The outcome is the same.
    """
    timed = _on_clock(events, key[-1], watermark)
    if spread:
        slice_of = F.floor(F.rand(0) * spread).cast("int")
        timed = timed.withColumn("_slice", slice_of).dropDuplicates([*key, "_slice"]).drop("_slice")
    return timed.dropDuplicates(list(key))


def windowed(
    events: DataFrame,
    by: Sequence[str],
    measures: Sequence[Measure],
    time: str = "event_ts",
    window: str = "5 minutes",
    watermark: str | None = "10 minutes",
) -> DataFrame:
    """Aggregate per tumbling window and group. ``watermark=None`` when the input already has one."""
    timed = _on_clock(events, time, watermark)
    grouped = timed.groupBy(F.window(time, window).alias("w"), *by).agg(
        *[F.expr(m.sql).alias(m.name) for m in measures]
    )
    return grouped.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, *[m.name for m in measures]
    )


def airport_delays(
    events: DataFrame, window: str = "5 minutes", watermark: str | None = "10 minutes"
) -> DataFrame:
    """Departures, cancellations and departure delays per origin airport and window."""
    return windowed(events, ["origin_airport"], WINDOW_MEASURES, window=window, watermark=watermark)


def latest_windows(windows: DataFrame, k: int = 50) -> DataFrame:
    return windows.orderBy(F.desc("window_start"), F.desc("departures"), "origin_airport").limit(k)
