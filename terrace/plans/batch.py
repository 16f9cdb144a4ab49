"""The batch jobs: files to bronze, bronze to silver, silver to gold, and their ordered run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType, TimestampType

from terrace.flights import model
from terrace.flights.contract import FLIGHTS
from terrace.lake import Lake, create_schemas
from terrace.operators.clean import accepted, rejected, safe_names
from terrace.operators.quality import enforce, file_counts, gate, reconcile
from terrace.sinks.snapshot import SnapshotTable
from terrace.plans.refresh import Gold
from terrace.sinks import fs
from terrace.sinks.tables import interleaved, name_for_sql, publish, read_batches, stage_gold, write_batch
from terrace.sources.files import RESCUED, headers_of, listed_headers, new_files, pin_columns, pinned_columns, read_with_rescue
from terrace.sources.ledger import FileLedger
from terrace.spec import TableSpec
from terrace.streaming.run import DRAIN, finish, per_batch

FEED = "flights"


def bronze_path(lake: Lake, feed: str = FEED) -> str:
    return lake.path("bronze", f"{feed}_raw")


def quarantine_path(lake: Lake, feed: str = FEED) -> str:
    return lake.path("silver", f"{feed}_quarantine")


def column_store(lake: Lake, feed: str = FEED) -> str:
    return lake.path("meta", "schemas", feed)


def silver_table(
    spark: SparkSession, lake: Lake, spec: TableSpec = FLIGHTS, feed: str = FEED, newer_wins: bool = False
) -> SnapshotTable:
    return SnapshotTable(
        spark,
        lake.path("silver", feed),
        spec.key,
        partition_by=(spec.key[0], "month"),
        newest=spec.arrival if newer_wins else None,
        check_keys=False,
    )


def bronze_schema(spark: SparkSession, lake: Lake, feed: str = FEED) -> StructType:
    """Bronze is text plus lineage; its columns were pinned by the first ingest."""
    columns = pinned_columns(spark, column_store(lake, feed))
    if columns is None:
        raise FileNotFoundError(f"no file of feed {feed!r} was ingested yet")
    columns = safe_names(columns)
    text = [StructField(c, StringType()) for c in [*columns, RESCUED]]
    return StructType([*text, StructField("_ingest_ts", TimestampType()), StructField("_source_file", StringType())])


def bronze_rows(spark: SparkSession, lake: Lake, feed: str = FEED) -> DataFrame:
    return read_batches(spark, bronze_path(lake, feed), bronze_schema(spark, lake, feed))


def quarantine_rows(spark: SparkSession, lake: Lake, spec: TableSpec = FLIGHTS, feed: str = FEED) -> DataFrame:
    nothing = spark.createDataFrame([], bronze_schema(spark, lake, feed))
    return read_batches(spark, quarantine_path(lake, feed), rejected(nothing, spec).schema)


def name_layers(spark: SparkSession, lake: Lake, spec: TableSpec = FLIGHTS, feed: str = FEED) -> list[str]:
    """SQL names for what bronze, silver and quarantine hold now: views over their folders. Returns the names."""
    schema = bronze_schema(spark, lake, feed)
    refused = rejected(spark.createDataFrame([], schema), spec).schema
    target = silver_table(spark, lake, spec, feed)
    named = {lake.table("bronze", f"{feed}_raw"): (bronze_path(lake, feed), schema)}
    named[lake.table("silver", f"{feed}_quarantine")] = (quarantine_path(lake, feed), refused)
    for name, (path, columns) in named.items():
        held = any(c.startswith("batch_id=") for c in fs.children(spark, path))
        name_for_sql(spark, name, [path] if held else [], columns)
    if target.exists():
        name_for_sql(spark, lake.table("silver", feed), target.folders(), target.schema())
        return [*named, lake.table("silver", feed)]
    return list(named)


def file_ledger(spark: SparkSession, lake: Lake, feed: str = FEED) -> FileLedger:
    return FileLedger(spark, lake.path("meta", "ledgers", feed))


def run_bronze(
    spark: SparkSession, lake: Lake, feed: str = FEED, glob: str = "*.csv", files_per_batch: int = 10_000,
    columns: Sequence[str] | None = None, by_ledger: bool = False,
) -> DataFrame:
    """Ingest files not seen before, as text, with lineage. Returns rows per source file.

    The first run fixes the columns: those given, or those of all files that lie there then, whatever the batches.
    Only paths and header lines pass through the driver, ``files_per_batch`` of them at a time. ``by_ledger`` keeps a table
    of ingested files instead of a stream's checkpoint, and ingests a file again that was replaced; a feed has to stay with one way.
    """
    store = column_store(lake, feed)
    if pinned_columns(spark, store) is None and fs.exists(spark, lake.landing(feed)):
        headers = [tuple(columns)] if columns else list(listed_headers(spark, lake.landing(feed), glob, files_per_batch))
        if headers:
            pin_columns(spark, store, headers)

    def take(paths: list[str], batch_id: int, writer: str) -> None:
        headers = headers_of(spark, paths)
        if headers:
            pinned = pin_columns(spark, store, headers.values())
            write_batch(read_with_rescue(spark, headers, pinned), bronze_path(lake, feed), batch_id, writer)

    if by_ledger:
        file_ledger(spark, lake, feed).load(lake.landing(feed), glob, files_per_batch, take)
        return file_counts(bronze_rows(spark, lake, feed))
    found = new_files(spark, lake.landing(feed), glob, files_per_batch)
    ingest = lambda batch, i, writer: take(sorted(r["path"] for r in batch.collect()), i, writer)
    finish(per_batch(found, ingest, lake.checkpoint("bronze", feed)), DRAIN)
    return file_counts(bronze_rows(spark, lake, feed))


def run_silver(
    spark: SparkSession,
    lake: Lake,
    spec: TableSpec = FLIGHTS,
    feed: str = FEED,
    newer_wins: bool = False,
    bytes_per_batch: str | None = None,
) -> DataFrame:
    """Clean the bronze rows added since the last run and upsert them; refused rows are quarantined.
    Returns the reconciliation row. ``bytes_per_batch`` bounds a micro-batch on a large backlog."""
    target = silver_table(spark, lake, spec, feed, newer_wins)

    def clean_and_upsert(batch: DataFrame, batch_id: int, writer: str) -> None:
        target.upsert(accepted(batch, spec), batch_id, writer)
        write_batch(rejected(batch, spec), quarantine_path(lake, feed), batch_id, writer)

    reader = spark.readStream.schema(bronze_schema(spark, lake, feed))
    if bytes_per_batch:
        reader = reader.option("maxBytesPerTrigger", bytes_per_batch)
    added = reader.parquet(bronze_path(lake, feed))
    finish(per_batch(added, clean_and_upsert, lake.checkpoint("silver", feed)), DRAIN)
    return reconcile(
        bronze_rows(spark, lake, feed), target.read(), quarantine_rows(spark, lake, spec, feed)
    )


def run_gold(spark: SparkSession, lake: Lake, silver: DataFrame | None = None, partitions: int | None = None) -> DataFrame:
    """Rebuild the star schema from silver beside the published one, check it, and only then publish it; raises
    and leaves the old tables as they are if it is broken. Returns the checks.

    Silver is scanned in full once, for the fact, which is written in its clustered layout at once (two passes over
    its date and carrier come before). The rollup reads the written fact, and the date and carrier dimensions read the rollup, which names
    every date and carrier there is in far fewer rows. Only airports need silver again (six columns).
    """
    silver = silver_table(spark, lake).read() if silver is None else silver
    laid_out = interleaved(model.fact_flights(silver), ["date_key", "carrier_code"], partitions)
    staged: dict[str, tuple[DataFrame, str]] = {}

    def stage(df: DataFrame, name: str) -> DataFrame:
        staged[name] = stage_gold(df, lake, name)
        return staged[name][0]

    fact = stage(laid_out, "fact_flights")
    agg = stage(model.agg_daily_route(fact), "agg_daily_route")
    dimensions = {
        "dim_date": stage(model.dim_date(model.dates_of(agg)), "dim_date"),
        "dim_carrier": stage(model.dim_carrier(agg), "dim_carrier"),
        "dim_airport": stage(model.dim_airport(silver), "dim_airport"),
    }
    report = gate(silver, fact, dimensions, model.REFERENCES)
    checks = spark.createDataFrame(enforce(report), report.schema)
    for name, (frame, place) in staged.items():
        publish(spark, lake.gold(name), frame.schema, place)
    return checks


def refresh_gold(spark: SparkSession, lake: Lake) -> DataFrame:
    """Gold maintained from what changed in silver since the last refresh. Returns the checks of the changed months."""
    return Gold(spark, lake).refresh(silver_table(spark, lake))


def run_batch(
    spark: SparkSession, lake: Lake, incremental: bool = False, newer_wins: bool = False, files_per_batch: int = 10_000,
    bytes_per_batch: str | None = None, by_ledger: bool = False,
) -> dict[str, DataFrame]:
    """Bronze, silver, gold in order; an exception in one stops those after it. ``incremental``: maintain gold instead of rebuilding it."""
    create_schemas(spark, lake)
    reports = {"bronze": run_bronze(spark, lake, files_per_batch=files_per_batch, by_ledger=by_ledger)}
    reports["silver"] = run_silver(spark, lake, newer_wins=newer_wins, bytes_per_batch=bytes_per_batch)
    name_layers(spark, lake)
    return reports | {"gold": refresh_gold(spark, lake) if incremental else run_gold(spark, lake)}
