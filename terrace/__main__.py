"""Command line for spark-submit: ``python -m terrace batch --root hdfs:///lakes/flights``."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from terrace.lake import Lake
from terrace.plans.batch import run_batch
from terrace.plans.events import run_events
from terrace.sources.kafka import kafka_events, kafka_options
from terrace.streaming.run import DRAIN, every


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="terrace", description="Run the jobs of a lake.")
    parser.add_argument("job", choices=["batch", "events"])
    parser.add_argument("--root", required=True, help="lake folder, reachable from all executors")
    parser.add_argument("--catalog", default="spark_catalog")
    parser.add_argument("--prefix", default="", help="put before schema names")
    parser.add_argument("--every", metavar="INTERVAL", help="keep the event job running, e.g. '30 seconds'")
    parser.add_argument("--incremental", action="store_true", help="maintain gold from what changed in silver instead of rebuilding it")
    parser.add_argument("--ledger", action="store_true", help="remember ingested files in a table and reload replaced ones")
    parser.add_argument("--newer-wins", action="store_true", help="ignore late copies that are older than the stored row")
    parser.add_argument("--files-per-batch", type=int, help="files of a micro-batch, at most")
    parser.add_argument("--bytes-per-batch", help="bytes of a silver micro-batch, e.g. 64g")
    parser.add_argument("--spread", type=int, default=0, help="slices of the first pass against repeated events")
    parser.add_argument("--off-heap", action="store_true", help="keep stream state in RocksDB")
    parser.add_argument("--keep-late", action="store_true", help="also split events into on-time and late ones")
    parser.add_argument("--broker-namespace", help="read events from this broker instead of the landing folder")
    parser.add_argument("--broker-topic", help="its topic")
    parser.add_argument("--broker-secret-env", metavar="NAME", help="environment variable that holds its connection string")
    args = parser.parse_args(argv)
    broker = (args.broker_namespace, args.broker_topic, args.broker_secret_env)
    if any(broker) and not all(broker):
        parser.error("a broker needs --broker-namespace, --broker-topic and --broker-secret-env")
    return args


def main(argv: list[str] | None = None) -> None:
    args = arguments(argv)
    spark = SparkSession.builder.appName(f"terrace {args.job}").getOrCreate()
    lake = Lake(args.root, args.catalog, args.prefix)
    if args.job == "batch":
        for name, report in run_batch(
            spark, lake, args.incremental, args.newer_wins, args.files_per_batch or 10_000, args.bytes_per_batch, args.ledger
        ).items():
            print(name)
            report.show(50, truncate=False)
        return
    source = None
    if args.broker_topic:
        secret = os.environ[args.broker_secret_env]
        source = kafka_events(spark, kafka_options(args.broker_namespace, args.broker_topic, secret))
    trigger = every(args.every) if args.every else DRAIN
    run_events(
        spark, lake, source, trigger, spread=args.spread, files_per_batch=args.files_per_batch, off_heap=args.off_heap, keep_late=args.keep_late
    )
    if args.every:
        spark.streams.awaitAnyTermination()


if __name__ == "__main__":
    main()
