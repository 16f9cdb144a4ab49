"""Names and paths of one lake, and its namespaces."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

LAYERS = ("landing", "bronze", "silver", "gold", "meta")


@dataclass(frozen=True)
class Lake:
    """Everything hangs off one root folder (any file system Spark reaches) and one catalog.

    ``prefix`` goes before schema names, so that several lakes can share a catalog.
    """

    root: str
    catalog: str = "spark_catalog"
    prefix: str = ""

    def schema(self, layer: str) -> str:
        if layer not in LAYERS:
            raise ValueError(f"unknown layer {layer!r}; expected one of {', '.join(LAYERS)}")
        return f"{self.catalog}.{self.prefix}{layer}"

    def table(self, layer: str, name: str) -> str:
        return f"{self.schema(layer)}.{name}"

    def path(self, layer: str, *parts: str) -> str:
        self.schema(layer)
        return "/".join([self.root.rstrip("/"), layer, *parts])

    def landing(self, feed: str) -> str:
        return self.path("landing", feed)

    def checkpoint(self, *parts: str) -> str:
        return self.path("meta", "checkpoints", *parts)

    def gold(self, name: str) -> str:
        return self.table("gold", name)


def create_schemas(spark: SparkSession, lake: Lake) -> list[str]:
    """Create the namespaces of a lake. Safe to repeat."""
    for layer in LAYERS:
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS {lake.schema(layer)} LOCATION '{lake.path(layer)}'")
    return [lake.schema(layer) for layer in LAYERS]


def scratch(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for intermediate tables, in the shared folder that the cluster names.

    ``spark.checkpoint.dir`` must be reachable from every executor; nothing here is kept on the local
    disk of one machine, so lost executors cost no recomputation of what was already written.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/terrace/{purpose}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write a DataFrame with several consumers once, as parquet, and read it back: consumers then
    scan only their columns, and the lineage is cut."""
    path = scratch(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
