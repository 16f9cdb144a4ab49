"""Small static lookup tables, and the left join that uses them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def inline_lookup(spark: SparkSession, entries: Mapping[str, str], key: str, value: str) -> DataFrame:
    """A lookup from a Python mapping.

    It is one row of literals expanded in place, so the planner knows that it is tiny (a DataFrame
    made from a Python list has no size estimate and would be joined by a shuffle of both sides).
    """
    pairs = [F.struct(F.lit(k).alias(key), F.lit(v).alias(value)) for k, v in entries.items()]
    return spark.range(1).select(F.inline(F.array(*pairs)))


def unique_lookup(lookup: DataFrame, key: str, value: str) -> DataFrame:
    """The (key, value) pairs of any DataFrame; the running job fails if a key occurs twice."""
    once = lookup.groupBy(key).agg(F.first(value).alias(value), F.count("*").alias("_copies"))
    message = F.concat(F.lit(f"lookup key {key} is not unique: "), F.col(key).cast("string"))
    return once.filter(F.assert_true(F.col("_copies") == 1, message).isNull()).select(key, value)


def look_up(df: DataFrame, lookup: DataFrame, key: str, value: str, default: Column | None = None) -> DataFrame:
    """Left join that never adds or loses rows; unmatched rows get ``default`` (NULL if none).

    No broadcast hint: Spark broadcasts the lookup when its estimated or measured size is below
    ``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffles, splitting skewed keys.
    """
    joined = df.join(lookup.select(key, value), key, "left")
    return joined if default is None else joined.withColumn(value, F.coalesce(F.col(value), default))
