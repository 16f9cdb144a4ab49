"""Report operators over rollups: ratios, weighted top-k, period change, tiles, pivots, filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.functions import mean


def totals(df: DataFrame, by: Sequence[str], sums: Mapping[str, str]) -> DataFrame:
    """Sum columns per group: ``sums`` maps output names to input columns."""
    return df.groupBy(*by).agg(*[F.sum(c).alias(name) for name, c in sums.items()])


def named_totals(
    df: DataFrame, key: str, names: DataFrame, name: str, sums: Mapping[str, str]
) -> DataFrame:
    """Totals per dimension name. The input is reduced to one row per key before it meets the
    dimension, so the join is small whatever the input size; equal names are then merged."""
    per_key = totals(df, [key], sums).join(names.select(key, name), key)
    return totals(per_key, [name], {s: s for s in sums})


def weighted_top(
    df: DataFrame,
    group: Column,
    group_name: str,
    rows: str,
    value: str,
    weight: str,
    at_least: int,
    k: int,
    digits: int = 1,
) -> DataFrame:
    """The ``k`` groups with the largest weighted mean of ``value`` among those with enough rows.

    The products are summed as decimals (``value`` is rounded to two places already), so the result
    does not depend on the order of addition. Equal means are ordered by group name.
    """
    product = F.col(value).cast("decimal(18,2)") * F.col(weight).cast("decimal(18,0)")
    grouped = df.groupBy(group.alias(group_name)).agg(
        F.sum(rows).alias(rows),
        F.sum(product).cast("double").alias("_product"),
        F.sum(weight).alias("_weight"),
    )
    return (
        grouped.filter(F.col(rows) >= at_least)
        .select(group_name, rows, F.round(mean(F.col("_product"), F.col("_weight")), digits).alias(value))
        .orderBy(F.desc_nulls_last(value), group_name)
        .limit(k)
    )


def change_from_previous(df: DataFrame, series: str, order: str, value: str, name: str) -> DataFrame:
    """Difference to the previous present row of each series; NULL on the first.

    Meant for rollups: a series then holds one row per period, however many rows were rolled up.
    """
    previous = F.lag(value).over(Window.partitionBy(series).orderBy(order))
    return df.withColumn(name, F.col(value) - previous)


def chosen(df: DataFrame, **selections: Sequence) -> DataFrame:
    """Multi-select filters: keep rows whose column is among the values; no values, no restriction."""
    for column, values in selections.items():
        if values:
            df = df.filter(F.col(column).isin(list(values)))
    return df


def choices(df: DataFrame, column: str) -> DataFrame:
    """The values a multi-select filter offers."""
    return df.select(column).distinct().orderBy(column)


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def cross_tab(df: DataFrame, row: str, column: str, values: Sequence[int], count: str, prefix: str) -> DataFrame:
    """Sum of ``count`` with one output row per ``row`` and one column per listed value of ``column``.

    Values outside the list are summed into ``<prefix>other``, so row totals stay whole.
    """
    cells = [
        F.sum(F.when(F.col(column) == v, F.col(count)).otherwise(0)).alias(f"{prefix}{v}") for v in values
    ]
    listed = F.coalesce(F.col(column).isin(list(values)), F.lit(False))
    other = F.sum(F.when(~listed, F.col(count)).otherwise(0)).alias(f"{prefix}other")
    return df.groupBy(row).agg(*cells, other)
