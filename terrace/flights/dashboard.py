"""The delay dashboard: one dataset and the queries of its widgets.

All widgets are counts and means over (day, month, carrier, airport, hour). The fact is therefore
reduced once to *tiles* on its foreign keys and hour, and the dimensions are joined to the tiles: one
scan of the fact, no shuffle of fact rows, and joins whose size does not grow with the fact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.functions import mean
from terrace.operators.reports import choices, chosen, cross_tab, totals
from terrace.operators.star import roll_up
from terrace.spec import Measure

TILE = ("date_key", "carrier_code", "origin_airport_code", "crs_dep_hour")

#: The fact columns that ``flight_rows`` reads.
ROW_COLUMNS = (*TILE, "is_cancelled", "is_arr_delayed_15", "arr_delay_min")

TILE_MEASURES = (
    Measure("flights", "count(*)"),
    Measure("cancelled", "count_if(is_cancelled)"),
    Measure("arrived", "count(arr_delay_min)"),
    Measure("on_time", "count_if(not is_arr_delayed_15)"),
    Measure("arr_delay_total", "sum(arr_delay_min)"),
)

SUMS = {m.name: m.name for m in TILE_MEASURES}


def flight_rows(fact: DataFrame, dim_date: DataFrame, dim_carrier: DataFrame) -> DataFrame:
    """The dashboard dataset, one row per flight, for users who want rows rather than tiles."""
    dates = dim_date.select("date_key", "date", "month", "month_name")
    joined = fact.join(dates, "date_key").join(dim_carrier, "carrier_code")
    return joined.select(
        "date",
        "month",
        "month_name",
        "carrier_name",
        F.col("origin_airport_code").alias("origin_airport"),
        "crs_dep_hour",
        F.expr("if(is_cancelled, 100.0D, 0.0D)").alias("cancelled_pct"),
        F.expr("if(arr_delay_min is null, null, if(is_arr_delayed_15, 0.0D, 100.0D))").alias("on_time_pct"),
        "arr_delay_min",
    )


def reduced(fact: DataFrame) -> DataFrame:
    """The fact on its foreign keys and hour, with the sums and counts the widgets need."""
    return roll_up(fact, TILE, TILE_MEASURES)


def tiles(reduced_fact: DataFrame, dim_date: DataFrame, dim_carrier: DataFrame) -> DataFrame:
    """The dataset pre-aggregated to what the widgets can tell apart."""
    dates = dim_date.select("date_key", "date", "month", "month_name")
    return (
        reduced_fact.join(dates, "date_key")
        .join(dim_carrier.select("carrier_code", "carrier_name"), "carrier_code")
        .withColumnRenamed("origin_airport_code", "origin_airport")
    )


def filtered(tile_rows: DataFrame, carriers: Sequence[str] = (), months: Sequence[str] = ()) -> DataFrame:
    return chosen(tile_rows, carrier_name=carriers, month_name=months)


def _share(part: str, whole: str):
    return mean(F.lit(100.0) * F.col(part), F.col(whole))


def kpis(tile_rows: DataFrame) -> DataFrame:
    """The three counters: flights, mean on-time percentage, mean cancelled percentage."""
    summed = totals(tile_rows, [], SUMS)
    return summed.select(
        F.coalesce("flights", F.lit(0)).alias("flights"),
        _share("on_time", "arrived").alias("on_time_pct"),
        _share("cancelled", "flights").alias("cancelled_pct"),
    )


def on_time_trend(tile_rows: DataFrame) -> DataFrame:
    """Mean on-time percentage per day."""
    by_day = tile_rows.withColumn("day", F.date_trunc("DAY", "date"))
    return totals(by_day, ["day"], SUMS).select("day", _share("on_time", "arrived").alias("on_time_pct")).orderBy("day")


def delay_by_carrier(tile_rows: DataFrame) -> DataFrame:
    """Mean arrival delay per carrier, longest first."""
    return (
        totals(tile_rows, ["carrier_name"], SUMS)
        .select("carrier_name", mean(F.col("arr_delay_total"), F.col("arrived")).alias("avg_arr_delay"))
        .orderBy(F.desc_nulls_last("avg_arr_delay"), "carrier_name")
    )


def flights_by_airport_and_hour(tile_rows: DataFrame) -> DataFrame:
    """Flights per origin and scheduled hour, long form: only combinations that occur."""
    return totals(tile_rows, ["origin_airport", "crs_dep_hour"], {"flights": "flights"})


def airport_hour_grid(tile_rows: DataFrame, hours: Sequence[int] = tuple(range(24))) -> DataFrame:
    """The same as a grid with one column per hour; unusual hours such as 24 are in ``hour_other``."""
    return cross_tab(tile_rows, "origin_airport", "crs_dep_hour", hours, "flights", "hour_")


def carrier_choices(tile_rows: DataFrame) -> DataFrame:
    return choices(tile_rows, "carrier_name")


def month_choices(tile_rows: DataFrame) -> DataFrame:
    return choices(tile_rows, "month_name")
