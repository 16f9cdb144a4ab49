"""The five analysis questions over the gold tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.flights.contract import DELAY_CAUSES
from terrace.functions import mean, percent
from terrace.operators.reports import change_from_previous, named_totals, totals, weighted_top


def on_time_by_carrier(agg: DataFrame, dim_carrier: DataFrame) -> DataFrame:
    """Flights, on-time share of arrivals and cancelled share per carrier, best first. A carrier
    without arrivals has a NULL share."""
    counts = ("flights", "on_time_flights", "arrived_flights", "cancelled_flights")
    summed = named_totals(agg, "carrier_code", dim_carrier, "carrier_name", {c: c for c in counts})
    return summed.select(
        "carrier_name",
        "flights",
        percent(F.col("on_time_flights"), F.col("arrived_flights"), 1).alias("on_time_pct"),
        percent(F.col("cancelled_flights"), F.col("flights"), 2).alias("cancel_pct"),
    ).orderBy(F.desc_nulls_last("on_time_pct"), "carrier_name")


def worst_routes(agg: DataFrame, at_least: int = 50, k: int = 10) -> DataFrame:
    """Routes with the largest mean arrival delay, weighting daily means by their arrivals.

    The daily means in the rollup are rounded; ``worst_routes_exact`` starts from the fact instead.
    """
    route = F.concat("origin_airport_code", F.lit("-"), "dest_airport_code")
    return weighted_top(agg, route, "route", "flights", "avg_arr_delay_min", "arrived_flights", at_least, k)


def worst_routes_exact(fact: DataFrame, at_least: int = 50, k: int = 10) -> DataFrame:
    """As ``worst_routes`` without the rounding of daily means."""
    return (
        fact.groupBy("route")
        .agg(F.count("*").alias("flights"), F.round(F.avg("arr_delay_min"), 1).alias("avg_arr_delay_min"))
        .filter(F.col("flights") >= at_least)
        .orderBy(F.desc_nulls_last("avg_arr_delay_min"), "route")
        .limit(k)
    )


def delay_causes_by_carrier(agg: DataFrame) -> DataFrame:
    """Delay minutes by cause per carrier."""
    labels = ("carrier", "weather", "air_system", "security", "late_aircraft")
    sums = {label: f"total_{cause}" for label, cause in zip(labels, DELAY_CAUSES)}
    return totals(agg, ["carrier_code"], sums).orderBy("carrier_code")


def delayed_by_hour_and_weekend(fact: DataFrame, dim_date: DataFrame) -> DataFrame:
    """Share of late arrivals per scheduled hour and weekend flag. The fact is reduced to one row per
    date and hour before it meets the date dimension."""
    per_day = fact.groupBy("date_key", "crs_dep_hour").agg(
        F.count("*").alias("flights"),
        F.count("is_arr_delayed_15").alias("_known"),
        F.count_if("is_arr_delayed_15").alias("_late"),
    )
    counts = ("flights", "_known", "_late")
    joined = per_day.join(dim_date.select("date_key", "is_weekend"), "date_key")
    summed = totals(joined, ["crs_dep_hour", "is_weekend"], {c: c for c in counts})
    rate = F.lit(100) * mean(F.col("_late"), F.col("_known"))
    return summed.select(
        "crs_dep_hour", "is_weekend", "flights", F.round(rate, 1).alias("delayed_pct")
    ).orderBy("crs_dep_hour", "is_weekend")


def daily_flights(agg: DataFrame) -> DataFrame:
    return totals(agg, ["date_key", "carrier_code"], {"flights": "flights"})


def day_over_day(agg: DataFrame) -> DataFrame:
    """Flights per carrier and day, with the change from that carrier's previous day present."""
    changed = change_from_previous(
        daily_flights(agg), "carrier_code", "date_key", "flights", "change_vs_previous_day"
    )
    return changed.select("date_key", "carrier_code", "flights", "change_vs_previous_day").orderBy(
        "carrier_code", "date_key"
    )
