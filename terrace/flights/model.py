"""The flight star schema: one fact, three dimensions (airport in two roles), one daily rollup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.flights.contract import CANCELLATION_REASONS, CARRIERS, DELAY_CAUSES, LATE_MINUTES
from terrace.operators.star import code_dimension, date_dimension, project_fact, role_dimension, roll_up
from terrace.sources.lookups import inline_lookup, look_up, unique_lookup
from terrace.spec import Measure, Reference

FACT_COLUMNS = (
    "year(flight_date) * 10000 + month(flight_date) * 100 + day(flight_date) as date_key",
    "carrier_code",
    "origin_airport as origin_airport_code",
    "dest_airport as dest_airport_code",
    "flight_number",
    "tail_number",
    "route",
    "crs_dep_time",
    "crs_dep_hour",
    "dep_delay_min",
    "arr_delay_min",
    "is_arr_delayed_15",
    "is_cancelled",
    "cancellation_reason",
    "is_diverted",
    "air_time_min",
    "distance_miles",
    *DELAY_CAUSES,
)

ROUTE_DAY = ("date_key", "carrier_code", "origin_airport_code", "dest_airport_code")

ROUTE_DAY_MEASURES = (
    Measure("flights", "count(*)"),
    Measure("cancelled_flights", "count_if(is_cancelled)"),
    Measure("diverted_flights", "count_if(is_diverted)"),
    Measure("arrived_flights", "count(arr_delay_min)"),
    Measure("on_time_flights", f"count_if(arr_delay_min < {LATE_MINUTES})"),
    Measure("avg_arr_delay_min", "round(avg(arr_delay_min), 2)"),
    Measure("avg_dep_delay_min", "round(avg(dep_delay_min), 2)"),
    *(Measure(f"total_{c}", f"sum({c})") for c in DELAY_CAUSES),
)

REFERENCES = (
    Reference("dim_date", "date_key", "date_key"),
    Reference("dim_carrier", "carrier_code", "carrier_code"),
    Reference("dim_airport", "origin_airport_code", "airport_code"),
    Reference("dim_airport", "dest_airport_code", "airport_code"),
)


def dim_date(silver: DataFrame) -> DataFrame:
    return date_dimension(silver, "flight_date")


def dim_airport(silver: DataFrame) -> DataFrame:
    roles = [
        {"airport_code": f"{end}_airport", "city": f"{end}_city", "state": f"{end}_state"} for end in ("origin", "dest")
    ]
    return role_dimension(silver, roles, "airport_code")


def dim_carrier(silver: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """``names`` is any (carrier_code, carrier_name) table with unique codes; the default is built in."""
    if names is None:
        names = inline_lookup(silver.sparkSession, CARRIERS, "carrier_code", "carrier_name")
    else:
        names = unique_lookup(names, "carrier_code", "carrier_name")
    return code_dimension(silver, "carrier_code", "carrier_name", names)


def fact_flights(silver: DataFrame, reasons: DataFrame | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """``reasons`` is any (cancellation_code, cancellation_reason) table with unique codes; ``keep`` names silver columns to carry along."""
    if reasons is None:
        reasons = inline_lookup(
            silver.sparkSession, CANCELLATION_REASONS, "cancellation_code", "cancellation_reason"
        )
    else:
        reasons = unique_lookup(reasons, "cancellation_code", "cancellation_reason")
    explained = look_up(silver, reasons, "cancellation_code", "cancellation_reason")
    return project_fact(explained, [*FACT_COLUMNS, *keep])


def agg_daily_route(fact: DataFrame) -> DataFrame:
    return roll_up(fact, ROUTE_DAY, ROUTE_DAY_MEASURES)


def dates_of(keyed: DataFrame) -> DataFrame:
    """The dates of a fact or rollup as ``flight_date``, for building dim_date from its keys."""
    return keyed.select("date_key").distinct().select(F.to_date(F.col("date_key").cast("string"), "yyyyMMdd").alias("flight_date"))


def star(silver: DataFrame) -> dict[str, DataFrame]:
    """Every gold table straight from silver, lazily."""
    fact = fact_flights(silver)
    return {
        "dim_date": dim_date(silver),
        "dim_carrier": dim_carrier(silver),
        "dim_airport": dim_airport(silver),
        "fact_flights": fact,
        "agg_daily_route": agg_daily_route(fact),
    }
