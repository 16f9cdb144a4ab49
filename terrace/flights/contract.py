"""The flight table contract: raw columns, types, reject rules, identity and derived columns."""

from __future__ import annotations

from terrace.spec import HHMM, Derived, Field, TableSpec, matching, positive, required

LATE_MINUTES = 15

# --- fixed values: column names, types and codes of the published data set and model ---

FLIGHT_KEY = ("flight_date", "carrier_code", "flight_number", "origin_airport", "dest_airport", "crs_dep_time")

FIELDS = (
    Field("flight_date", "FlightDate", "date"),
    Field("carrier_code", "Reporting_Airline"),
    Field("tail_number", "Tail_Number"),
    Field("flight_number", "Flight_Number_Reporting_Airline"),
    Field("origin_airport", "Origin"),
    Field("origin_city", "OriginCityName"),
    Field("origin_state", "OriginState"),
    Field("dest_airport", "Dest"),
    Field("dest_city", "DestCityName"),
    Field("dest_state", "DestState"),
    Field("crs_dep_time", "CRSDepTime", HHMM),
    Field("dep_time", "DepTime", HHMM),
    Field("dep_delay_min", "DepDelay", "double"),
    Field("crs_arr_time", "CRSArrTime", HHMM),
    Field("arr_time", "ArrTime", HHMM),
    Field("arr_delay_min", "ArrDelay", "double"),
    Field("cancelled_flag", "Cancelled", "double"),
    Field("cancellation_code", "CancellationCode"),
    Field("diverted_flag", "Diverted", "double"),
    Field("air_time_min", "AirTime", "double"),
    Field("distance_miles", "Distance", "double"),
    Field("carrier_delay_min", "CarrierDelay", "double"),
    Field("weather_delay_min", "WeatherDelay", "double"),
    Field("nas_delay_min", "NASDelay", "double"),
    Field("security_delay_min", "SecurityDelay", "double"),
    Field("late_aircraft_delay_min", "LateAircraftDelay", "double"),
)

DELAY_CAUSES = (
    "carrier_delay_min",
    "weather_delay_min",
    "nas_delay_min",
    "security_delay_min",
    "late_aircraft_delay_min",
)

AIRPORT_CODE = "^[A-Z]{3}$"

RULES = (
    required("flight_date"),
    required("carrier_code", "missing_carrier"),
    required("flight_number"),
    required("crs_dep_time"),
    matching("origin_airport", AIRPORT_CODE, "bad_origin_code"),
    matching("dest_airport", AIRPORT_CODE, "bad_dest_code"),
    positive("distance_miles", "bad_distance"),
)

CARRIERS = {
    "AA": "American Airlines",
    "AS": "Alaska Airlines",
    "B6": "JetBlue Airways",
    "DL": "Delta Air Lines",
    "F9": "Frontier Airlines",
    "G4": "Allegiant Air",
    "HA": "Hawaiian Airlines",
    "NK": "Spirit Airlines",
    "UA": "United Airlines",
    "WN": "Southwest Airlines",
    "OO": "SkyWest Airlines",
    "YX": "Republic Airways",
    "MQ": "Envoy Air",
    "OH": "PSA Airlines",
    "9E": "Endeavor Air",
}

CANCELLATION_REASONS = {"A": "Carrier", "B": "Weather", "C": "National Air System", "D": "Security"}

# --- end of fixed values ---


def _minutes(column: str) -> str:
    return f"try_cast({column} as int)"


DERIVED = (
    Derived("dep_delay_min", _minutes("dep_delay_min")),
    Derived("arr_delay_min", _minutes("arr_delay_min")),
    *(Derived(c, f"coalesce({_minutes(c)}, 0)") for c in DELAY_CAUSES),
    Derived("is_cancelled", "coalesce(cancelled_flag, 0) = 1"),
    Derived("is_diverted", "coalesce(diverted_flag, 0) = 1"),
    Derived("is_arr_delayed_15", f"{_minutes('arr_delay_min')} >= {LATE_MINUTES}"),
    Derived("crs_dep_hour", "cast(substring(crs_dep_time, 1, 2) as int)"),
    Derived("route", "concat(origin_airport, '-', dest_airport)"),
)

FLIGHTS = TableSpec(
    fields=FIELDS,
    rules=RULES,
    key=FLIGHT_KEY,
    derived=DERIVED,
    dropped=("cancelled_flag", "diverted_flag"),
    ties=("_source_file",),
    alike=("origin_airport", "dest_airport"),
)
