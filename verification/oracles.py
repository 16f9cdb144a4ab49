"""SQL twins of the registered queries, for DuckDB. They are written from the definitions, step by step
as CTEs, and share only the adapters' input rows with the Spark side."""

from __future__ import annotations

from terrace.flights.contract import CANCELLATION_REASONS, CARRIERS
from terrace.streaming.events import STATUSES
from verification.adapters import EVENTS_CTE, FLIGHTS_CTE


def rounded(value: str, digits: int) -> str:
    """Half-up rounding of the decimal text of a double, as Spark rounds; DuckDB rounds the binary value."""
    exact = f"cast(cast({value} as varchar) as decimal(38,17))"
    return f"cast(round({exact}, {digits}) as double)"


def text(column: str, name: str) -> str:
    return f"nullif(trim({column}), '') as {name}"


def number(column: str, name: str) -> str:
    return f"try_cast({column} as double) as {name}"


def clock(column: str, name: str) -> str:
    return f"lpad(nullif(regexp_replace(trim({column}), '[^0-9]', '', 'g'), ''), 4, '0') as {name}"


def pairs(mapping: dict[str, str], key: str, value: str) -> str:
    rows = ", ".join(f"('{k}', '{v}')" for k, v in mapping.items())
    return f"(values {rows}) as t({key}, {value})"


TYPED_COLUMNS = f"""
  try_cast(FlightDate as date) as flight_date, {text('Reporting_Airline', 'carrier_code')},
  {text('Tail_Number', 'tail_number')}, {text('Flight_Number_Reporting_Airline', 'flight_number')},
  {text('Origin', 'origin_airport')}, {text('OriginCityName', 'origin_city')}, {text('OriginState', 'origin_state')},
  {text('Dest', 'dest_airport')}, {text('DestCityName', 'dest_city')}, {text('DestState', 'dest_state')},
  {clock('CRSDepTime', 'crs_dep_time')}, {clock('DepTime', 'dep_time')}, {number('DepDelay', 'dep_delay_min')},
  {clock('CRSArrTime', 'crs_arr_time')}, {clock('ArrTime', 'arr_time')}, {number('ArrDelay', 'arr_delay_min')},
  {number('Cancelled', 'cancelled_flag')}, {text('CancellationCode', 'cancellation_code')},
  {number('Diverted', 'diverted_flag')}, {number('AirTime', 'air_time_min')}, {number('Distance', 'distance_miles')},
  {number('CarrierDelay', 'carrier_delay_min')}, {number('WeatherDelay', 'weather_delay_min')},
  {number('NASDelay', 'nas_delay_min')}, {number('SecurityDelay', 'security_delay_min')},
  {number('LateAircraftDelay', 'late_aircraft_delay_min')}, _ingest_ts
"""

TIES = "l_orderkey, l_linenumber, l_partkey, l_suppkey"

CHECKED = f"""{FLIGHTS_CTE}
, typed as (select {TYPED_COLUMNS}, {TIES} from bronze)
, checked as (
  select *, concat_ws(',',
    case when flight_date is null then 'missing_flight_date' end,
    case when carrier_code is null then 'missing_carrier' end,
    case when flight_number is null then 'missing_flight_number' end,
    case when crs_dep_time is null then 'missing_crs_dep_time' end,
    case when origin_airport is null or not regexp_matches(origin_airport, '^[A-Z]{{3}}$') then 'bad_origin_code' end,
    case when dest_airport is null or not regexp_matches(dest_airport, '^[A-Z]{{3}}$') then 'bad_dest_code' end,
    case when distance_miles is null or not distance_miles > 0 then 'bad_distance' end) as _reject_reason
  from typed)
"""


def whole(column: str) -> str:
    return f"cast(trunc({column}) as integer)"


CAUSES = ("carrier", "weather", "nas", "security", "late_aircraft")

SILVER = f"""{CHECKED}
, ranked as (
  select *, row_number() over (
    partition by flight_date, carrier_code, flight_number, origin_airport, dest_airport, crs_dep_time
    order by _ingest_ts desc, {TIES}) as copy_number
  from checked where _reject_reason = '')
, silver as (
  select flight_date, carrier_code, tail_number, flight_number, origin_airport, origin_city, origin_state,
    dest_airport, dest_city, dest_state, crs_dep_time, dep_time, {whole('dep_delay_min')} as dep_delay_min,
    crs_arr_time, arr_time, {whole('arr_delay_min')} as arr_delay_min, cancellation_code, air_time_min, distance_miles,
    {', '.join(f"coalesce({whole(f'{c}_delay_min')}, 0) as {c}_delay_min" for c in CAUSES)},
    _ingest_ts, coalesce(cancelled_flag, 0) = 1 as is_cancelled, coalesce(diverted_flag, 0) = 1 as is_diverted,
    {whole('arr_delay_min')} >= 15 as is_arr_delayed_15, cast(substr(crs_dep_time, 1, 2) as integer) as crs_dep_hour,
    concat(origin_airport, '-', dest_airport) as route
  from ranked where copy_number = 1)
"""

DIMENSIONS = f""", dim_date as (
  select distinct cast(strftime(flight_date, '%Y%m%d') as integer) as date_key, flight_date as date,
    cast(year(flight_date) as integer) as year, cast(quarter(flight_date) as integer) as quarter,
    cast(month(flight_date) as integer) as month, monthname(flight_date) as month_name,
    cast(day(flight_date) as integer) as day_of_month, cast(dayofweek(flight_date) + 1 as integer) as day_of_week,
    dayname(flight_date) as day_name, dayofweek(flight_date) in (0, 6) as is_weekend
  from silver)
, dim_carrier as (
  select c.carrier_code, coalesce(n.carrier_name, c.carrier_code) as carrier_name
  from (select distinct carrier_code from silver) c
  left join {pairs(CARRIERS, 'carrier_code', 'carrier_name')} using (carrier_code))
, dim_airport as (
  select airport_code, max(city) as city, max(state) as state from (
    select origin_airport as airport_code, origin_city as city, origin_state as state from silver
    union all select dest_airport, dest_city, dest_state from silver) group by airport_code)
""".replace("n.carrier_name", "t.carrier_name")

FACT = f"""{SILVER}
, fact as (
  select cast(strftime(flight_date, '%Y%m%d') as integer) as date_key, carrier_code,
    origin_airport as origin_airport_code, dest_airport as dest_airport_code, flight_number, tail_number, route,
    crs_dep_time, crs_dep_hour, dep_delay_min, arr_delay_min, is_arr_delayed_15, is_cancelled,
    t.cancellation_reason, is_diverted, air_time_min, distance_miles, {', '.join(f'{c}_delay_min' for c in CAUSES)}
  from silver left join {pairs(CANCELLATION_REASONS, 'cancellation_code', 'cancellation_reason')} using (cancellation_code))
"""

AGG = f"""{FACT}
, agg as (
  select date_key, carrier_code, origin_airport_code, dest_airport_code, count(*) as flights,
    count(*) filter (where is_cancelled) as cancelled_flights, count(*) filter (where is_diverted) as diverted_flights,
    count(arr_delay_min) as arrived_flights, count(*) filter (where arr_delay_min < 15) as on_time_flights,
    {rounded('avg(arr_delay_min)', 2)} as avg_arr_delay_min, {rounded('avg(dep_delay_min)', 2)} as avg_dep_delay_min,
    {', '.join(f'cast(sum({c}_delay_min) as bigint) as total_{c}_delay_min' for c in CAUSES)}
  from fact group by 1, 2, 3, 4)
"""

GOLD = AGG + DIMENSIONS

DASHBOARD = f"""{GOLD}
, dash as (
  select d.date, d.month, d.month_name, c.carrier_name, f.origin_airport_code as origin_airport, f.crs_dep_hour,
    cast(case when f.is_cancelled then 100.0 else 0.0 end as double) as cancelled_pct,
    cast(case when f.arr_delay_min is null then null when f.is_arr_delayed_15 then 0.0 else 100.0 end as double) as on_time_pct,
    f.arr_delay_min
  from fact f join dim_date d on f.date_key = d.date_key join dim_carrier c on f.carrier_code = c.carrier_code)
"""

KPIS = "select count(carrier_name) as flights, avg(on_time_pct) as on_time_pct, avg(cancelled_pct) as cancelled_pct from dash"


def orphan_count(reference: str, fact: str, key: str, dimension: str, primary: str) -> str:
    return (
        f"select '{reference}' as reference, count(*) as orphan_rows from {fact} "
        f"where {key} not in (select {primary} from {dimension})"
    )


STAR_ORPHANS = " union all ".join(
    [
        orphan_count("dim_date.date_key", "fact", "date_key", "dim_date", "date_key"),
        orphan_count("dim_carrier.carrier_code", "fact", "carrier_code", "dim_carrier", "carrier_code"),
        orphan_count("dim_airport.origin_airport_code", "fact", "origin_airport_code", "dim_airport", "airport_code"),
        orphan_count("dim_airport.dest_airport_code", "fact", "dest_airport_code", "dim_airport", "airport_code"),
    ]
)

PARSED = f"""{EVENTS_CTE}
, parsed as (
  select body, try_cast(body as json) as j from bodies)
, typed as (
  select body, j->>'$.event_id' as event_id, try_cast(replace(replace(j->>'$.event_ts', 'T', ' '), 'Z', '') as timestamp) as event_ts,
    j->>'$.carrier_code' as carrier_code, j->>'$.flight_number' as flight_number, j->>'$.origin_airport' as origin_airport,
    j->>'$.dest_airport' as dest_airport, j->>'$.status' as status, try_cast(j->>'$.delay_min' as integer) as delay_min
  from parsed)
, checked as (
  select *, concat_ws(',',
    case when event_id is null then 'missing_event_id' end, case when event_ts is null then 'missing_event_ts' end,
    case when origin_airport is null then 'missing_origin' end,
    case when status is null or status not in {STATUSES} then 'bad_status' end) as _reject_reason
  from typed)
, valid as (
  select event_id, event_ts, carrier_code, flight_number, origin_airport, dest_airport, status, delay_min
  from checked where _reject_reason = '')
, once as (select distinct on (event_id, event_ts) * from valid)
"""


def windows(source: str) -> str:
    return f"""
  select time_bucket(interval 5 minutes, event_ts) as window_start,
    time_bucket(interval 5 minutes, event_ts) + interval 5 minutes as window_end, origin_airport,
    count(*) filter (where status = 'DEPARTED') as departures, count(*) filter (where status = 'CANCELLED') as cancellations,
    {rounded("avg(delay_min) filter (where status = 'DEPARTED')", 2)} as avg_dep_delay_min,
    max(delay_min) filter (where status = 'DEPARTED') as max_dep_delay_min
  from {source} group by 1, 2, 3"""


ORDERS_TEXT = """select cast(o_orderkey as varchar) as Order_Key, cast(o_custkey as varchar) as Customer,
  o_orderstatus as Status, {priority} as Priority, cast(o_orderdate as varchar) as o_orderdate,
  cast(o_totalprice as varchar) as o_totalprice, {rescued} as _rescued_data from orders {where}"""

LINE_COLUMNS = ("l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag "
                "l_linestatus l_shipdate").split()  # fmt: skip

UPSERTED = """
select o_orderkey, o_custkey, case when o_orderkey % 3 <> 1 then 'X' else o_orderstatus end as o_orderstatus,
  case when o_orderkey % 3 <> 1 then o_totalprice + 1 else o_totalprice end as o_totalprice,
  cast(o_orderdate as date) as o_orderdate, o_orderpriority {extra} from orders"""

# Silver after one month was corrected.
CORRECTED = SILVER.replace(", silver as (", ", as_sent as (") + """
, silver as (
  select * exclude (corrected) replace (if(corrected, dep_delay_min + 7, dep_delay_min) as dep_delay_min,
    if(corrected, 'CORRECTED', origin_city) as origin_city)
  from (select *, strftime(flight_date, '%Y-%m') = '1995-03' as corrected from as_sent))
"""

ORACLES = {
    "sanitize_columns": f"select {', '.join(f'{c} as {c}_{i}' for i, c in enumerate(LINE_COLUMNS))} from lineitem",
    "contract_projection": f"{FLIGHTS_CTE} select {TYPED_COLUMNS} from bronze",
    "normalize_hhmm": f"""{FLIGHTS_CTE} select l_orderkey, l_linenumber, {clock('CRSDepTime', 'crs_dep_time')},
        {clock('DepTime', 'dep_time')}, {clock('CRSArrTime', 'crs_arr_time')}, {clock('ArrTime', 'arr_time')} from bronze""",
    "clean_valid": f"{SILVER} select * from silver",
    "clean_rejected": f"{CHECKED} select * exclude ({TIES}) from checked where _reject_reason <> ''",
    "reject_reason_counts": f"""{CHECKED} select _reject_reason, count(*) as rows from checked
        where _reject_reason <> '' group by 1 order by 2 desc, 1""",
    "reconciliation": f"""{SILVER} select n.*, bronze_rows - silver_rows - quarantined_rows as duplicates_removed from (select
        (select count(*) from bronze) as bronze_rows, (select count(*) from silver) as silver_rows,
        (select count(*) from checked where _reject_reason <> '') as quarantined_rows) n""",
    "dedupe_latest": """select * from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber
        order by l_shipdate desc, l_partkey desc, l_suppkey desc) = 1""",
    "dim_date": f"{SILVER} {DIMENSIONS} select * from dim_date",
    "dim_airport": f"{SILVER} {DIMENSIONS} select * from dim_airport",
    "dim_carrier": f"{SILVER} {DIMENSIONS} select * from dim_carrier",
    "dim_carrier_from_table": """select distinct cast(k as varchar) as carrier_code, coalesce(n_name, cast(k as varchar)) as carrier_name
        from (select c_nationkey + case when c_acctbal < 0 then 20 else 0 end as k from customer)
        left join nation on k = n_nationkey""",
    "fact": f"{FACT} select * from fact",
    "agg_daily_route": f"{AGG} select * from agg",
    "orphan_check": f"{GOLD} {STAR_ORPHANS}",
    "orphans_found": " union all ".join(
        [
            orphan_count("part.l_partkey", "lineitem", "l_partkey", "part where p_retailprice < 1500", "p_partkey"),
            orphan_count("orders.l_orderkey", "lineitem", "l_orderkey", "orders where o_orderpriority = '1-URGENT'", "o_orderkey"),
            orphan_count("supplier.l_suppkey", "lineitem", "l_suppkey", "supplier", "s_suppkey"),
        ]
    ),
    "integrity_gate": f"""{GOLD} select 'fact rows equal silver rows' as check,
        abs((select count(*) from fact) - (select count(*) from silver)) as violations
        union all select 'orphans of ' || reference, orphan_rows from ({STAR_ORPHANS})""",
    "role_playing_join": f"""{GOLD} select o.state as origin_state, d.state as dest_state, count(*) as flights
        from fact join dim_airport o on origin_airport_code = o.airport_code
        join dim_airport d on dest_airport_code = d.airport_code group by 1, 2""",
    "key_uniqueness": """select l_orderkey, l_linenumber, count(*) as copies from lineitem group by 1, 2 having count(*) > 1""",
    "silver_key_uniqueness": f"""{SILVER} select flight_date, carrier_code, flight_number, origin_airport, dest_airport,
        crs_dep_time, count(*) as copies from silver group by all having count(*) > 1""",
    "q1_carrier_on_time": f"""{GOLD} select carrier_name, cast(sum(flights) as bigint) as flights,
        {rounded('100 * sum(on_time_flights) / nullif(sum(arrived_flights), 0)', 1)} as on_time_pct,
        {rounded('100 * sum(cancelled_flights) / sum(flights)', 2)} as cancel_pct
        from agg join dim_carrier using (carrier_code) group by 1""",
    "q2_worst_routes": f"""{AGG} select concat(origin_airport_code, '-', dest_airport_code) as route,
        cast(sum(flights) as bigint) as flights,
        {rounded('cast(sum(cast(avg_arr_delay_min as decimal(18,2)) * arrived_flights) as double) / nullif(sum(arrived_flights), 0)', 1)}
        as avg_arr_delay_min from agg group by 1 having sum(flights) >= 50 order by 3 desc nulls last, 1 limit 10""",
    "q2_worst_routes_exact": f"""{FACT} select route, count(*) as flights, {rounded('avg(arr_delay_min)', 1)} as avg_arr_delay_min
        from fact group by 1 having count(*) >= 50 order by 3 desc nulls last, 1 limit 10""",
    "q3_delay_causes": f"""{AGG} select carrier_code, cast(sum(total_carrier_delay_min) as bigint) as carrier,
        cast(sum(total_weather_delay_min) as bigint) as weather, cast(sum(total_nas_delay_min) as bigint) as air_system,
        cast(sum(total_security_delay_min) as bigint) as security,
        cast(sum(total_late_aircraft_delay_min) as bigint) as late_aircraft from agg group by 1""",
    "q4_delay_by_hour_weekend": f"""{GOLD} select crs_dep_hour, is_weekend, count(*) as flights,
        {rounded('100 * avg(cast(is_arr_delayed_15 as integer))', 1)} as delayed_pct
        from fact join dim_date using (date_key) group by 1, 2""",
    "q5_day_over_day": f"""{AGG} , daily as (select date_key, carrier_code, cast(sum(flights) as bigint) as flights from agg group by 1, 2)
        select date_key, carrier_code, flights,
        flights - lag(flights) over (partition by carrier_code order by date_key) as change_vs_previous_day from daily""",
    "dashboard_rows": f"{DASHBOARD} select * from dash",
    "kpi_counters": f"{DASHBOARD} {KPIS}",
    "dashboard_filtered": f"""{DASHBOARD} {KPIS} where carrier_name in ('Delta Air Lines', 'ZZ')
        and month_name in ('January', 'June')""",
    "on_time_by_day": f"""{DASHBOARD} select cast(date_trunc('day', date) as timestamp) as day,
        avg(on_time_pct) as on_time_pct from dash group by 1""",
    "delay_by_carrier": f"{DASHBOARD} select carrier_name, avg(arr_delay_min) as avg_arr_delay from dash group by 1",
    "airport_hour_long": f"{DASHBOARD} select origin_airport, crs_dep_hour, count(carrier_name) as flights from dash group by 1, 2",
    "airport_hour_pivot": f"""{DASHBOARD} select origin_airport,
        {', '.join(f'count(*) filter (where crs_dep_hour = {h}) as hour_{h}' for h in range(24))},
        count(*) filter (where crs_dep_hour is null or crs_dep_hour not between 0 and 23) as hour_other from dash group by 1""",
    "filter_values": f"""{DASHBOARD} select distinct 'carrier_name' as filter, carrier_name as value from dash
        union all select distinct 'month_name', month_name from dash""",
    "parse_events": f"{PARSED} select * from valid",
    "refused_events": f"{PARSED} select body, _reject_reason from checked where _reject_reason <> ''",
    "dedupe_events": f"{PARSED} select * from once",
    "airport_windows": f"{PARSED} {windows('once')}",
    "latest_windows": f"""{PARSED} select * from ({windows('once')})
        order by window_start desc, departures desc, origin_airport limit 50""",
    "stream_dedupe": f"{PARSED} select * from once",
    "stream_windows_upsert": f"{PARSED} {windows('valid')}",
    "stream_windows_append": f"""{PARSED} select * from ({windows('once')})
        where window_end <= (select max(event_ts) from valid) - interval 10 minutes""",
    "ingest_csv": ORDERS_TEXT.format(priority="o_orderpriority", rescued="cast(null as varchar)", where=""),
    "ingest_ledger": f"""with loaded as ({ORDERS_TEXT.format(priority='o_orderpriority', rescued='cast(null as varchar)', where='')}),
        drops as (select o_orderkey % 2 as drop, count(distinct substr(o_orderpriority, 1, 1) || o_orderstatus) as n from orders group by 1)
        select loaded.*, files, files as paths, batches from loaded,
        (select cast(sum(n) as bigint) as files, cast(sum(ceil(n / 3)) as bigint) as batches from drops)""",
    "rescue_columns": ORDERS_TEXT.format(
        priority="case when o_orderkey % 2 = 0 then o_orderpriority end",
        rescued="case when o_orderkey % 2 <> 0 then '{\"Rank\":\"' || o_orderpriority || '\"}' end",
        where="",
    ),
    "rescue_surplus": """select cast(o_orderkey as varchar) as Order_Key, o_orderstatus as Status,
        case o_orderkey % 5 when 0 then '{"_surplus_row":"' || o_orderkey || ',' || o_orderstatus || ',,,,,,far"}'
          when 2 then '{"_surplus_row":"' || o_orderkey || ',' || o_orderstatus || ',\\"' || o_orderpriority || ',x\\""}' end
          as _rescued_data from orders""",
    "file_counts": """select substr(o_orderpriority, 1, 1) || '_' || o_orderstatus as file, count(*) as rows, true as has_time
        from orders group by 1""",
    "upsert_snapshot": UPSERTED.format(extra=""),
    "upsert_newer_wins": UPSERTED.format(extra=", case when o_orderkey % 3 <> 1 then 2 else 1 end as arrived"),
    "clustered_write": f"{FACT} select * from fact",
    "incremental_rollup": f"{AGG.replace(SILVER, CORRECTED)} select * from agg",
    "incremental_dimensions": f"""{CORRECTED} {DIMENSIONS}
select 'dim_airport' as dimension, airport_code as member, concat_ws('/', city, state) as shown from dim_airport
union all select 'dim_carrier', carrier_code, carrier_name from dim_carrier
union all select 'dim_date', cast(date_key as varchar), day_name from dim_date""",
    "interleaved_write": f"{FACT} select * from fact",
    "stream_late": f"""{PARSED}
, span as (select epoch(min(ts))::bigint as low, greatest(1, epoch(max(ts))::bigint - epoch(min(ts))::bigint) as width from events)
, own as (select event_id, event_ts, least(3, floor((epoch(event_ts)::bigint - low) * 4 / width)::int) as s from valid, span)
, sliced as (select event_id, event_ts, if(cast(substr(event_id, 2) as bigint) % 20 = 7 and s < 3, 4, s) as slice from own)
, latest as (select slice, max(event_ts) as m from sliced group by 1)
, marks as (select d as slice, (select max(m) from latest where latest.slice < d) as mark from range(0, 5) t(d))
select event_id, event_ts, coalesce(event_ts < mark - interval 10 minutes, false) as late from sliced join marks using (slice)""",
}
