"""Adapters: SQL that gives the driver tables the shape of raw flights and of event bodies.

The expressions run unchanged on Spark and on DuckDB, so queries and their SQL twins start from equal
rows; only the order of the joins and the making of duplicates differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Shipments joined with both ends of their route, for DuckDB.
JOINED = """
  select l.*, o.o_orderdate, sn.n_nationkey as onk, sn.n_name as ocity, sr.r_name as ostate,
         cn.n_nationkey as dnk, cn.n_name as dcity, cr.r_name as dstate,
         l_orderkey % 31 = 0 as canc,
         (l_orderkey % 37 = 0 and l_orderkey % 31 <> 0) as divt,
         l_quantity - 22 + l_linenumber as ad,
         ((l_partkey * 7) % 24) * 100 + (l_suppkey * 13) % 60 as hm
  from lineitem l
  join orders o on l_orderkey = o_orderkey
  join customer c on o_custkey = c_custkey
  join supplier s on l_suppkey = s_suppkey
  join nation sn on s_nationkey = sn.n_nationkey
  join region sr on sn.n_regionkey = sr.r_regionkey
  join nation cn on c_nationkey = cn.n_nationkey
  join region cr on cn.n_regionkey = cr.r_regionkey
"""

# The same rows for Spark. The destination end is assembled first, so that the large table is shuffled once, for its orders.
# Suppliers join as two numbers each: so narrow, they are small enough to be broadcast up to millions of them, where suppliers
# with the names of their nations are not, and the large table would be shuffled a second time. Nations and regions are tiny.
JOINED_FOR_SPARK = """
  select l.*, o.*, sn.n_nationkey as onk, sn.n_name as ocity, sr.r_name as ostate,
         l_orderkey % 31 = 0 as canc,
         (l_orderkey % 37 = 0 and l_orderkey % 31 <> 0) as divt,
         l_quantity - 22 + l_linenumber as ad,
         ((l_partkey * 7) % 24) * 100 + (l_suppkey * 13) % 60 as hm
  from lineitem l
  join (
    select o_orderkey, o_orderdate, n_nationkey as dnk, n_name as dcity, r_name as dstate
    from orders
    join customer on o_custkey = c_custkey
    join nation on c_nationkey = n_nationkey
    join region on n_regionkey = r_regionkey
  ) o on l_orderkey = o_orderkey
  join supplier on l_suppkey = s_suppkey
  join nation sn on s_nationkey = sn.n_nationkey
  join region sr on sn.n_regionkey = sr.r_regionkey
"""

# Raw flights with every kind of dirt, over the joined rows ``j``.
FLIGHTS_FROM_JOINED = """
  select
    case when l_orderkey % 97 = 0 then 'not-a-date' else cast(cast(l_shipdate as date) as string) end as FlightDate,
    case when l_orderkey % 101 = 0 then ' '
         else substr('AAASB6DLF9G4HANKUAWNOOYXMQOH9EZZ', cast(1 + 2 * (l_suppkey % 16) as int), 2) end as Reporting_Airline,
    concat('N', cast(l_suppkey as string)) as Tail_Number,
    case when l_orderkey % 103 = 0 then '' else cast(l_partkey as string) end as Flight_Number_Reporting_Airline,
    case when l_orderkey % 89 = 0 then '??'
         else concat('N', substr('ABCDEFGHIJKLMNOPQRSTUVWXY', cast(onk + 1 as int), 1), 'X') end as Origin,
    case when l_linenumber = 7 then null else ocity end as OriginCityName,
    ostate as OriginState,
    case when l_orderkey % 83 = 0 then null
         else concat('N', substr('ABCDEFGHIJKLMNOPQRSTUVWXY', cast(dnk + 1 as int), 1), 'X') end as Dest,
    dcity as DestCityName,
    dstate as DestState,
    case when l_orderkey % 107 = 0 then 'n/a' else cast(hm as string) end as CRSDepTime,
    case when canc then null else cast(hm as string) end as DepTime,
    case when canc then null else cast(l_quantity - 20 as string) end as DepDelay,
    cast((hm + 200) % 2400 as string) as CRSArrTime,
    case when canc or divt then '' else cast((hm + 200) % 2400 as string) end as ArrTime,
    case when canc or divt then '' else cast(ad as string) end as ArrDelay,
    case when canc then '1.00' else '0.00' end as Cancelled,
    case when canc then substr('ABCD', cast(1 + l_linenumber % 4 as int), 1) else '' end as CancellationCode,
    case when divt then '1.00' else '0.00' end as Diverted,
    case when canc or divt then null else cast(l_quantity * 6 as string) end as AirTime,
    case when l_orderkey % 79 = 0 then '-1' else cast(l_extendedprice as string) end as Distance,
    case when not canc and not divt and ad >= 15 then cast(ad - 8 as string) end as CarrierDelay,
    case when not canc and not divt and ad >= 15 then '3.0' end as WeatherDelay,
    case when not canc and not divt and ad >= 20 then '2.0' end as NASDelay,
    cast(null as string) as SecurityDelay,
    case when not canc and not divt and ad >= 15 then '5.0' end as LateAircraftDelay,
    o_orderdate as _ingest_ts, l_orderkey, l_linenumber, l_partkey, l_suppkey
  from j
"""

# Every 50th order arrives twice, a day later and with another tail number.
WITH_LATER_COPIES = """
  select * from b
  union all
  select FlightDate, Reporting_Airline, 'DUP' as Tail_Number, Flight_Number_Reporting_Airline,
         Origin, OriginCityName, OriginState, Dest, DestCityName, DestState, CRSDepTime, DepTime,
         DepDelay, CRSArrTime, ArrTime, ArrDelay, Cancelled, CancellationCode, Diverted, AirTime,
         Distance, CarrierDelay, WeatherDelay, NASDelay, SecurityDelay, LateAircraftDelay,
         _ingest_ts + interval 1 day as _ingest_ts, l_orderkey, l_linenumber, l_partkey, l_suppkey
  from b where l_orderkey % 50 = 0
"""

FLIGHTS_CTE = f"""
with j as ({JOINED}), b as ({FLIGHTS_FROM_JOINED}), bronze as ({WITH_LATER_COPIES})
"""

# Event bodies: JSON text, some of it broken or incomplete.
BODIES = """
  select
    case when event_id % 97 = 0 then '{not json'
    else concat(
      '{"event_id":"e', cast(event_id as string),
      '","event_ts":"', replace(substr(cast(ts as string), 1, 19), ' ', 'T'), 'Z',
      '","carrier_code":"', substr('AADLUA', cast(1 + 2 * (user_id % 3) as int), 2),
      '","flight_number":"', cast(user_id as string),
      '","origin_airport":', case when event_id % 89 = 0 then 'null'
         else concat('"N', substr('ABCDEFGHIJKLMNOPQRSTUVWXY', cast(user_id % 25 + 1 as int), 1), 'X"') end,
      ',"dest_airport":"NAX","status":"', case event_type when 'purchase' then 'DEPARTED' when 'signup' then 'DEPARTED'
         when 'view' then 'ARRIVED' when 'error' then 'CANCELLED' else 'BOARDING' end,
      '","delay_min":', case when event_type = 'error' then 'null'
         else cast(cast(floor(value) as int) - 10 as string) end,
      '}') end as body,
    event_id
  from events
"""

EVENTS_CTE = f"""
with b as ({BODIES}), bodies as (
  select body from b
  union all
  select body from b where event_id % 50 = 0
)
"""

LARGE = ("lineitem", "orders", "events")

TIES = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Distribute the rows of a stored table that has fewer splits than there are cores.

    A small test file is one split, so all later work on it would run in one task. A large table has
    many splits and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def _select(spark: SparkSession, sf_dir: str, ctes: str, names: tuple[str, ...], tail: str) -> DataFrame:
    for name in names:
        rows = table(spark, sf_dir, name)
        (spread(rows) if name in LARGE else rows).createOrReplaceTempView(name)
    return spark.sql(f"{ctes}\n{tail}")


def _with_repeats(df: DataFrame, again: str) -> DataFrame:
    """Every 50th row twice, the second time with ``_again`` true, in one pass; a union would compute
    the rows twice."""
    copies = F.when(F.col(again) % 50 == 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    return df.withColumn("_again", F.explode(copies))


def raw_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("lineitem", "orders", "customer", "supplier", "nation", "region")
    ctes = f"with j as ({JOINED_FOR_SPARK}), b as ({FLIGHTS_FROM_JOINED})"
    both = _with_repeats(_select(spark, sf_dir, ctes, names, "select * from b"), "l_orderkey")
    return both.withColumns(
        {
            "Tail_Number": F.when(F.col("_again"), F.lit("DUP")).otherwise(F.col("Tail_Number")),
            "_ingest_ts": F.expr("if(_again, _ingest_ts + interval 1 day, _ingest_ts)"),
        }
    ).drop("_again")


def event_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_repeats(_select(spark, sf_dir, "", ("events",), BODIES), "event_id").select("body")
