"""The physical plans that matter at scale: what is read, shuffled, broadcast and evaluated."""

import re

import pytest
from pyspark.sql import functions as F

from terrace.flights import dashboard, model
from terrace.flights.contract import FLIGHTS
from terrace.lake import materialize
from terrace.operators import quality
from terrace.operators.clean import accepted, rejected
from terrace.spec import Field, TableSpec
from terrace.streaming import events as ev
from tests.conftest import SF_SMALL
from verification import queries
from verification.adapters import raw_flights


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def read_columns(df):
    found = re.findall(r"ReadSchema: struct<([^>]*)>", plan(df))
    return [{c.split(":")[0] for c in schema.split(",") if c} for schema in found]


@pytest.fixture
def silver(flights):
    return materialize(accepted(flights({}, {"Flight_Number_Reporting_Airline": "2"}), FLIGHTS), "silver")


def test_events_are_parsed_once(bodies, event):
    for df in (ev.parse_events(bodies(event())), ev.split_events(bodies(event()))[1]):
        assert len(re.findall(r"from_json\(", plan(df))) <= 2  # the operator's arguments and its output line
        assert "Generate" in plan(df)


def test_cleaning_shuffles_once_and_rejecting_never(flights):
    assert plan(accepted(flights(), FLIGHTS)).count("hashpartitioning") == 1
    assert "hashpartitioning" not in plan(rejected(flights(), FLIGHTS))


def test_no_python_runs_per_row(flights, bodies, event):
    for df in (accepted(flights(), FLIGHTS), rejected(flights(), FLIGHTS), ev.airport_delays(ev.parse_events(bodies(event())))):
        assert not re.search(r"BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroups", plan(df))


def test_dimensions_and_rollups_read_only_their_columns(silver):
    assert read_columns(model.dim_date(silver)) == [{"flight_date"}]
    assert read_columns(model.dim_carrier(silver)) == [{"carrier_code"}]
    (airport,) = read_columns(model.dim_airport(silver))
    assert len(airport) == 6
    (tile,) = read_columns(dashboard.reduced(model.fact_flights(silver)))
    measured = {"is_cancelled", "arr_delay_min", "is_arr_delayed_15"}
    assert tile == measured | {"flight_date", "carrier_code", "origin_airport", "crs_dep_hour", "cancellation_code"}


def test_fact_is_not_shuffled_for_lookups_and_rollup_shuffles_once(silver):
    fact = model.fact_flights(silver)
    assert "hashpartitioning" not in plan(fact)
    assert plan(model.agg_daily_route(fact)).count("hashpartitioning") == 1


def test_airports_are_aggregated_by_hash_before_any_sort(silver):
    text = plan(model.dim_airport(silver))
    # The tree is printed from the last step to the first.
    assert text.index("SortAggregate") < text.index("HashAggregate") < text.index("Generate")
    after_generate = text[: text.index("Generate")]
    assert after_generate.rindex("HashAggregate") > after_generate.rindex("Sort")


def test_orphan_check_scans_the_fact_once(silver):
    fact = materialize(model.fact_flights(silver), "fact")
    dims = {n: materialize(d, n) for n, d in model.star(silver).items() if n.startswith("dim_")}
    text = plan(quality.orphans(fact, dims, model.REFERENCES))
    assert len(re.findall(r"/fact-[0-9a-f]+\]", text)) == 1


def test_filters_reach_the_stored_fact(silver):
    fact = materialize(model.fact_flights(silver), "fact").filter("date_key = 20230821 and carrier_code = 'AS'")
    assert "EqualTo(date_key,20230821)" in plan(fact) and "EqualTo(carrier_code,AS)" in plan(fact)


def test_copies_meet_as_typed_rows(flights):
    shuffled = re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", plan(accepted(flights(), FLIGHTS)))
    (columns,) = [{c.split("#")[0].strip() for c in row.split(",")} for row in shuffled]
    assert {"arr_time", "dep_delay_min", "distance_miles"} <= columns
    assert not {"DepDelay", "ArrTime", "CRSArrTime", "WeatherDelay"} & columns


def test_copies_travel_without_hashes_beside_rows_of_their_route(flights):
    text = plan(accepted(flights(), FLIGHTS))
    (shuffled,) = re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", text)
    assert "hash" not in shuffled
    sorts = re.findall(r"\) Sort\nInput [^\n]*\nArguments: \[(\w+)#\d+ ASC NULLS FIRST, (\w+)#", text)
    assert sorts and set(sorts) == {("origin_airport", "dest_airport")}


def test_rows_that_differ_in_the_last_column_alone_have_a_stable_survivor(flights):
    tied = flights(*[{"LateAircraftDelay": str(i)} for i in range(20)]).withColumn("_ingest_ts", F.lit("2024-02-01").cast("timestamp"))
    survivors = {accepted(tied.repartition(n, "LateAircraftDelay"), FLIGHTS).first().late_aircraft_delay_min for n in (1, 3, 7)}
    assert survivors == {0}


def test_types_without_an_order_may_be_columns(spark):
    fields = (Field("id", "id", "int"), Field("took", "took", "interval"), Field("held", "held", "variant"))
    raw = spark.createDataFrame([("1", "2 days", "a"), ("1", "1 day", "b"), ("2", None, None)], "id string, took string, held string")
    kept = accepted(raw.withColumn("_ingest_ts", F.lit("2024-02-01").cast("timestamp")), TableSpec(fields, (), ("id",)))
    found = kept.select("id", F.col("took").cast("string"), F.col("held").cast("string")).collect()
    assert sorted(map(tuple, found), key=str) == [(1, "1 days", "b"), (2, None, None)]


def test_shipments_are_shuffled_for_their_orders_alone(spark):
    """Suppliers, without the names of their nations, count as small; joined with them they would not."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "4k")
    try:
        text = plan(raw_flights(spark, SF_SMALL))
    finally:
        spark.conf.set(name, before)
    assert "hashpartitioning(l_orderkey" in text and "hashpartitioning(l_suppkey" not in text


def test_a_fact_carries_silver_columns_that_are_asked_for(silver):
    fact = model.fact_flights(silver, keep=["origin_city"])
    assert fact.columns == [*model.fact_flights(silver).columns, "origin_city"]
    assert fact.select("origin_city").distinct().first()[0] == "Boise, ID"


def written(monkeypatch, spark, name):
    """The columns of what a query writes in between."""
    found = {}

    def noting(df, purpose):
        found[purpose] = df.columns
        return materialize(df, purpose)

    monkeypatch.setattr(queries, "materialize", noting)
    queries.registered()[name](spark, SF_SMALL)
    return found


def test_queries_write_only_the_columns_they_use(spark, monkeypatch):
    (ends,) = written(monkeypatch, spark, "role_playing_join").values()
    assert set(ends) == {f"{end}_{c}" for end in ("origin", "dest") for c in ("airport_code", "city", "state")}
    (rows,) = written(monkeypatch, spark, "dashboard_rows").values()
    assert rows == list(dashboard.ROW_COLUMNS)
    assert written(monkeypatch, spark, "incremental_rollup") == {}  # silver is written by its snapshot table alone
