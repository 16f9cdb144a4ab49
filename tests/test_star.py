import pytest
from pyspark.sql import functions as F

from terrace.flights import dashboard, model, reports
from terrace.flights.contract import FLIGHTS
from terrace.operators import quality
from terrace.operators.clean import clean
from terrace.operators.star import with_role
from terrace.sources.lookups import look_up, unique_lookup
from terrace.spec import Reference


def silver(raw):
    return clean(raw, FLIGHTS)[0]


@pytest.fixture
def month(flights):
    """Flights over some days, carriers and routes, with cancelled, diverted and late ones."""
    rows = []
    for i in range(120):
        gone = i % 11 == 0
        rows.append(
            {
                "FlightDate": f"2024-01-{1 + i % 28:02d}",
                "Reporting_Airline": ("AS", "DL", "ZZ")[i % 3],
                "Flight_Number_Reporting_Airline": str(i),
                "Origin": ("BOI", "MSP")[i % 2],
                "Dest": ("DEN", "JFK", "BOI")[i % 3],
                "OriginCityName": None if i % 5 == 0 else f"city {i % 2}",
                "CRSDepTime": str(100 * (i % 25)),
                "ArrDelay": None if gone else str(i % 40 - 5),
                "Cancelled": "1.00" if gone else "0.00",
                "CancellationCode": "ABCDX"[i % 5] if gone else None,
            }
        )
    return silver(flights(*rows))


def test_dim_date(flights):
    rows = model.dim_date(silver(flights({"FlightDate": "2024-03-09"}, {"FlightDate": "2024-03-10", "Tail_Number": "X"}))).collect()
    row = {r.date_key: r for r in rows}[20240309]
    assert (row.year, row.quarter, row.month, row.month_name, row.day_of_month) == (2024, 1, 3, "March", 9)
    assert (row.day_of_week, row.day_name, row.is_weekend) == (7, "Saturday", True)
    assert len(rows) == 2


@pytest.mark.parametrize("day, number, weekend", [("2024-01-14", 1, True), ("2023-08-21", 2, False), ("2024-01-19", 6, False)])
def test_day_of_week_starts_on_sunday(flights, day, number, weekend):
    row = model.dim_date(silver(flights({"FlightDate": day}))).first()
    assert (row.day_of_week, row.is_weekend) == (number, weekend)


def test_dim_airport_has_one_row_per_code_and_ignores_missing_cities(flights):
    rows = [{"Flight_Number_Reporting_Airline": str(i), "OriginCityName": c} for i, c in enumerate([None, "Alpha", "Beta"])]
    got = {r.airport_code: (r.city, r.state) for r in model.dim_airport(silver(flights(*rows))).collect()}
    assert got == {"BOI": ("Beta", "ID"), "MSP": ("Minneapolis, MN", "MN")}


def test_unknown_carrier_is_its_own_name(flights):
    got = model.dim_carrier(silver(flights({"Reporting_Airline": "ZZ"}, {"Reporting_Airline": "AS"}))).collect()
    assert {r.carrier_code: r.carrier_name for r in got} == {"ZZ": "ZZ", "AS": "Alaska Airlines"}


def test_lookup_may_be_any_table(spark, flights):
    names = spark.createDataFrame([("AS", "Other Name")], "carrier_code string, carrier_name string")
    assert model.dim_carrier(silver(flights()), names).first().carrier_name == "Other Name"


def test_repeated_lookup_key_fails_the_job(spark):
    twice = spark.createDataFrame([("A", "x"), ("A", "y")], "k string, v string")
    with pytest.raises(Exception, match="not unique"):
        look_up(spark.createDataFrame([("A",)], "k string"), unique_lookup(twice, "k", "v"), "k", "v").collect()


def test_builtin_lookup_is_broadcast(spark, month):
    plan = month._sc._jvm.PythonSQLUtils.explainString(model.fact_flights(month)._jdf.queryExecution(), "simple")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_fact_has_22_columns_and_does_not_fan_out(month):
    fact = model.fact_flights(month)
    assert fact.count() == month.count() == 120 and len(fact.columns) == 22
    reasons = {r.cancellation_reason for r in fact.filter("is_cancelled").select("cancellation_reason").distinct().collect()}
    assert reasons == {"Carrier", "Weather", "National Air System", "Security", None}


def test_daily_route_rollup(flights):
    raw = flights(
        {"Flight_Number_Reporting_Airline": "1", "ArrDelay": "25.00"},
        {"Flight_Number_Reporting_Airline": "2", "ArrDelay": "5.00", "CarrierDelay": None},
        {
            "Flight_Number_Reporting_Airline": "3",
            "Cancelled": "1.00",
            "CancellationCode": "A",
            "ArrDelay": None,
            "DepDelay": None,
            "CarrierDelay": None,
        },
    )
    (row,) = model.agg_daily_route(model.fact_flights(silver(raw))).collect()
    assert (row.flights, row.cancelled_flights, row.diverted_flights) == (3, 1, 0)
    assert (row.arrived_flights, row.on_time_flights) == (2, 1)
    assert (row.avg_arr_delay_min, row.avg_dep_delay_min, row.total_carrier_delay_min) == (15.0, 20.0, 25)


def test_no_orphans_and_unique_dimension_keys(month):
    gold = model.star(month)
    report = quality.orphans(gold["fact_flights"], gold, model.REFERENCES)
    assert [r.orphan_rows for r in report.collect()] == [0, 0, 0, 0]
    for name, key in (("dim_date", "date_key"), ("dim_carrier", "carrier_code"), ("dim_airport", "airport_code")):
        assert quality.duplicate_keys(gold[name], [key]).count() == 0
    quality.enforce(quality.gate(month, gold["fact_flights"], gold, model.REFERENCES))


def test_orphans_are_counted_per_reference_and_null_is_one(spark):
    fact = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (None, "c")], "x int, y string")
    dims = {"dx": spark.createDataFrame([(1,)], "x int"), "dy": spark.createDataFrame([("a",), ("b",), ("c",)], "y string")}
    got = quality.orphans(fact, dims, [Reference("dx", "x", "x"), Reference("dy", "y", "y")])
    assert {r.reference: r.orphan_rows for r in got.collect()} == {"dx.x": 2, "dy.y": 0}


def test_broken_star_fails_the_gate(month):
    gold = model.star(month)
    gold["dim_carrier"] = gold["dim_carrier"].filter("carrier_code <> 'DL'")
    with pytest.raises(quality.IntegrityError, match="dim_carrier.carrier_code: 40"):
        quality.enforce(quality.gate(month, gold["fact_flights"], gold, model.REFERENCES))
    with pytest.raises(quality.IntegrityError, match="fact rows"):
        quality.enforce(quality.gate(month.limit(100), gold["fact_flights"], model.star(month), model.REFERENCES))


def test_airport_in_two_roles(month):
    gold = model.star(month)
    both = with_role(gold["fact_flights"], gold["dim_airport"], "airport_code", "origin_airport_code", "origin")
    both = with_role(both, gold["dim_airport"], "airport_code", "dest_airport_code", "dest")
    assert both.count() == 120 and {"origin_city", "dest_city"} <= set(both.columns)


def test_reconcile_and_reject_counts(flights):
    raw = flights({}, {}, {"Origin": "??"}, {"Origin": "??", "Tail_Number": "x"}, {"Distance": "0"})
    valid, refused = clean(raw, FLIGHTS)
    row = quality.reconcile(raw, valid, refused).first()
    assert row.asDict() == {"bronze_rows": 5, "silver_rows": 1, "quarantined_rows": 3, "duplicates_removed": 1}
    counts = quality.reject_counts(refused).collect()
    assert [(r._reject_reason, r["rows"]) for r in counts] == [("bad_origin_code", 2), ("bad_distance", 1)]


# ---- reports against the same questions asked in SQL


@pytest.fixture
def gold(spark, month):
    tables = model.star(month)
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return tables


def same(df, spark, sql):
    expected = spark.sql(sql)
    assert df.columns == expected.columns
    assert sorted(map(str, df.collect())) == sorted(map(str, expected.collect()))


def test_on_time_by_carrier(spark, gold):
    same(
        reports.on_time_by_carrier(gold["agg_daily_route"], gold["dim_carrier"]),
        spark,
        """select carrier_name, sum(flights) flights,
                  round(try_divide(100 * sum(on_time_flights), sum(arrived_flights)), 1) on_time_pct,
                  round(100 * sum(cancelled_flights) / sum(flights), 2) cancel_pct
           from agg_daily_route join dim_carrier using (carrier_code) group by carrier_name""",
    )


def test_carrier_without_arrivals_has_no_share(flights):
    one = silver(flights({"ArrDelay": None, "Cancelled": "1.00"}))
    tables = model.star(one)
    row = reports.on_time_by_carrier(tables["agg_daily_route"], tables["dim_carrier"]).first()
    assert (row.on_time_pct, row.cancel_pct) == (None, 100.0)


def test_worst_routes(spark, gold):
    got = reports.worst_routes(gold["agg_daily_route"], at_least=15, k=3)
    same(
        got,
        spark,
        """select concat(origin_airport_code, '-', dest_airport_code) route, sum(flights) flights,
                  round(sum(avg_arr_delay_min * arrived_flights) / sum(arrived_flights), 1) avg_arr_delay_min
           from agg_daily_route group by 1 having sum(flights) >= 15 order by avg_arr_delay_min desc, route limit 3""",
    )
    assert len(got.collect()) == 3
    exact = reports.worst_routes_exact(gold["fact_flights"], at_least=15, k=3)
    assert exact.columns == got.columns and exact.count() == 3


def test_delay_causes(spark, gold):
    same(
        reports.delay_causes_by_carrier(gold["agg_daily_route"]),
        spark,
        """select carrier_code, sum(carrier_delay_min) carrier, sum(weather_delay_min) weather, sum(nas_delay_min) air_system,
                  sum(security_delay_min) security, sum(late_aircraft_delay_min) late_aircraft
           from fact_flights group by carrier_code""",
    )


def test_delayed_by_hour_and_weekend(spark, gold):
    same(
        reports.delayed_by_hour_and_weekend(gold["fact_flights"], gold["dim_date"]),
        spark,
        """select crs_dep_hour, is_weekend, count(*) flights, round(100 * avg(cast(is_arr_delayed_15 as int)), 1) delayed_pct
           from fact_flights join dim_date using (date_key) group by 1, 2""",
    )


def test_day_over_day(spark, gold):
    got = reports.day_over_day(gold["agg_daily_route"])
    same(
        got,
        spark,
        """select date_key, carrier_code, flights,
                  flights - lag(flights) over (partition by carrier_code order by date_key) change_vs_previous_day
           from (select date_key, carrier_code, count(*) flights from fact_flights group by 1, 2)""",
    )
    assert got.filter("change_vs_previous_day is null").count() == 3


DATASET = """(select d.date, d.month_name, c.carrier_name, f.origin_airport_code origin_airport, f.crs_dep_hour, f.arr_delay_min,
    case when f.is_cancelled then 100.0D else 0.0D end cancelled_pct,
    case when f.arr_delay_min is null then null when f.is_arr_delayed_15 then 0.0D else 100.0D end on_time_pct
    from fact_flights f join dim_date d using (date_key) join dim_carrier c using (carrier_code))"""


@pytest.fixture
def tiles(gold):
    return dashboard.tiles(dashboard.reduced(gold["fact_flights"]), gold["dim_date"], gold["dim_carrier"])


def test_dashboard_widgets_equal_their_row_level_definitions(spark, gold, tiles):
    kpis = f"select count(carrier_name) flights, avg(on_time_pct) on_time_pct, avg(cancelled_pct) cancelled_pct from {DATASET}"
    same(dashboard.kpis(tiles), spark, kpis)
    same(dashboard.kpis(dashboard.filtered(tiles, ["ZZ"], ["January"])), spark, f"{kpis} where carrier_name = 'ZZ' and month_name = 'January'")
    same(dashboard.kpis(dashboard.filtered(tiles)), spark, kpis)
    same(dashboard.on_time_trend(tiles), spark, f"select date_trunc('DAY', date) day, avg(on_time_pct) on_time_pct from {DATASET} group by 1")
    same(dashboard.delay_by_carrier(tiles), spark, f"select carrier_name, avg(arr_delay_min) avg_arr_delay from {DATASET} group by 1")
    same(
        dashboard.flights_by_airport_and_hour(tiles),
        spark,
        f"select origin_airport, crs_dep_hour, count(carrier_name) flights from {DATASET} group by 1, 2",
    )
    same(dashboard.carrier_choices(tiles), spark, f"select distinct carrier_name from {DATASET}")
    same(dashboard.month_choices(tiles), spark, f"select distinct month_name from {DATASET}")
    rows = dashboard.flight_rows(gold["fact_flights"], gold["dim_date"], gold["dim_carrier"])
    assert rows.count() == 120 and len(rows.columns) == 9


def test_grid_keeps_unusual_hours(spark, tiles):
    grid = dashboard.airport_hour_grid(tiles)
    cells = [F.col(c) for c in grid.columns if c.startswith("hour_")]
    total = sum(cells[1:], cells[0])
    assert grid.agg(F.sum(total)).first()[0] == 120
    assert grid.agg(F.sum("hour_other")).first()[0] == len([i for i in range(120) if i % 25 == 24])


def test_no_rows_give_a_zero_count(tiles):
    row = dashboard.kpis(dashboard.filtered(tiles, ["nobody"])).first()
    assert (row.flights, row.on_time_pct, row.cancelled_pct) == (0, None, None)
