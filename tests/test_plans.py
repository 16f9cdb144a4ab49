import pytest
from pyspark.sql import functions as F

from terrace.flights import reports
from terrace.flights.contract import FLIGHT_KEY
from terrace.lake import Lake
from terrace.operators.quality import IntegrityError, duplicate_keys
from terrace.plans import batch as job
from terrace.sinks.tables import read_batches


@pytest.fixture
def land(tmp_path, flights):
    """Write raw flights as CSV into the landing folder."""

    def write(name, *changes):
        target = tmp_path / "lake" / "landing" / "flights" / "year=2024" / name
        flights(*changes).toPandas().to_csv(_made(target), index=False)

    return write


def _made(path):
    path.parent.mkdir(parents=True, exist_ok=True)
    return path


def flight(number, **more):
    return {"Flight_Number_Reporting_Airline": str(number), **more}


def test_batch_run_and_its_increment(spark, tmp_path, land):
    lake = Lake(str(tmp_path / "lake"), prefix="batch_")
    january = [flight(i, FlightDate=f"2024-01-{1 + i % 9:02d}") for i in range(18)]
    land("01.csv", *january, january[0], flight(90, Origin="??"), flight(91, FlightDate="not-a-date"))
    result = job.run_batch(spark, lake)
    assert [r["rows"] for r in result["bronze"].collect()] == [21]
    assert tuple(result["silver"].first()) == (21, 18, 2, 1)
    assert {r["violations"] for r in result["gold"].collect()} == {0}
    assert spark.table(lake.gold("fact_flights")).count() == 18
    assert spark.table(lake.gold("dim_date")).count() == 9

    # A correction of one January flight, a February flight, one more bad row.
    land("02.csv", {**january[3], "ArrDelay": "99.00"}, flight(50, FlightDate="2024-02-01"), flight(92, Distance="0"))
    result = job.run_batch(spark, lake)
    assert tuple(result["silver"].first()) == (24, 19, 3, 2)
    silver = job.silver_table(spark, lake).read()
    assert duplicate_keys(silver, FLIGHT_KEY).count() == 0
    assert [r.arr_delay_min for r in silver.filter("flight_number = '3'").collect()] == [99]
    fact = spark.table(lake.gold("fact_flights"))
    assert fact.count() == 19 and len(fact.columns) == 22
    assert spark.table(lake.gold("dim_date")).filter("month_name = 'February'").count() == 1
    agg, carriers = spark.table(lake.gold("agg_daily_route")), spark.table(lake.gold("dim_carrier"))
    assert [r.flights for r in reports.on_time_by_carrier(agg, carriers).collect()] == [19]

    # Nothing new: nothing changes.
    result = job.run_batch(spark, lake)
    assert tuple(result["silver"].first()) == (24, 19, 3, 2)


def test_a_repeated_batch_does_not_repeat_quarantine_or_silver(spark, tmp_path, land, monkeypatch):
    """The upsert is published, then the run dies before the quarantine; the retry completes it."""
    lake = Lake(str(tmp_path / "lake"), prefix="retry_")
    land("01.csv", flight(1), flight(2, Origin="??"))
    job.run_bronze(spark, lake)
    write, calls = job.write_batch, []

    def die_once(*args):
        calls.append(args)
        if len(calls) == 1:
            raise RuntimeError("executor lost")
        write(*args)

    monkeypatch.setattr(job, "write_batch", die_once)
    with pytest.raises(Exception, match="executor lost"):
        job.run_silver(spark, lake)
    assert tuple(job.run_silver(spark, lake).first()) == (2, 1, 1, 0)
    assert len(calls) == 2
    write(*calls[1])
    assert read_batches(spark, job.quarantine_path(lake)).count() == 1


def test_older_file_that_comes_late(spark, tmp_path, flights):
    """Last batch wins by default; with newer_wins the arrival time decides."""
    newer = flights(flight(1, ArrDelay="2")).withColumn("_ingest_ts", F.lit("2024-03-02").cast("timestamp"))
    older = flights(flight(1, ArrDelay="1")).withColumn("_ingest_ts", F.lit("2024-03-01").cast("timestamp"))
    for newer_wins, expected in ((False, 1), (True, 2)):
        lake = Lake(str(tmp_path / str(newer_wins)))
        target = job.silver_table(spark, lake, newer_wins=newer_wins)
        for i, rows in enumerate((newer, older)):
            target.upsert(job.accepted(rows, job.FLIGHTS), i)
        assert [r.arr_delay_min for r in target.read().collect()] == [expected]


def test_broken_gold_stops_the_run(spark, tmp_path, flights, monkeypatch):
    lake = Lake(str(tmp_path / "lake"), prefix="broken_")
    job.create_schemas(spark, lake)
    silver = job.accepted(flights(flight(1), flight(2)), job.FLIGHTS)
    monkeypatch.setattr(job.model, "dim_carrier", lambda agg: agg.select("carrier_code", F.lit("x").alias("carrier_name")).limit(0))
    with pytest.raises(IntegrityError, match="dim_carrier.carrier_code: 2"):
        job.run_gold(spark, lake, silver)


def test_silver_before_any_file(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        job.run_silver(spark, Lake(str(tmp_path / "none")))


def test_command_line(spark, tmp_path, land, capsys):
    from terrace.__main__ import arguments, main

    assert arguments(["events", "--root", "/x", "--every", "30 seconds"]).every == "30 seconds"
    land("01.csv", flight(1), flight(2, Origin="??"))
    main(["batch", "--root", str(tmp_path / "lake"), "--prefix", "cli_"])
    printed = capsys.readouterr().out
    assert "duplicates_removed" in printed and "fact rows equal silver rows" in printed
