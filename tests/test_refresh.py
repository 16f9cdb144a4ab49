"""Incremental gold: only changed months are read and written, and the result is that of a rebuild."""

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from terrace.flights import model
from terrace.flights.contract import FLIGHTS
from terrace.lake import Lake, create_schemas
from terrace.operators.clean import accepted
from terrace.operators.quality import IntegrityError
from terrace.plans import refresh
from terrace.plans.refresh import Gold
from terrace.sinks.snapshot import SnapshotTable
from terrace.sinks.tables import name_for_sql


@pytest.fixture
def parts(spark, tmp_path):
    lake = Lake(str(tmp_path), prefix=f"r{abs(hash(str(tmp_path)))}_")
    create_schemas(spark, lake)
    silver = SnapshotTable(spark, f"{tmp_path}/silver_rows", FLIGHTS.key, ("flight_date", "month"), check_keys=False)
    return lake, silver, Gold(spark, lake)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def equal_to_rebuild(spark, lake, silver):
    for name, frame in model.star(silver.read()).items():
        assert rows(spark.table(lake.gold(name))) == rows(frame.select(*spark.table(lake.gold(name)).columns)), name


def test_a_corrected_month_alone_is_rewritten(spark, flights, parts):
    lake, silver, gold = parts
    first = [
        {"FlightDate": "2023-07-01"}, {"FlightDate": "2023-08-21"}, {"FlightDate": "2023-08-22", "Origin": "GEG", "OriginCityName": "Zzz"},
        {"FlightDate": "2023-09-02", "Reporting_Airline": "WN", "Dest": "SFO"},
    ]
    silver.upsert(accepted(flights(*first), FLIGHTS), 0)
    assert {r.violations for r in gold.refresh(silver).collect()} == {0}
    equal_to_rebuild(spark, lake, silver)
    before = gold.state()
    assert gold.refresh(silver).count() == 0 and gold.state() == before

    # The same key with another city: the old description has no rows left, though it sorts last.
    silver.upsert(accepted(flights({"FlightDate": "2023-08-22", "Origin": "GEG", "OriginCityName": "Aaa", "DepDelay": "99"}), FLIGHTS), 1)
    assert silver.changed_since(before["silver"]) == ["2023-08"]
    gold.refresh(silver)
    equal_to_rebuild(spark, lake, silver)
    after = gold.state()
    for name in refresh.BY_MONTH:
        assert after["tables"][name].keys() == {"2023-07", "2023-08", "2023-09"}
        assert {m for m in after["tables"][name] if after["tables"][name][m] != before["tables"][name][m]} == {"2023-08"}

    silver.upsert(accepted(flights({"FlightDate": "2024-01-05", "Reporting_Airline": "B6"}), FLIGHTS), 2)
    gold.refresh(silver)
    equal_to_rebuild(spark, lake, silver)


def test_other_months_are_not_read(spark, flights, parts, monkeypatch):
    lake, silver, gold = parts
    silver.upsert(accepted(flights({"FlightDate": "2023-07-01"}, {"FlightDate": "2023-08-21"}), FLIGHTS), 0)
    gold.refresh(silver)
    silver.upsert(accepted(flights({"FlightDate": "2023-08-21", "DepDelay": "1"}), FLIGHTS), 1)
    asked = []
    real = silver.rows_in
    monkeypatch.setattr(silver, "rows_in", lambda partitions, version=None: asked.append(list(partitions)) or real(partitions, version))
    monkeypatch.setattr(silver, "read", lambda: pytest.fail("all of silver was read"))
    gold.refresh(silver)
    assert asked == [["2023-08"], ["2023-08"]]  # as it is now, and as it was


def test_the_fact_is_written_as_silver_lies(spark, flights, parts, monkeypatch):
    """Silver's files hold a month each: the fact is made of them without another shuffle, and into no more files."""
    lake, silver, gold = parts
    days = [{"FlightDate": f"2023-{m:02}-{d:02}", "Flight_Number_Reporting_Airline": str(d)} for m in range(1, 13) for d in range(1, 29)]
    silver.upsert(accepted(flights(*days), FLIGHTS), 0)
    silver.upsert(accepted(flights({"FlightDate": "2023-03-05", "Flight_Number_Reporting_Airline": "5", "DepDelay": "99"}), FLIGHTS), 1)
    plans, real = {}, DataFrameWriter.parquet

    def noting(writer, path, *args, **kwargs):
        plans[path.rsplit("/", 1)[1]] = writer._df._sc._jvm.PythonSQLUtils.explainString(writer._df._jdf.queryExecution(), "simple")
        return real(writer, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", noting)
    bytes_before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    gold.refresh(silver)
    assert "hashpartitioning" not in plans["fact"] and "hashpartitioning" in plans["agg"]
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == bytes_before
    equal_to_rebuild(spark, lake, silver)
    held = spark.table(lake.gold("fact_flights")).select(F.input_file_name().alias("file"), F.floor(F.col("date_key") / 100).alias("month"))
    files = held.groupBy("file").agg(F.count_distinct("month").alias("months")).collect()
    assert {r.months for r in files} == {1}
    assert len(files) <= silver.read().select(F.input_file_name()).distinct().count()


def test_a_version_that_is_gone_means_all_anew(spark, flights, parts):
    lake, silver, gold = parts
    silver.upsert(accepted(flights({"FlightDate": "2023-07-01"}), FLIGHTS), 0)
    gold.refresh(silver)
    silver.retain, silver.retain_hours = 1, 0
    for n in (1, 2, 3):
        silver.upsert(accepted(flights({"FlightDate": f"2023-0{n}-01"}), FLIGHTS), n)
    assert silver.changed_since(gold.state()["silver"]) is None
    gold.refresh(silver)
    equal_to_rebuild(spark, lake, silver)


def test_a_broken_check_keeps_the_published_version(spark, flights, parts, monkeypatch):
    lake, silver, gold = parts
    silver.upsert(accepted(flights({"FlightDate": "2023-07-01"}), FLIGHTS), 0)
    gold.refresh(silver)
    before, shown = gold.state(), rows(spark.table(lake.gold("fact_flights")))
    silver.upsert(accepted(flights({"FlightDate": "2023-08-01", "Reporting_Airline": "WN"}), FLIGHTS), 1)
    real = refresh.dimensions_of
    monkeypatch.setattr(refresh, "dimensions_of", lambda counted: real(counted.filter("name <> 'WN' or name is null")))
    with pytest.raises(IntegrityError, match="dim_carrier"):
        gold.refresh(silver)
    assert gold.state() == before and rows(spark.table(lake.gold("fact_flights"))) == shown


def test_names_over_no_one_and_many_folders(spark, tmp_path):
    lake = Lake(str(tmp_path), prefix=f"n{abs(hash(str(tmp_path)))}_")
    create_schemas(spark, lake)
    schema = spark.range(1).schema
    name_for_sql(spark, lake.gold("t"), [], schema)
    assert spark.table(lake.gold("t")).count() == 0
    places = [f"{tmp_path}/x/_v={n}/p" for n in (1, 2, 3)]
    for n, place in enumerate(places):
        spark.range(n, n + 1).write.parquet(place)
        name_for_sql(spark, lake.gold("t"), places[: n + 1], schema)
        assert spark.table(lake.gold("t")).count() == n + 1
    with pytest.raises(ValueError, match="special"):
        name_for_sql(spark, lake.gold("t"), ["/a{b"], schema)
