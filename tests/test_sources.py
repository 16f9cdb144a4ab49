import json

import pytest
from pyspark.sql import functions as F

from terrace.lake import Lake
from terrace.plans.batch import bronze_rows, file_ledger, run_bronze
from terrace.sources.files import headers_of, read_csv
from terrace.sources.kafka import LOGIN_CLASS, SHADED_PREFIX, kafka_options, records


def test_kafka_options():
    options = kafka_options("space", "flight-events", "Endpoint=sb://x/;SharedAccessKey=abc=")
    assert options["kafka.bootstrap.servers"] == "space.servicebus.windows.net:9093"
    assert options["subscribe"] == "flight-events"
    assert options["kafka.sasl.jaas.config"] == (
        f'{LOGIN_CLASS} required username="$ConnectionString" password="Endpoint=sb://x/;SharedAccessKey=abc=";'
    )
    assert (options["kafka.security.protocol"], options["kafka.sasl.mechanism"]) == ("SASL_SSL", "PLAIN")
    assert (options["startingOffsets"], options["failOnDataLoss"]) == ("earliest", "false")
    assert kafka_options("s", "t", "c", SHADED_PREFIX)["kafka.sasl.jaas.config"].startswith("kafkashaded.org.apache.kafka")
    with pytest.raises(ValueError):
        kafka_options("s", "t", 'a"b')


def test_kafka_records(spark):
    row = records(
        spark.createDataFrame(
            [(bytearray(b"k"), bytearray(b"{}"), "topic", 3, 42)], "key binary, value binary, topic string, partition int, offset long"
        ).withColumn("timestamp", F.current_timestamp())
    ).first()
    assert (row.body, row.partition, row.offset) == ("{}", 3, 42) and row.enqueued_ts is not None


@pytest.fixture
def landing(tmp_path):
    """Writes landing files: land("a.csv", "A,B", "1,2")."""
    folder = tmp_path / "landing" / "feed"

    def land(name, *lines):
        target = folder / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text("\n".join(lines) + ("\n" if lines else ""))

    return land


def ingest(spark, tmp_path, **options):
    return run_bronze(spark, Lake(str(tmp_path)), feed="feed", **options)


def bronze(spark, tmp_path):
    rows = bronze_rows(spark, Lake(str(tmp_path)), "feed")
    return rows.columns, sorted((tuple(r)[:-2] for r in rows.collect()), key=str)


def test_each_file_is_ingested_once_and_others_ignored(spark, tmp_path, landing):
    landing("a.csv", "A,B", "1,2", "3,4")
    landing("readme.html", "<html>")
    landing("empty.csv")
    first = ingest(spark, tmp_path)
    assert [(r._source_file.rsplit("/", 1)[1], r["rows"]) for r in first.collect()] == [("a.csv", 2)]
    landing("b.csv", "A,B", "5,6")
    assert [r["rows"] for r in ingest(spark, tmp_path).collect()] == [2, 1]
    assert ingest(spark, tmp_path).count() == 2
    columns, rows = bronze(spark, tmp_path)
    assert columns == ["A", "B", "_rescued_data", "_ingest_ts", "_source_file"]
    assert rows == [("1", "2", None), ("3", "4", None), ("5", "6", None)]


def test_drifted_headers_are_aligned_by_name_and_the_rest_rescued(spark, tmp_path, landing):
    landing("a.csv", "A,B", "1,2")
    ingest(spark, tmp_path)
    landing("b.csv", "B,A,C", "20,10,30", "21,11,")
    landing("c.csv", "a,B", "x,y")
    ingest(spark, tmp_path)
    _, rows = bronze(spark, tmp_path)
    assert sorted(rows, key=str) == sorted(
        [("1", "2", None), ("10", "20", '{"C":"30"}'), ("11", "21", None), (None, "y", '{"a":"x"}')], key=str
    )


def test_first_files_pin_the_union_of_their_columns(spark, tmp_path, landing):
    landing("a.csv", "A,B", "1,2")
    landing("b.csv", "B,A,C d", "20,10,30")
    ingest(spark, tmp_path)
    columns, rows = bronze(spark, tmp_path)
    assert columns[:3] == ["A", "B", "C_d"]
    assert rows == [("1", "2", None, None), ("10", "20", "30", None)]


def test_folder_names_do_not_replace_file_columns(spark, tmp_path, landing):
    landing("year=2024/month=01/a.csv", "Year,Month,X", "2023,7,x")
    ingest(spark, tmp_path)
    assert bronze(spark, tmp_path)[1] == [("2023", "7", "x", None)]
    assert tuple(read_csv(spark, str(tmp_path / "landing" / "feed")).first()) == ("2023", "7", "x")


def test_quoted_headers_and_values(spark, tmp_path, landing):
    landing("a.csv", '﻿"City, State","N"', '"Boise, ID",1')
    ingest(spark, tmp_path)
    columns, rows = bronze(spark, tmp_path)
    assert columns[:2] == ["City__State", "N"] and rows == [("Boise, ID", "1", None)]


def test_repeated_header_names_keep_both_values(spark, tmp_path, landing):
    landing("a.csv", "A,A,B", "1,2,3")
    ingest(spark, tmp_path)
    (row,) = bronze(spark, tmp_path)[1]
    assert row[:2] == ("1", "3") and json.loads(row[2]) == {"A#1": "2"}


def test_small_batches_give_the_same_rows(spark, tmp_path, landing):
    for i in range(5):
        landing(f"{i}.csv", "A,B", f"{i},x")
    ingest(spark, tmp_path, files_per_batch=2)
    assert [r[0] for r in bronze(spark, tmp_path)[1]] == list("01234")


def test_headers_are_read_for_many_files(spark, tmp_path, landing):
    for i in range(50):
        landing(f"{i}.csv", f"A,B{i % 3}", "1,2")
    paths = [str(p) for p in (tmp_path / "landing" / "feed").iterdir()]
    assert set(headers_of(spark, paths).values()) == {("A", "B0"), ("A", "B1"), ("A", "B2")}


def test_a_file_dated_far_back_is_ingested_later(spark, tmp_path):
    import os
    import time

    lake = Lake(str(tmp_path / "aged"))
    folder = tmp_path / "aged" / "landing" / "flights"
    folder.mkdir(parents=True)
    (folder / "now.csv").write_text("A,B\n1,2\n")
    run_bronze(spark, lake)
    (folder / "old.csv").write_text("A,B\n3,4\n")
    before = time.time() - 40 * 86400
    os.utime(folder / "old.csv", (before, before))
    run_bronze(spark, lake)
    assert {(r.A, r.B) for r in bronze_rows(spark, lake).collect()} == {("1", "2"), ("3", "4")}


def test_fields_beyond_the_header_are_rescued(spark, tmp_path):
    lake = Lake(str(tmp_path / "surplus"))
    folder = tmp_path / "surplus" / "landing" / "flights"
    folder.mkdir(parents=True)
    (folder / "a.csv").write_text("A,B\n1,2,3\n4,5\n6\n7,8,,9\n")
    run_bronze(spark, lake)
    rows = {r.A: (r.B, json.loads(r._rescued_data) if r._rescued_data else None) for r in bronze_rows(spark, lake).collect()}
    assert rows == {
        "1": ("2", {"_surplus_row": "1,2,3"}), "4": ("5", None), "6": (None, None), "7": ("8", {"_surplus_row": "7,8,,9"}),
    }


def test_far_fields_quotes_and_blank_ends(spark, tmp_path, landing):
    lines = ['1,2,,,,,x', '3,4,,,,,', '5', '"a,b",6,', '"c,d","e ""f""",y', '7,8, ,"z,z"', '9,"q", \t']
    landing("a.csv", "A,B", *lines)
    ingest(spark, tmp_path)
    _, rows = bronze(spark, tmp_path)
    got = {r[0]: (r[1], json.loads(r[2]) if r[2] else None) for r in rows}
    surplus = {r: v["_surplus_row"] for r, (_, v) in got.items() if v}
    assert surplus == {"1": "1,2,,,,,x", "c,d": '"c,d","e ""f""",y', "7": '7,8, ,"z,z"'}
    assert {k: v[0] for k, v in got.items()} == {"1": "2", "3": "4", "5": None, "a,b": "6", "c,d": '"e ""f"""', "7": "8", "9": "q"}


def test_names_that_differ_in_case_only_do_not_stop_the_load(spark, tmp_path, landing):
    landing("a.csv", "A,B b", "1,2")
    landing("b.csv", "a,B,B-b", "3,4,5")
    ingest(spark, tmp_path)
    columns, rows = bronze(spark, tmp_path)
    assert columns[:3] == ["A", "B_b", "B"]
    assert sorted(rows, key=str) == sorted([("1", "2", None, None), (None, None, "4", '{"a":"3","B-b":"5"}')], key=str)


@pytest.mark.parametrize("files_per_batch", [1, 2, 10])
def test_columns_do_not_depend_on_the_batches(spark, tmp_path, landing, files_per_batch):
    for k in range(4):
        landing(f"{k}.csv", f"A,X{k}", f"{k},x")
    ingest(spark, tmp_path, files_per_batch=files_per_batch)
    columns, rows = bronze(spark, tmp_path)
    assert columns[:6] == ["A", "X0", "X1", "X2", "X3", "_rescued_data"] and all(r[5] is None for r in rows)
    landing("late.csv", "A,Y", "9,y")
    ingest(spark, tmp_path, files_per_batch=files_per_batch)
    assert ("9", None, None, None, None, '{"Y":"y"}') in bronze(spark, tmp_path)[1]


def test_declared_columns_and_a_file_without_line_breaks(spark, tmp_path, landing):
    landing("a.csv", "A,B", "1,2")
    ingest(spark, tmp_path, columns=["B", "Z"])
    columns, rows = bronze(spark, tmp_path)
    assert columns[:2] == ["B", "Z"] and rows == [("2", None, '{"A":"1"}')]
    landing("b.csv", "x" * (3 << 20))
    with pytest.raises(Exception, match="no line break"):
        headers_of(spark, [str(tmp_path / "landing" / "feed" / "b.csv")])


def test_a_ledger_finds_new_and_replaced_files_and_repeats_unnoted_work(spark, tmp_path, landing):
    lake = Lake(str(tmp_path))
    for k in range(5):
        landing(f"{k}.csv", "A,B", f"{k},x")
    landing("empty.csv")
    ingest(spark, tmp_path, by_ledger=True, files_per_batch=2)
    ledger = file_ledger(spark, lake, "feed")
    assert sorted(r.batch for r in ledger.rows().collect()) == [0, 0, 1, 1, 2]
    assert ledger.pending(lake.landing("feed"), "*.csv").count() == 0

    landing("1.csv", "A,B", "1,other", "1,more")
    landing("5.csv", "B,A", "y,5")
    found = {r.path.rsplit("/", 1)[1]: r.replaced for r in ledger.pending(lake.landing("feed"), "*.csv").collect()}
    assert found == {"1.csv": True, "5.csv": False}
    failing = []

    def fail_once(paths, batch_id, writer):
        failing.append(batch_id)
        raise RuntimeError("stopped")

    with pytest.raises(RuntimeError):
        ledger.load(lake.landing("feed"), "*.csv", 10, fail_once)
    ingest(spark, tmp_path, by_ledger=True)
    ingest(spark, tmp_path, by_ledger=True)
    assert failing == [3] and ledger.next_batch() == 4
    _, rows = bronze(spark, tmp_path)
    assert sorted(r[:2] for r in rows) == [("0", "x"), ("1", "more"), ("1", "other"), ("1", "x"), ("2", "x"), ("3", "x"), ("4", "x"), ("5", "y")]
