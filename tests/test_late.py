"""Late events as a result, off-heap state, typed orphan keys."""

from datetime import datetime
from decimal import Decimal

from terrace.lake import Lake
from terrace.operators.quality import orphans
from terrace.plans.events import EVENTS, late_events, run_events
from terrace.spec import Reference
from terrace.streaming import events as ev
from terrace.streaming.late import LateSplit
from terrace.streaming.run import DRAIN, append_to_table, finish, off_heap_state, state_report
from terrace.sources.files import text_events


def times(df):
    return sorted((r.event_id, r.event_ts.strftime("%H:%M")) for r in df.collect())


def test_rows_behind_earlier_batches_are_late(spark, tmp_path, bodies, event):
    split = LateSplit(spark, str(tmp_path / "s"))
    batches = [
        [("a", "2023-08-21T09:00:00Z"), ("b", "2023-08-21T05:00:00Z")],  # one batch's own order does not matter
        [("c", "2023-08-21T08:50:00Z"), ("d", "2023-08-21T08:49:59Z"), ("e", "2023-08-21T10:00:00Z")],
        [],
        [("f", "2023-08-21T09:49:00Z"), ("g", "2023-08-21T09:55:00Z"), ("f", "2023-08-21T09:49:00Z")],
    ]
    schema = None
    for n, batch in enumerate(batches):
        rows = ev.parse_events(bodies(*[event(event_id=i, event_ts=t) for i, t in batch])) if batch else spark.createDataFrame([], schema)
        schema = rows.schema
        for _ in range(2):  # every batch is sent twice, as after a failure
            split.split(rows, n, "w")
    assert times(split.late(schema)) == [("d", "08:49"), ("f", "09:49"), ("f", "09:49")]
    assert times(split.on_time(schema)) == [("a", "09:00"), ("b", "05:00"), ("c", "08:50"), ("e", "10:00"), ("g", "09:55")]
    assert [m.strftime("%H:%M") for m in split.marks()] == ["09:00", "10:00", "10:00", "10:00"]


def test_rows_without_a_time_are_on_time(spark, tmp_path):
    split = LateSplit(spark, str(tmp_path / "s"), time="t")
    rows = spark.createDataFrame([(1, datetime(2023, 1, 1)), (2, None)], "id int, t timestamp")
    split.split(rows, 0)
    split.split(rows.limit(0), 1)
    split.split(spark.createDataFrame([(3, None), (4, datetime(2022, 1, 1))], rows.schema), 2)
    assert [r.id for r in split.late(rows.schema).collect()] == [4]
    assert sorted(r.id for r in split.on_time(rows.schema).collect()) == [1, 2, 3]


def test_the_event_job_keeps_late_events_and_state_off_the_heap(spark, tmp_path, event):
    lake = Lake(str(tmp_path), prefix="late_")
    folder = tmp_path / "landing" / "events"
    folder.mkdir(parents=True)
    (folder / "a.json").write_text("\n".join([event(event_id="a", event_ts="2023-08-21T09:00:00Z")] * 3))
    run_events(spark, lake, spread=2, off_heap=True, keep_late=True)
    (folder / "b.json").write_text("\n".join([event(event_id="a", event_ts="2023-08-21T09:00:00Z"), event(event_id="b", event_ts="2023-08-21T05:00:00Z")]))
    queries = run_events(spark, lake, spread=2, off_heap=True, keep_late=True)
    schema = spark.table(lake.table("silver", EVENTS)).schema
    assert times(late_events(spark, lake).late(schema)) == [("b", "05:00")]
    assert len(times(late_events(spark, lake).on_time(schema))) == 4
    assert times(spark.table(lake.table("silver", EVENTS))) == [("a", "09:00")]  # the repeat is known after a restart
    assert len(queries) == 4 and spark.table(lake.gold("live_airport_delays")).count() == 1
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", "")


def test_rocksdb_state_survives_a_restart_and_is_reported(spark, tmp_path, event):
    source = tmp_path / "in"
    source.mkdir()
    reports = []
    for n in range(2):
        (source / f"{n}.json").write_text("\n".join(event(event_id=f"e{k}", event_ts="2023-08-21T09:00:00Z") for k in range(5 + 3 * n)))
        with off_heap_state(spark):
            once = ev.dedupe_events(ev.parse_events(text_events(spark, str(source))))
            query = finish(append_to_table(once, "late_once", str(tmp_path / "out"), str(tmp_path / "ck")), DRAIN)
        reports.append(next(r for r in state_report(query) if "dedup" in r["operator"].lower()))
    assert spark.table("late_once").count() == 8
    assert reports[-1]["rows"] >= 5 and reports[-1]["bytes"] > 0
    assert list((tmp_path / "ck" / "state").rglob("*.zip")) or list((tmp_path / "ck" / "state").rglob("*.changelog"))


def test_keys_are_compared_by_value_where_types_differ(spark):
    fact = spark.createDataFrame(
        [(1, Decimal("2.50"), datetime(2023, 1, 1), "7"), (9, Decimal("3.00"), datetime(2023, 1, 1, 5), "07"), (None, None, None, None)],
        "a int, b decimal(6,2), t timestamp, s string",
    )
    dims = {
        "da": spark.createDataFrame([(Decimal("1.00"),)], "k decimal(5,2)"), "db": spark.createDataFrame([(2.5,), (3.0,)], "k double"),
        "dt": spark.sql("select date'2023-01-01' as k"), "ds": spark.createDataFrame([("7",)], "k string"),
    }
    references = [Reference("da", "a", "k"), Reference("db", "b", "k"), Reference("dt", "t", "k"), Reference("ds", "s", "k")]
    assert {r.reference: r.orphan_rows for r in orphans(fact, dims, references).collect()} == {"da.a": 2, "db.b": 1, "dt.t": 2, "ds.s": 2}
