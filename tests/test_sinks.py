import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from terrace.lake import Lake, create_schemas, materialize, scratch
from terrace.sinks import fs
from terrace.sinks.snapshot import SnapshotTable
from terrace.sinks.tables import clustered, create_if_absent, interleaved, read_batches, rebuild, write_batch

DDL = "id int, day date, value string"


@pytest.fixture
def rows(spark):
    def build(*triples):
        text = spark.createDataFrame(list(triples), "id int, day string, value string")
        return text.withColumn("day", F.col("day").cast("date"))

    return build


@pytest.fixture
def table(spark, tmp_path):
    return SnapshotTable(spark, str(tmp_path / "t"), ["id", "day"], ("day", "month"))


def content(table):
    return {(r.id, str(r.day)): r.value for r in table.read().collect()}


JAN, FEB, MAR = "2024-01-05", "2024-02-05", "2024-03-05"


def test_upsert_updates_and_inserts(table, rows):
    assert not table.exists()
    table.upsert(rows((1, JAN, "a"), (2, JAN, "b"), (3, FEB, "c")), 0)
    table.upsert(rows((2, JAN, "B"), (4, JAN, "d"), (5, MAR, "e")), 1)
    assert content(table) == {(1, JAN): "a", (2, JAN): "B", (4, JAN): "d", (3, FEB): "c", (5, MAR): "e"}
    assert table.read().columns == ["id", "day", "value"]


def test_untouched_partitions_are_not_rewritten(table, rows):
    table.upsert(rows((1, JAN, "a"), (3, FEB, "c")), 0)
    table.upsert(rows((1, JAN, "A")), 1)
    partitions = table._manifest()["partitions"]
    assert partitions["_part=2024-02"] == ["_version=0000000001/_rows=in"]
    assert partitions["_part=2024-01"] == ["_version=0000000002/_rows=in"]


def test_replayed_batch_changes_nothing(table, rows):
    assert table.upsert(rows((1, JAN, "a")), 0, "w")
    assert table.upsert(rows((1, JAN, "b")), 1, "w")
    assert not table.upsert(rows((1, JAN, "b")), 1, "w")
    assert not table.upsert(rows((1, JAN, "a")), 0, "w")
    assert content(table) == {(1, JAN): "b"}


def test_new_writer_starts_again_at_batch_zero(table, rows):
    table.upsert(rows((1, JAN, "a")), 5, "old")
    assert table.upsert(rows((2, JAN, "b")), 0, "new")
    assert len(content(table)) == 2


def test_attempt_that_died_before_publishing_is_invisible(table, rows, spark, monkeypatch):
    table.upsert(rows((1, JAN, "a")), 0)

    def die(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(fs, "write_text_once", die)
        with pytest.raises(RuntimeError):
            table.upsert(rows((1, JAN, "b"), (2, JAN, "c")), 1)
    assert content(table) == {(1, JAN): "a"}
    table.upsert(rows((1, JAN, "b"), (2, FEB, "c")), 1)
    assert content(table) == {(1, JAN): "b", (2, FEB): "c"}


def test_two_rows_for_one_key_are_refused(table, rows):
    with pytest.raises(ValueError, match="several rows for one key"):
        table.upsert(rows((1, JAN, "a"), (1, JAN, "b")), 0)
    assert not table.exists()


def test_newer_wins(spark, tmp_path, rows):
    table = SnapshotTable(spark, str(tmp_path / "t"), ["id", "day"], ("day", "month"), newest="value")
    table.upsert(rows((1, JAN, "5"), (2, JAN, "5"), (3, JAN, "5")), 0)
    table.upsert(rows((1, JAN, "4"), (2, JAN, "6"), (3, JAN, "5"), (4, JAN, "1"), (5, FEB, "1")), 1)
    got = {k[0]: v for k, v in content(table).items()}
    assert got == {1: "5", 2: "6", 3: "5", 4: "1", 5: "1"}


def test_all_rows_of_a_partition_can_be_outdated_or_replaced(spark, tmp_path, rows):
    table = SnapshotTable(spark, str(tmp_path / "t"), ["id", "day"], ("day", "month"), newest="value")
    table.upsert(rows((1, JAN, "5")), 0)
    table.upsert(rows((1, JAN, "4")), 1)
    assert content(table) == {(1, JAN): "5"}
    table.upsert(rows((1, JAN, "6")), 2)
    assert content(table) == {(1, JAN): "6"}


def test_old_versions_expire_but_used_folders_stay(spark, tmp_path, rows):
    table = SnapshotTable(spark, str(tmp_path / "t"), ["id", "day"], ("day", "month"), retain=2, retain_hours=0)
    table.upsert(rows((9, FEB, "kept")), 0)
    for i in range(1, 6):
        table.upsert(rows((1, JAN, str(i))), i)
    assert content(table) == {(9, FEB): "kept", (1, JAN): "5"}
    folders = [n for n in fs.children(spark, table.path) if n.startswith("_version=")]
    assert folders == ["_version=0000000001", "_version=0000000005", "_version=0000000006"]
    assert len(table._versions()) == 2


def test_empty_batch(table, rows):
    table.upsert(rows((1, JAN, "a")).limit(0), 0)
    assert table.exists() and table.read().count() == 0
    table.upsert(rows((1, JAN, "a")), 1)
    assert content(table) == {(1, JAN): "a"}


def test_partition_column_belongs_to_the_key(spark):
    with pytest.raises(ValueError, match="part of the key"):
        SnapshotTable(spark, "/nowhere", ["id"], ("day", "month"))


def test_hot_partition_is_spread_over_files(spark, tmp_path):
    """Rebalancing splits a partition value that holds nearly all rows; without it one task writes all."""
    table = SnapshotTable(spark, str(tmp_path / "t"), ["id", "day"], ("day", "month"), check_keys=False)
    hot = spark.range(400_000).select(
        F.col("id").cast("int"), F.lit(JAN).cast("date").alias("day"), F.sha2(F.col("id").cast("string"), 256).alias("value")
    )
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4m")
    try:
        table.upsert(hot, 0)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    files = [f for f in fs.children(spark, f"{table.path}/_version=0000000001/_rows=in/_part=2024-01") if f.endswith(".parquet")]
    assert len(files) > 3 and table.read().count() == 400_000


def test_batch_append_is_exactly_once(spark, tmp_path):
    path = str(tmp_path / "b")
    write_batch(spark.range(3), path, 0)
    write_batch(spark.range(5), path, 1)
    write_batch(spark.range(5), path, 1)
    assert read_batches(spark, path).count() == 8 and read_batches(spark, path).columns == ["id"]
    empty = read_batches(spark, str(tmp_path / "none"), StructType.fromDDL(DDL))
    assert empty.count() == 0
    with pytest.raises(FileNotFoundError):
        read_batches(spark, str(tmp_path / "none"))


def test_clustered_layout_lets_filters_skip_files(spark, tmp_path):
    rows = spark.range(40_000).select((F.col("id") % 400).alias("d"), (F.col("id") % 7).alias("c"), "id")
    path = str(tmp_path / "c")
    clustered(rows, ["d", "c"], 8).write.parquet(path)
    ranges = (
        spark.read.parquet(path)
        .groupBy(F.col("_metadata.file_path"))
        .agg(F.min("d").alias("low"), F.max("d").alias("high"), F.count("*").alias("n"))
        .collect()
    )
    assert len(ranges) == 8 and sum(r.n for r in ranges) == 40_000
    assert len([r for r in ranges if r.low <= 200 <= r.high]) <= 2


def test_clustered_layout_splits_a_hot_combination(spark, tmp_path):
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).alias("d"), "id")
    sizes = clustered(rows, ["d"], 6).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 9_000


def test_interleaved_layout_lets_a_filter_on_either_column_skip_files(spark, tmp_path):
    rows = spark.range(40_000).select(
        F.date_add(F.lit("2023-01-01").cast("date"), (F.col("id") % 365).cast("int")).alias("day"),
        F.concat(F.lit("C"), F.char((65 + F.xxhash64("id") % 13 + 13).cast("int"))).alias("code"), "id",
    )
    path = str(tmp_path / "z")
    interleaved(rows, ["day", "code"], 16).write.parquet(path)
    stored = spark.read.parquet(path)
    assert stored.count() == 40_000 and stored.columns == rows.columns and stored.select("id").distinct().count() == 40_000
    low_high = [f(c).alias(f"{f.__name__}_{c}") for c in ("day", "code") for f in (F.min, F.max)]
    files = stored.groupBy(F.col("_metadata.file_path")).agg(F.count("*").alias("n"), *low_high).collect()
    assert len(files) == 16 and max(f.n for f in files) < 5_000
    for column, values in (("day", [r.day for r in rows.select("day").distinct().collect()]), ("code", [r.code for r in rows.select("code").distinct().collect()])):
        hit = [sum(f[f"min_{column}"] <= v <= f[f"max_{column}"] for f in files) for v in values]
        assert sum(hit) / len(hit) <= 8, column  # of 16
    # Spark skips what the statistics allow: fewer rows leave the scan than there are.
    wanted = stored.filter("code = 'CN'")
    wanted.write.format("noop").mode("overwrite").save()
    pushed = spark.read.parquet(path).filter("code = 'CN'")
    assert "PushedFilters: [IsNotNull(code), EqualTo(code,CN)]" in pushed._sc._jvm.PythonSQLUtils.explainString(pushed._jdf.queryExecution(), "formatted")


def test_interleaved_layout_takes_nulls_hot_cells_and_clashing_names(spark):
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") % 30 == 0, None).otherwise(F.col("id").cast("string")).alias("a"),
        (F.col("id") / 7).alias("b"), (F.col("id") % 2 == 0).alias("_cell"), F.timestamp_micros("id").alias("_place"), "id",
    )
    laid_out = interleaved(rows, ["a", "b", "_cell", "_place"], 10)
    sizes = laid_out.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 6_000 and sum(r["count"] for r in sizes) == 30_000
    assert laid_out.columns == rows.columns and laid_out.exceptAll(rows).isEmpty()
    assert interleaved(rows.limit(0), ["a", "b"], 4).isEmpty()


def test_interleaved_layout_takes_its_quantiles_from_sketches_of_any_numbers(spark, monkeypatch):
    """Quantiles by percentile_approx sort every value that goes in; columns without a number are laid out as well."""
    monkeypatch.setattr(F, "percentile_approx", None)
    kinds = [float("nan"), float("-inf"), float("inf"), None, 1.0]
    rows = spark.createDataFrame([(kinds[i % 5], float("nan"), i) for i in range(500)], "a double, b double, id long")
    laid_out = interleaved(rows, ["a", "b"], 5)
    sizes = laid_out.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == 500 and len(sizes) == 5 and max(r["count"] for r in sizes) < 200
    assert laid_out.select("id").distinct().count() == 500


def test_tables_are_created_once_and_rebuilt_with_their_schema(spark, tmp_path):
    lake = Lake(str(tmp_path), prefix="sinks_")
    assert create_schemas(spark, lake) == create_schemas(spark, lake)
    name, path = lake.gold("x"), lake.path("gold", "x")
    assert create_if_absent(spark, name, StructType.fromDDL(DDL), path)
    assert not create_if_absent(spark, name, StructType.fromDDL(DDL), path)
    assert spark.table(name).count() == 0 and spark.table(name).columns == ["id", "day", "value"]
    assert rebuild(spark.range(4), name, path).columns == ["id"]
    assert rebuild(spark.range(2).withColumn("more", F.lit(1)), name, path).columns == ["id", "more"]
    assert spark.table(name).count() == 2


def test_lake_names():
    lake = Lake("/data/lake/", catalog="main", prefix="dev_")
    assert lake.table("silver", "flights") == "main.dev_silver.flights"
    assert lake.landing("flights") == "/data/lake/landing/flights"
    assert lake.checkpoint("bronze", "flights") == "/data/lake/meta/checkpoints/bronze/flights"
    with pytest.raises(ValueError, match="unknown layer"):
        lake.table("copper", "x")


def test_scratch_lies_in_the_shared_folder(spark):
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert scratch(spark, "x").startswith(shared) and scratch(spark, "x") != scratch(spark, "x")
    stored = materialize(spark.range(5).withColumn("p", F.lit("q")), "x")
    assert stored.count() == 5 and stored.columns == ["id", "p"]


def test_text_files_are_written_once(spark, tmp_path):
    path = str(tmp_path / "m" / "1.json")
    fs.write_text_once(spark, path, "äöü")
    assert fs.read_text(spark, path) == "äöü" and fs.first_line(spark, path) == "äöü"
    with pytest.raises(FileExistsError):
        fs.write_text_once(spark, path, "other")
    assert fs.children(spark, str(tmp_path / "m")) == ["1.json"]
    fs.remove(spark, path)
    assert not fs.exists(spark, path)


def test_batches_of_two_writers_with_one_id_both_stay(spark, tmp_path):
    path = str(tmp_path / "appended")
    write_batch(spark.range(2), path, 0, "first checkpoint")
    write_batch(spark.range(2), path, 0, "second checkpoint")
    write_batch(spark.range(3), path, 0, "second checkpoint")
    assert read_batches(spark, path).count() == 5


def test_partitions_do_not_follow_the_session_zone(spark, tmp_path):
    target = SnapshotTable(spark, str(tmp_path / "zones"), ["ts"], ("ts", "day"))
    moment = "timestamp_seconds(1692664200)"  # 00:30 UTC
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for number, name in enumerate(("UTC", "America/New_York")):
            spark.conf.set("spark.sql.session.timeZone", name)
            target.upsert(spark.sql(f"select {moment} as ts, {number} as v"), number)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert [r.v for r in target.read().collect()] == [1]


def test_a_dead_attempt_leaves_nothing_under_dynamic_overwrite(spark, tmp_path):
    target = SnapshotTable(spark, str(tmp_path / "dead"), ["id", "d"], ("d", "month"))
    spark.sql("select 9 as id, '2023-03' as _part").write.partitionBy("_part").parquet(str(tmp_path / "dead/_version=0000000001/_rows=in"))
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        target.upsert(spark.sql("select 1 as id, date'2023-01-05' as d"), 0)
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
    assert [r.id for r in target.read().collect()] == [1]


def test_a_batch_without_a_stored_column_is_refused(spark, tmp_path):
    target = SnapshotTable(spark, str(tmp_path / "columns"), ["id", "d"], ("d", "month"))
    target.upsert(spark.sql("select 1 as id, date'2023-01-05' as d, 7 as v"), 0)
    with pytest.raises(ValueError, match="column v"):
        target.upsert(spark.sql("select 2 as id, date'2023-01-05' as d"), 1)
    target.upsert(spark.sql("select 2 as id, date'2023-01-05' as d, 8 as v, 'x' as w"), 1)
    assert {(r.id, r.v, r.w) for r in target.read().collect()} == {(1, 7, None), (2, 8, "x")}
