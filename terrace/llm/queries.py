"""The registered queries: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm import (
    decontaminate, language_id, line_dedup, near_duplicates, packing, periodic_runs, prefix_trie, quality_classifier, quality_rules, sharding,
    token_counts, toxicity, warc,
)
from terrace.llm.shared import shared_folder, table

Query = Callable[[SparkSession, str], DataFrame]

_registry: dict[str, Query] = {}


def query(function: Query) -> Query:
    _registry[function.__name__] = function
    return function


def registered() -> dict[str, Query]:
    return dict(_registry)


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rollup = token_counts.Rollup(spark, shared_folder(spark, "token-counts"))
    return token_counts.counts_after_cleaning(table(spark, sf_dir, "documents"), rollup)


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


@query
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), "kept"))  # also where a doc_id repeats


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents")).drop("cleaned_text")


@query
def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def made_periodic(docs: DataFrame) -> DataFrame:
    """doc_id and text; of a document whose h = crc32(doc_id) is divisible by ten, the words from a on repeat with period p."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("_g"), F.when(h % 10 == 0, words).alias("_words"))
    rows = rows.withColumn("_n", F.size("_words")).withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")).cast("int"))
    rows = rows.withColumn("_p", (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))
    a, p = F.col("_a"), F.col("_p")
    place = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p))
    made = F.array_join(F.transform(place, lambda i: F.get("_words", i)), " ")
    return rows.select("doc_id", F.when(F.col("_a").isNotNull(), made).otherwise(F.col("text")).alias("text"))


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(made_periodic(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("_best"), lines.alias("_lines"), "collapsed_text")
    length, start, period = F.col("_best.length"), -F.col("_best.col2"), -F.col("_best.col3")
    return rows.select(
        "doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join("_lines", ""), 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )


def with_shared_heads(conversations: DataFrame) -> DataFrame:
    """Digested conversations c, whose first h = crc32(c) % 4 turns are those of c - c % 20."""
    own = prefix_trie.digested(conversations)
    heads = own.where(F.col("conv_id") % 20 == 0).select(F.col("conv_id").alias("_head"), F.slice("turns", 1, 3).alias("_turns"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    rows = own.join(heads, F.col("conv_id") - F.col("conv_id") % 20 == F.col("_head"), "left")
    first = F.slice(F.coalesce("_turns", F.slice("turns", 1, 0)), F.lit(1), h)
    return rows.select("conv_id", F.concat(first, F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(with_shared_heads(table(spark, sf_dir, "conversations")))
