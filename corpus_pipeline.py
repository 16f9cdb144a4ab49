"""The corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next
stage's docs. All but the last return the columns of documents. Stages that drop documents keep all others as they
are; line dedup cuts lines and drops a document only if no line with a word is left of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrace.llm import decontaminate, line_dedup, near_duplicates, packing, toxicity
from terrace.llm.shared import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Near duplicates from a similarity of 0.8 on (the query op9 has 0.85 by its contract). With 64 bands of 5, a pair at
#: the threshold shares no bucket with probability 1e-11.
NEAR = near_duplicates.Settings(percent=80, bands=64, rows=5)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic. It learns from the labels of documents in ``docs``."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).where("predicted = 0").select(*COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one are cut; n_chars follows the text where it was cut."""
    return line_dedup.without_repeats(docs, length="n_chars").select(*COLUMNS)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_duplicates.kept_documents(docs, how=NEAR).select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), carry=("text", "lang", "source", "n_chars"))
    return found.where("not contaminated").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences, with their token ids."""
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: Compression lengths and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
