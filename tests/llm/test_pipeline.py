"""The pipeline on a driver table: every stage's promise on its own input."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", ".."))

import corpus_pipeline
import numpy as np
from terrace.llm import decontaminate, line_dedup, near_duplicates
from terrace.llm.shared import stored, table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(stored(stage(spark, frames[-1], SF), f"test-{name}"))
    for before, after in zip(frames, frames[1:-1]):
        assert after.columns == docs.columns
        assert {r[0] for r in after.select("doc_id").collect()} <= {r[0] for r in before.select("doc_id").collect()}
    assert line_dedup.line_dedup(frames[2]).agg({"n_removed": "sum"}).first()[0] == 0
    assert near_duplicates.near_duplicates(frames[3]).where("not kept").count() == 0
    assert decontaminate.contamination(frames[4], table(spark, SF, "benchmark")).where("contaminated").count() == 0
    packed = frames[5]
    assert {r[0] for r in packed.select("doc_id").collect()} == {r[0] for r in frames[4].select("doc_id").collect()}


def test_near_dedup_stage_takes_pairs_from_080_on(spark):
    """Edited copies with similarities around 0.8, against brute force: the least id of each group stays."""
    rng = np.random.default_rng(9)
    texts = []
    for _ in range(20):
        base = [f"w{n}" for n in rng.integers(0, 10**6, 120)]
        texts.append(base)
        for edits in (2, 3, 4, 5, 6):  # each edit changes up to five of 116 shingles
            copy = base[:]
            for at in rng.choice(np.arange(10, 110), edits, replace=False):
                copy[at] = f"e{rng.integers(0, 10**6)}"
            texts.append(copy)
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    root, between = list(range(len(sets))), 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            shared, both = len(a & b), len(a | b)
            between += 80 * both <= 100 * shared < 85 * both
            if 100 * shared >= 80 * both:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    kept = corpus_pipeline.without_near_duplicates(spark, docs, SF)
    assert {r["doc_id"] for r in kept.collect()} == set(root) and between > 10
