"""Toxicity windows against plain compression, and phrases of several ordinary words."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pyarrow as pa

from terrace.llm import toxicity


def plain_features(text, model):
    how = model.how
    known = [toxicity.Windows._compressor(d) for d in (model.toxic, model.ordinary)]
    body = re.sub(r"[^a-z0-9\u0080-\U0010ffff]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), f" {text or ''} ")).encode()
    saved = []
    if body.strip():
        at = 0
        while at == 0 or at < len(body) - how.stride:
            window = body[at : at + how.window]
            saved.append(len(known[1].compress(window)) - len(known[0].compress(window)))
            at += how.stride
    if not saved:
        return [1.0, 0, 0, 0, 0, 0, 0]
    n = len(saved)
    over = [np.log1p(sum(s >= b for s in saved)) for b in how.beyond]
    return [1.0, sum(max(s, 0) for s in saved) / n**0.5, *over, (sum(max(s - 1, 0) for s in saved) / n) ** 0.5, min(max(max(saved), -3), 12) / 5, np.log1p(n) / 10]


def test_features_equal_plain_compression():
    model = toxicity.Model(b" rotten scoundrel the base of both", b" a sunny afternoon the base of both", (0.0,) * 7, toxicity.Fitting())
    texts = [None, "", " .\n", "A rotten scoundrel, they said.", "ROTTEN " * 3000, "Über rotten\tscoundrel! " * 4, "x" * 96, "x" * 97]
    got = toxicity.Windows(model.toxic, model.ordinary, model.how).features(pa.array(texts, pa.string()))
    assert np.allclose(got, np.array([plain_features(t, model) for t in texts]))


def test_phrase_of_ordinary_words_and_repeated_keys(spark):
    lot = random.Random(5)
    vocabulary = ["".join(lot.choice("bdklmnrst") + lot.choice("aeiou") for _ in range(lot.randint(1, 4))) for _ in range(400)]
    phrase = vocabulary[3:7]
    docs, labels = [], []
    for i in range(600):
        words = [lot.choice(vocabulary) for _ in range(lot.randint(60, 120))]
        for w in phrase * 2:  # the words alone are as common elsewhere
            words.insert(lot.randrange(len(words)), w)
        bad = i % 4 == 0
        for _ in range(4 * bad):
            at = lot.randrange(len(words))
            words[at:at] = phrase
        docs.append((i, " ".join(words), "kept"))
        labels.append((i, int(bad)))
    docs += [(None, None, "kept"), (None, "", "kept"), (1, docs[1][1], "kept"), (1, "...", "kept")]
    frame = spark.createDataFrame(docs, "doc_id int, text string, scored_text string")
    known = spark.createDataFrame(labels + [(2, None), (3, 7), (None, 1)], "doc_id int, toxic int")
    model = toxicity.fit(frame, known)
    rows = toxicity.scored(frame, model).collect()
    assert [tuple(r)[:3] for r in rows] == docs
    judged = [(r.predicted, int(r.doc_id % 4 == 0)) for r in rows if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.text != "..."]
    assert len(judged) > 80 and np.mean([p == y for p, y in judged]) >= 0.9
    assert len({r.score for r in rows if not (r.text or "").strip(".")}) == 1
    compare = toxicity.Windows(model.toxic, model.ordinary, model.how)
    z = compare.features(pa.array([d[1] for d in docs])) @ np.array(model.weights)
    assert np.allclose([r.score for r in rows], 1 / (1 + np.exp(-z)))


def test_nothing_to_learn_from(spark):
    frame = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id int, text string")
    for labels in ([], [(1, 0), (2, 0)]):
        rows = toxicity.toxicity(frame, spark.createDataFrame(labels, "doc_id int, toxic int")).collect()
        assert len(rows) == 2 and len({r.score for r in rows}) == 1
    assert toxicity.toxicity(frame.limit(0), spark.createDataFrame([(1, 0), (2, 1)], "doc_id int, toxic int")).count() == 0
