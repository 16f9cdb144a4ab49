"""The quality classifier against plain arithmetic on all rows at once, and on held-out labels."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from terrace.llm import quality_classifier as qc
from terrace.llm import queries

SF = "/root/testdata/sf0.01"
TEXTS = [None, "", " \n ", "One two.\nTwo  two!\n", "ÀÉ ñ 漢字 ## $$ 12 A BB B!!\n\nÀÉ ñ 漢字", "x" * 200_000, "a b a b a b " * 20_000, "\t|\x0b|\r\n|"]


def plain(text: str | None) -> list[float]:
    text = text or ""
    raw, words = text.encode(), re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if x]
    pairs = list(zip(words, words[1:]))
    n, total = len(words), len(raw)

    def share(a, b):
        return a / b if b else 0.0

    kinds = {
        "lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "blank": (32, *range(9, 14)), "symbol": b"#$%&*+/<=>@\\^_`{|}~[]",
        "call": b"!?", "stop": b".,;:", "wide": range(128, 256),
    }
    of = {k: Counter(raw) for k in kinds}
    held = {k: sum(c for b, c in of[k].items() if b in set(kinds[k])) for k in kinds}
    held["other"] = total - sum(held.values())
    lengths = [len(w) for w in words]
    average = share(sum(lengths), n)
    has = lambda w, k: sum(b in set(kinds[k]) for b in w.encode())
    return [
        np.log1p(total), np.log1p(n), average, share(sum((x - average) ** 2 for x in lengths), n) ** 0.5, share(len(set(words)), n),
        *(share(held[k], total) for k in ("lower", "upper", "digit", "blank", "symbol", "call", "stop", "other", "wide")),
        share(sum("A" <= w[0] <= "Z" for w in words), n), share(sum(has(w, "upper") > 1 and not has(w, "lower") for w in words), n),
        share(sum(has(w, "symbol") > 0 for w in words), n), share(sum(w[-1] in ".!?" for w in words), n),
        share(sum(not (has(w, "lower") or has(w, "upper") or has(w, "wide")) for w in words), n),
        np.log1p(len(lines)), np.log1p(share(n, len(lines))), share(len(set(lines)), len(lines)),
        share(sum(bool(re.search(r"[.!?][\"')»”]*\s*$", x)) for x in lines), len(lines)), share(len(set(pairs)), max(0, n - 1)),
    ]


def test_statistics():
    short = [t for t in TEXTS if len(t or "") < 1000]
    for texts in (short, TEXTS[:3], TEXTS[5:6], []):
        got = qc.statistics(pa.array(texts, pa.string()))
        assert got.shape == (len(texts), qc.STATISTICS)
        assert np.allclose(got, np.array([plain(t) for t in texts]).reshape(-1, qc.STATISTICS), atol=1e-6)


def test_isotonic_is_the_least_squares_curve():
    lot = np.random.default_rng(3)
    for _ in range(200):
        n = lot.integers(1, 6, lot.integers(1, 12)).astype(float)
        ones = np.array([lot.integers(0, k + 1) for k in n], float)
        at = np.sort(lot.normal(size=len(n)))
        knots, levels = qc.isotonic(at, n, ones)
        mean = lambda j, k: ones[j : k + 1].sum() / n[j : k + 1].sum()
        want = [max(min(mean(j, k) for k in range(i, len(n))) for j in range(i + 1)) for i in range(len(n))]
        blocks = sorted(set(np.round(want, 9)))
        assert np.allclose(sorted(levels), blocks) and (np.diff(knots) > 0).all() and (np.diff(levels) > 0).all()


def test_whole_query_equals_one_sum_over_all_rows(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    how = qc.Fitting()
    ids = sorted(docs)
    fold = np.array([zlib.crc32(str(i).encode()) % 5 for i in ids])
    stats = qc.statistics(pa.array([docs[i] for i in ids])).astype(np.float32).astype(float)
    learn = np.array([i in labels for i in ids]) & (fold != 0)
    y = np.array([labels.get(i, 0) for i in ids], float)
    scale = stats[learn].std(0)
    model = qc.Model(stats[learn].mean(0), np.where(scale > 1e-9, scale, 1), None, np.zeros(1), np.zeros(1), how)
    z = qc.features(stats, model)

    def solve(rows):
        return np.linalg.solve(z[rows].T @ z[rows] + how.ridge * rows.sum() * np.eye(z.shape[1]), z[rows].T @ y[rows])

    n, ones = np.zeros(how.bins), np.zeros(how.bins)
    for k in range(1, 5):
        own = learn & (fold == k)
        at = qc.raw_bins(how, z[own] @ solve(learn & (fold != k)))
        np.add.at(n, at, 1)
        np.add.at(ones, at, y[own])
    held = np.nonzero(n)[0]
    knots, levels = qc.isotonic((held + 0.5) / how.bins * 3 - 1, n[held], ones[held])
    want = np.interp(z @ solve(learn), knots, levels)
    rows = {r.doc_id: r for r in queries.op11_quality_classifier(spark, SF).collect()}
    assert list(sorted(rows)) == ids
    got = np.array([rows[i].score for i in ids])
    assert np.abs(got - want).max() < 0.02 and np.median(np.abs(got - want)) < 1e-3  # a rounded sum can move a row to the next bin
    assert [rows[i].held_out for i in ids] == (fold == 0).tolist()
    assert all(rows[i].predicted == (rows[i].score >= 0.3) for i in ids)
    judged = [i for i in ids if i in labels and rows[i].held_out]
    assert np.mean([rows[i].predicted == labels[i] for i in judged]) >= 0.97


def test_sums_are_added_in_steps(spark, monkeypatch):
    monkeypatch.setattr(qc, "FAN_IN", 8)
    how = qc.Fitting(features=5)
    model = qc.Model(np.zeros(qc.STATISTICS), np.ones(qc.STATISTICS), None, np.zeros(1), np.zeros(1), how)
    lot = np.random.default_rng(1)
    rows = [(int(k % 4) + 1, lot.normal(size=qc.STATISTICS).tolist(), int(k % 2)) for k in range(60)]
    labelled = spark.createDataFrame(rows, "fold int, stats array<float>, y int").repartition(9)
    parts = qc.normal_equations(labelled, model)
    assert {k: p[0] for k, p in parts.items()} == {1: 15, 2: 15, 3: 15, 4: 15}
    for k in parts:
        own = [r for r in rows if r[0] == k]
        z = qc.features(np.array([r[1] for r in own], np.float32).astype(float), model)
        assert np.allclose(parts[k][1], z.T @ z) and np.allclose(parts[k][2], z.T @ np.array([r[2] for r in own]))


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 1), (2, 1)], [(k, k % 2) for k in range(8)] + [(3, None), (3, 5), (None, 1), (1, 0)]])
def test_awkward_rows(spark, labels):
    docs = [(k, t, "x") for k, t in enumerate(TEXTS)] + [(1, "other text of the key", "x"), (1, "", "x"), (None, None, "x"), (None, "two words", "x")]
    frame = spark.createDataFrame(docs, "doc_id int, text string, score string")
    known = spark.createDataFrame(labels, "doc_id int, quality int")
    rows = qc.quality(frame, known).collect()
    assert Counter(r.doc_id for r in rows) == Counter(d[0] for d in docs)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    learned = {y for k, y in labels if k is not None and y in (0, 1) and zlib.crc32(str(k).encode()) % 5}
    if len(learned) < 2:
        assert {r.score for r in rows} == {float(learned.pop()) if learned else 0.5}
    assert qc.quality(frame.limit(0), known).count() == 0
