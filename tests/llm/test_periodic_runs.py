"""Periodic runs against a search of every period, on random word sequences and on a whole table."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from terrace.llm import queries
from terrace.llm.periodic_runs import Wanted, find, periodic_runs

WORDS = re.compile("[^\x20\x09-\x0d]+")
AWKWARD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "a a a a a a"), (4, "a a a a a a"), (4, "b"), (None, "x y " * 5), (None, None),
    (5, "go stop " * 30_000), (6, "α β γ " * 4 + "δ"), (7, "A a " * 4), (8, " ".join(str(i) for i in range(50_000))),
]


def brute(words: list, least: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    """Start, length and smallest period of every run: each period's stretches, the smallest period of equal ones."""
    found: dict[tuple[int, int], int] = {}
    for period in range(1, len(words) // exponent + 1):
        i = 0
        while i + period < len(words):
            if words[i] != words[i + period]:
                i += 1
                continue
            start = i
            while i + period < len(words) and words[i] == words[i + period]:
                i += 1
            if i - start + period >= max(least, exponent * period):
                found.setdefault((start, i - start + period), period)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def kept(words: list[str], runs) -> str:
    gone = {k for start, length, period in runs for k in range(start + period, start + length)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


@pytest.mark.parametrize("how", [Wanted(), Wanted(4, 2), Wanted(6, 3), Wanted(1, 2)])
def test_random_sequences(how):
    lot = random.Random(7)
    for _ in range(250):
        texts = []
        for _ in range(lot.randint(1, 4)):
            letters, words = lot.choice([1, 2, 3, 6]), []
            for _ in range(lot.randint(0, 5)):
                unit = [lot.randrange(letters) for _ in range(lot.randint(1, 7))]
                words += (unit * lot.randint(1, 9))[: lot.randint(0, 60)]
            texts.append(words)
        found = find(np.array([w for t in texts for w in t], np.int64), np.array([len(t) for t in texts]), how)
        assert [tuple(r) for r in found.tolist()] == [(k, *r) for k, t in enumerate(texts) for r in brute(t, how.least, how.exponent)]


def test_awkward_rows_and_columns(spark):
    rows = [(i, text, "kept") for i, text in AWKWARD]
    docs = spark.createDataFrame(rows, "doc_id int, text string, runs string").withColumnRenamed("text", "body")
    found = periodic_runs(docs, text="body").collect()
    want = []
    for i, text, _ in rows:
        words = WORDS.findall(text or "")
        runs = brute(words) if len(words) < 1000 else [(0, 60_000, 2)] if i == 5 else []
        want.append((i, text, len(words), runs, kept(words, runs)))
    assert sorted((tuple(r[:3]) + ([tuple(x) for x in r.runs], r.collapsed_text) for r in found), key=str) == sorted(want, key=str)
    assert periodic_runs(docs.limit(0), text="body").count() == 0


def test_query_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op12_periodic_runs(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for row in rows:
        words, h = WORDS.findall(docs[row.doc_id] or ""), zlib.crc32(str(row.doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs = brute(words)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None, None, None)
        listed = "".join("%d,%d,%d\n" % r for r in runs)
        assert tuple(row) == (
            row.doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept(words, runs).encode()).hexdigest(),
        )
