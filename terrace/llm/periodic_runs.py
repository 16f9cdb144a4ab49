"""Periodic runs of words, found by uniting suffix classes in descending order of their common prefixes.

A run is a stretch of consecutive words with smallest period q, at least ``least`` words and ``exponent`` periods long,
that no neighbouring word extends. If it starts at s, the suffixes at s and s + q agree in exactly length - q words, and
nothing between them agrees as far. So when suffixes are united by decreasing common prefix, s and s + q become neighbours
in the ordered set of their class at that very step: newly adjacent positions at a distance within the common prefix are
the seeds of runs, and a seed that a word to its left does not extend is a run, whole and once.

1. A batch of texts is one array of word numbers. Only suffixes whose first words (as many as the shortest run's common
   prefix) occur again in the same text can be part of a seed; in ordinary text these are few.
2. They are ordered by prefix doubling, and neighbours' common prefixes come from the doubling's levels.
3. Suffixes that agree with no other far enough for the nearest such place are left out: they cannot be seeds, nor lie
   between the ends of one.
4. What remains is united from the longest common prefix down (union-find; smaller sets go into larger ones).

Texts never leave their row: there is no shuffle, and a task holds one batch, or one text if that is longer.
"""

from __future__ import annotations

from bisect import bisect
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.shared import map_arrow, slices
from terrace.llm.words import WHITE_AS_IS, mixed, unique, words

_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Wanted:
    least: int = 6  #: words of a run, at least
    exponent: int = 4  #: periods of a run, at least; 2 or more

    @property
    def prefix(self) -> int:
        """Words that the suffixes at both ends of a seed share, at least."""
        return min(max(self.least - q, (self.exponent - 1) * q) for q in range(1, self.least + 1))


@dataclass
class Suffixes:
    """Suffixes of which another one of the same text begins alike, in order, and what neighbours share."""

    place: np.ndarray  #: of each suffix, in suffix order
    shared: np.ndarray  #: words that it and the next one share; fewer than ``prefix`` where classes end
    gap: np.ndarray  #: distance to the nearest place that begins alike


def repeated(codes: np.ndarray, text: np.ndarray, prefix: int) -> np.ndarray:
    """Places whose first ``prefix`` words may occur again in their text, by a hash of them."""
    n = len(codes) - prefix + 1
    if n < 2:
        return np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        spread = mixed(codes.astype(np.uint64) + np.uint64(1))
        window = mixed(text[:n].astype(np.uint64) * _ODD)
        for k in range(prefix):
            window = window * _ODD + spread[k : k + n]
        window = mixed(window)
    inside = np.nonzero(text[:n] == text[prefix - 1 :])[0]
    window = window[inside]
    ordered = np.sort(window)
    again = unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(again):
        return np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(again, window), len(again) - 1)
    return inside[again[at] == window]


def _starts(changed: np.ndarray) -> np.ndarray:
    """For each row the first row of its group, groups starting where ``changed``."""
    return np.maximum.accumulate(np.where(changed, np.arange(len(changed)), 0))


def suffixes(codes: np.ndarray, counts: np.ndarray, prefix: int) -> Suffixes | None:
    text, ends = np.repeat(np.arange(len(counts)), counts), np.cumsum(counts)
    again = repeated(codes, text, prefix)
    if not len(again):
        return None
    # With them the places that a comparison goes on from, so that order is by words throughout.
    place = unique((again[:, None] + np.array([0, prefix])).ravel())
    place = place[place < len(codes)]
    n, end = len(place), ends[text[place]]
    keys = [np.where(place + k < end, codes[np.minimum(place + k, len(codes) - 1)], -1) for k in reversed(range(prefix))]
    keys.append(text[place])
    order = np.lexsort((place, *keys))
    changed = np.ones(n, bool)
    changed[1:] = False
    for key in keys:
        changed[1:] |= key[order[1:]] != key[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = _starts(changed)
    apart = np.where(changed[1:], 2**62, np.diff(place[order]))
    gap = np.empty(n, np.int64)
    gap[order] = np.minimum(np.append(apart, 2**62), np.insert(apart, 0, 2**62))

    number = np.full(len(codes) + 1, -1, np.int64)
    number[place] = np.arange(n)
    levels, length = [rank], prefix  # a rank is the number of suffixes that begin with less
    tied = np.nonzero(np.bincount(rank, minlength=n)[rank] > 1)[0]
    while len(tied):
        last, then = levels[-1], place[tied] + length
        key = last[tied] * (n + 1) + np.where(then < end[tied], last[number[then]] + 1, 0)
        order = np.argsort(key, kind="stable")
        tied, key = tied[order], key[order]
        old, new = last[tied], np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        rank = last.copy()
        rank[tied] = old + _starts(new) - _starts(np.concatenate(([True], old[1:] != old[:-1])))
        levels.append(rank)
        length *= 2
        tied = tied[np.bincount(rank[tied], minlength=n)[rank[tied]] > 1]

    order = np.argsort(levels[-1], kind="stable")
    order = order[gap[order] < 2**62]
    if not len(order):
        return None
    place, end, gap = place[order], end[order], gap[order]
    a, b = place[:-1], place[1:]
    shared = np.zeros(len(a), np.int64)
    for k in reversed(range(len(levels))):
        inside = (a + shared < end[:-1]) & (b + shared < end[1:])
        i, j = np.where(inside, number[a + shared], -1), np.where(inside, number[b + shared], -1)
        shared += np.where((i >= 0) & (j >= 0) & (levels[k][i] == levels[k][j]), prefix << k, 0)
    growing = np.nonzero(shared >= prefix)[0]
    for _ in range(prefix - 1):
        i, j = a[growing] + shared[growing], b[growing] + shared[growing]
        growing = growing[(i < end[growing]) & (j < end[growing + 1])]
        growing = growing[codes[a[growing] + shared[growing]] == codes[b[growing] + shared[growing]]]
        shared[growing] += 1
    return Suffixes(place, shared, gap)


def seeds(found: Suffixes, how: Wanted) -> list[tuple[int, int, int]]:
    """(place, distance, shared words) of neighbours in a class when they become so, as far apart as a seed may be."""
    longest = np.maximum(np.append(found.shared, 0), np.insert(found.shared, 0, 0))
    kept = np.nonzero(longest >= (how.exponent - 1) * found.gap)[0]
    if len(kept) < 2:
        return []
    place = found.place[kept].tolist()
    shared = np.minimum.reduceat(found.shared[: kept[-1]], kept[:-1])
    steps = np.nonzero(shared >= how.prefix)[0]
    steps = steps[np.argsort(-shared[steps], kind="stable")]
    parent, members = list(range(len(place))), [[p] for p in place]

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for at, common in zip(steps.tolist(), shared[steps].tolist()):
        big, small = root(at), root(at + 1)
        if len(members[big]) < len(members[small]):
            big, small = small, big
        into, more = members[big], members[small]
        parent[small], members[small] = big, []
        furthest = common // (how.exponent - 1)
        where = [bisect(into, p) for p in more]
        for k, (p, w) in enumerate(zip(more, where)):
            if w and (not k or where[k - 1] < w) and p - into[w - 1] <= furthest:
                out.append((into[w - 1], p - into[w - 1], common))
            if w < len(into) and (k + 1 == len(more) or where[k + 1] > w) and into[w] - p <= furthest:
                out.append((p, into[w] - p, common))
        if len(more) > 16:
            into.extend(more)
            into.sort()
        else:
            for p, w in zip(reversed(more), reversed(where)):
                into.insert(w, p)
    return out


def find(codes: np.ndarray, counts: np.ndarray, how: Wanted) -> np.ndarray:
    """Rows (text, start, length, period), ascending, of all runs; ``codes`` are the words of all texts in a row, and starts count within a text."""
    found = suffixes(codes, counts, how.prefix) if len(codes) else None
    held = seeds(found, how) if found else []
    if not held:
        return np.empty((0, 4), np.int64)
    start, period, shared = np.array(held).T
    text = np.searchsorted(np.cumsum(counts), start, side="right")
    first = np.cumsum(counts)[text] - counts[text]
    whole = (start == first) | (codes[np.maximum(start - 1, 0)] != codes[np.maximum(start - 1, 0) + period])
    whole &= period + shared >= how.least
    text, start, period, length = (x[whole] for x in (text, start - first, period, period + shared))
    order = np.lexsort((period, length, start, text))
    rows = np.stack([text, start, length, period], 1)[order]
    # Classes of one common prefix are united one after the other, and between two steps a multiple of a run's period can show.
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:, :3] != rows[:-1, :3]).any(1)
    rows = rows[fresh]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def collapsed(codes: np.ndarray, counts: np.ndarray, runs: np.ndarray, distinct: pa.Array) -> pa.Array:
    """Each text's words joined by one space, without those that a run repeats after its first period."""
    first = np.cumsum(counts) - counts
    edges = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edges, first[runs[:, 0]] + runs[:, 1] + runs[:, 3], 1)
    np.add.at(edges, first[runs[:, 0]] + runs[:, 1] + runs[:, 2], -1)
    kept = np.cumsum(edges[:-1]) == 0
    offsets = np.concatenate(([0], np.cumsum(kept)))[np.concatenate(([0], np.cumsum(counts)))]
    held = distinct.cast(pa.string()).take(pa.array(codes[kept]))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), held), " ")


def periodic_runs(docs: DataFrame, text: str = "text", how: Wanted = Wanted()) -> DataFrame:
    """``docs`` with n_words, runs (array of start, length and period in words, by start, then period) and collapsed_text.

    Words are what spaces, tabs, line feeds and the like separate. A null or empty text, or one of blanks only, has no words,
    no runs and an empty collapsed text. Repeated rows report alike; a very long text is a batch of its own. An empty table
    gives an empty result, a null id is a value like others, and columns of docs named as the new ones are replaced.
    """
    new = ("n_words", "runs", "collapsed_text")
    own = [c for c in docs.columns if c not in new]

    def search(batches):
        for batch in slices(batches, "collapsed_text"):
            codes, counts, distinct = words(batch.column("collapsed_text"), WHITE_AS_IS)
            codes = codes.astype(np.int64)
            runs = find(codes, counts, how)
            offsets = pa.array(np.searchsorted(runs[:, 0], np.arange(len(counts) + 1)).astype(np.int32))
            members = [pa.array(runs[:, k]) for k in (1, 2, 3)]
            columns = [
                *(batch.column(c) for c in own),
                pa.array(counts),
                pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(members, names=["start", "length", "period"])),
                collapsed(codes, counts, runs, distinct),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[*own, *new])

    kinds = dict(docs.dtypes)
    schema = "".join(f"`{c}` {kinds[c]}, " for c in own)
    schema += "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed_text string"
    return map_arrow(docs.select(*own, F.col(text).alias("collapsed_text")), search, schema)
