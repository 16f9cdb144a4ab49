"""Benchmark decontamination: one Aho-Corasick automaton over the normalised items, one scan of every text.

Normalised: A-Z lowered, words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` joined by single spaces. Patterns are the
items' windows of ``window`` consecutive words (an item of fewer, but not none, is one window). Since every
pattern starts and ends with a space, only whole words match. A match names its words; their places in the
original text follow from the separators, which are replaced byte by byte.

The benchmark is dealt into blocks of bounded size. Each block is one automaton, sent to the executors as the
items' text; a usual benchmark is one block. Documents are scanned once for each block and never shuffled.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.shared import map_arrow, slices
from terrace.llm.words import ALNUM

WINDOW = 10
#: Bytes of items' text in one automaton: the bound of what is broadcast.
BLOCK_BYTES = 16_000_000

_WORD = re.compile(rb"[^ ]+")


def windows_of(item: bytes, window: int) -> set[bytes]:
    words = item.translate(ALNUM).split()
    return {b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))} if words else set()


@lru_cache(maxsize=2)  # an executor's process builds it once
def automaton(items: tuple[tuple[str, bytes], ...], window: int):
    named: dict[bytes, list[str]] = {}
    for item_id, text in items:
        for found in windows_of(text, window):
            named.setdefault(found, []).append(item_id)
    built = ahocorasick.Automaton()
    for pattern, owners in named.items():
        built.add_word(f" {pattern.decode('latin-1')} ", (pattern.count(b" ") + 1, len(pattern) + 2, owners))
    built.make_automaton()
    return built


def scan(text: bytes, built) -> tuple[int, list[tuple[int, int]], set[str], list[tuple[int, int]]]:
    """Words of the text; hit words as merged (first, end) ranges; items found; byte ranges in the text."""
    plain = text.translate(ALNUM)
    words = plain.split()
    if not words or not len(built):
        return len(words), [], set(), []
    line = f" {b' '.join(words).decode('latin-1')} "
    owners: set[str] = set()
    hits = []
    for end, (n, length, items) in built.iter(line):
        owners.update(items)
        hits.append((end - length + 1, n))
    if not hits:
        return len(words), [], set(), []
    starts = np.cumsum([0, *(len(w) + 1 for w in words[:-1])])  # of each word's leading space in the line
    merged: list[tuple[int, int]] = []
    for at, n in sorted(hits):
        first = int(np.searchsorted(starts, at))
        if merged and first <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(merged[-1][1], first + n))
        else:
            merged.append((first, first + n))
    spans = [m.span() for m in _WORD.finditer(plain)]  # one byte for one byte, so these are the original's
    return len(words), merged, owners, [(spans[a][0], spans[b - 1][1]) for a, b in merged]


def _ranges(of: list[tuple[int, int]]):
    return [{"first": a, "end": b} for a, b in of]


_RANGES = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))


def benchmark_blocks(benchmark: DataFrame) -> list[list[tuple[str, bytes]]]:
    """The items' text in blocks of BLOCK_BYTES at most (or of one item). Blocks leave Spark one at a time."""
    item = F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id")
    items = benchmark.where(F.col("text").isNotNull()).select(item, F.col("text").cast("binary").alias("text"))
    blocks, held = [[]], 0
    for row in items.sort("item_id", "text").toLocalIterator():
        if held and held + len(row["text"]) > BLOCK_BYTES:
            blocks, held = [*blocks, []], 0
        blocks[-1].append((row["item_id"], bytes(row["text"])))
        held += len(row["text"])
    return blocks


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, key: str = "doc_id",
                  text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs``: ``key``, columns to ``carry``, n_words, n_hit, n_items, items_sha256, contaminated,
    item_ids (sorted as strings), word_ranges and byte_ranges (of the UTF-8 text) of the hit passages.

    Null or empty text has no words and is clean. Items with null text have no windows; an item with a null id
    is named by the empty string; repeated items count once. Repeated rows are rows of their own, empty tables
    give an empty result or a clean one, and other columns of either table are ignored.
    """
    blocks = [tuple(b) for b in benchmark_blocks(benchmark)]
    shared = [docs.sparkSession.sparkContext.broadcast(b) for b in blocks]

    def scanned(batches):
        built = [automaton(block.value, window) for block in shared]
        for batch in slices(batches, "_text"):
            out = {n: [] for n in ("n_words", "n_hit", "ids", "words", "bytes")}
            for value in batch.column("_text").to_pylist():
                n, hit, owners, spans = 0, [], set(), []
                for one in built:
                    n, more, names, places = scan(value or b"", one)
                    hit, spans, owners = [*hit, *more], [*spans, *places], owners | names
                if len(built) > 1:
                    hit, spans = union(hit), union(spans)
                out["n_words"].append(n)
                out["n_hit"].append(sum(b - a for a, b in hit))
                out["ids"].append(sorted(owners))
                out["words"].append(_ranges(hit))
                out["bytes"].append(_ranges(spans))
            digests = [hashlib.sha256(",".join(ids).encode()).hexdigest() for ids in out["ids"]]
            kept = [batch.column(c) for c in (key, *carry)]
            yield pa.RecordBatch.from_arrays(
                [
                    *kept,
                    pa.array(out["n_words"], pa.int64()),
                    pa.array(out["n_hit"], pa.int64()),
                    pa.array([len(ids) for ids in out["ids"]], pa.int64()),
                    pa.array(digests, pa.string()),
                    pa.array([n > 0 for n in out["n_hit"]], pa.bool_()),
                    pa.array(out["ids"], pa.list_(pa.string())),
                    pa.array(out["words"], _RANGES),
                    pa.array(out["bytes"], _RANGES),
                ],
                names=[key, *carry, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item_ids",
                       "word_ranges", "byte_ranges"],
            )

    kinds = dict(docs.dtypes)
    ranges = "array<struct<first:bigint,end:bigint>>"
    schema = (
        ", ".join(f"`{c}` {kinds[c]}" for c in (key, *carry))
        + ", n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean,"
        + f" item_ids array<string>, word_ranges {ranges}, byte_ranges {ranges}"
    )
    rows = docs.select(key, *carry, F.col(text).cast("binary").alias("_text"))
    return map_arrow(rows, scanned, schema)


def union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for first, end in sorted(ranges):
        if merged and first <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(merged[-1][1], end))
        else:
            merged.append((first, end))
    return merged
