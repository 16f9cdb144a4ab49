"""Packing along a space-filling curve: neighbours in content become neighbours in training sequences.

A document's hashed word vector is projected to a few dimensions, the point becomes its key on a Hilbert curve,
documents are range-sorted by that key and cut into sequences in this order. The key's low bits are a hash of
the id: a group of equal texts, which share a point, is spread over as many ranges as it needs.

Token ids are written once to the shared folder together with the key. Range bounds come from quantiles of the
whole key column; one shuffle then brings each range to its task, which streams: it holds one sequence.
Every range but its last sequence is packed without padding.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.shared import map_arrow, slices, stored
from terrace.llm.tokens import WORD_BPE, word_ids
from terrace.llm.words import ALNUM, hashed, mixed, words

LENGTH = 4096
END_ID = 2
DIMENSIONS = 4
BITS = 10  #: of each dimension
TIE_BITS = 20
#: Tokens of a range: few enough to sort in a task, enough that its one padded sequence does not count.
RANGE_TOKENS = 6_000_000


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points with whole coordinates below 2**bits (Skilling, 2004)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def projected(texts: pa.Array, dimensions: int, bits: int) -> np.ndarray:
    """Grid points of the texts: each distinct word has one random sign for each dimension; a text's sums of
    signs, over the norm of its word counts, are about normal and are laid on a grid over three deviations."""
    codes, counts, distinct = words(texts, ALNUM)
    signs = mixed(hashed(distinct))[:, None] >> np.arange(dimensions, dtype=np.uint64) & np.uint64(1)
    signs = signs.astype(np.float64) * 2 - 1
    row = np.repeat(np.arange(len(counts)), counts)
    pairs, times = np.unique(row * max(1, len(distinct)) + codes, return_counts=True)
    row, code = np.divmod(pairs, max(1, len(distinct)))
    weight = np.sqrt(times)  # damped, so that junk of one word doesn't fill a corner
    norm = np.sqrt(np.bincount(row, weight**2, len(counts)))
    sums = np.stack([np.bincount(row, weight * signs[code, d], len(counts)) for d in range(dimensions)], 1)
    unit = sums / np.maximum(norm, 1)[:, None]
    return np.clip((unit + 3) / 6 * (1 << bits), 0, (1 << bits) - 1).astype(np.int64)


def tokenized(docs: DataFrame, key: str, text: str, tokenizer: str, dimensions: int, bits: int) -> DataFrame:
    def encode(batches):
        encoder = word_ids(tokenizer)
        for batch in slices(batches, "_text"):
            texts = batch.column("_text")
            ids, counts = encoder.encode(texts)
            curve = hilbert(projected(texts, dimensions, bits), bits)
            place = (curve << TIE_BITS) | batch.column("_tie").to_numpy()
            ends = np.cumsum(counts)
            held = [np.append(ids[e - n : e], np.uint16(END_ID)).tobytes() for e, n in zip(ends, counts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(place), pa.array(counts + 1), pa.array(held, pa.binary())],
                names=[key, "place", "doc_tokens", "ids"],
            )

    tie = F.pmod(F.xxhash64(key, text), F.lit(1 << TIE_BITS)).alias("_tie")
    schema = f"`{key}` {dict(docs.dtypes)[key]}, place bigint, doc_tokens bigint, ids binary"
    return map_arrow(docs.select(key, F.col(text).alias("_text"), tie), encode, schema)


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, tokenizer: str = WORD_BPE,
         dimensions: int = DIMENSIONS, bits: int = BITS, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: ``key``, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with
    ``with_ids`` the piece's ids (binary, little-endian unsigned 16-bit).

    Null text is empty and gives the end id alone. Null keys and repeated rows are packed like others; equal
    texts lie side by side. An empty table gives an empty result; other columns are ignored.
    """
    held = stored(tokenized(docs, key, text, tokenizer, dimensions, bits), "packing")
    tokens = held.agg(F.sum("doc_tokens")).first()[0] or 0
    ranges = max(1, -(-tokens // RANGE_TOKENS))
    cuts = [i / ranges for i in range(1, ranges)]
    found = held.agg(F.percentile_approx("place", cuts, 20_000)).first()[0] if cuts else []
    # how many bounds lie below the place: the number of its range
    below = F.filter(F.lit(found or []).cast("array<bigint>"), lambda c: c < F.col("place"))
    dealt = held.select("*", F.size(below).alias("_range")).repartitionById(ranges, F.col("_range"))
    ordered = dealt.sortWithinPartitions("_range", "place", key)

    def cut(batches):
        current, number, offset = None, 0, 0
        for batch in batches:
            out = []
            for doc, of, total, ids in zip(*(batch.column(c).to_pylist() for c in (key, "_range", "doc_tokens", "ids"))):
                if of != current:
                    current, number, offset = of, of << 32, 0
                ids = np.frombuffer(ids, np.uint16)
                start = 0
                while start < total:
                    n = min(length - offset, total - start)
                    piece = ids[start : start + n]
                    crc = zlib.crc32(piece.astype("<u4").tobytes())
                    out.append((doc, start, n, crc, total, number, offset, piece.tobytes() if with_ids else None))
                    start, offset = start + n, offset + n
                    if offset == length:
                        number, offset = number + 1, 0
            columns = list(zip(*out)) if out else [()] * 8
            kinds = [batch.schema.field(key).type, *[pa.int64()] * 6, pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
            yield pa.RecordBatch.from_arrays(arrays[: 8 if with_ids else 7], names=names[: 8 if with_ids else 7])

    schema = f"`{key}` {dict(docs.dtypes)[key]}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint,"
    schema += " sequence_id bigint, offset bigint" + ", ids binary" * with_ids
    return map_arrow(ordered.select(key, "_range", "doc_tokens", "ids"), cut, schema)
