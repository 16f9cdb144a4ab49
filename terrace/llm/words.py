"""Words of many texts at once: Arrow splits them and numbers the distinct ones."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _table(separators, lower: bool = True) -> bytes:
    table = bytearray(bytes.maketrans(_UPPER, _LOWER) if lower else range(256))
    for byte in separators:
        table[byte] = 32
    return bytes(table)


#: A-Z lowered; tab to carriage return become spaces. Words are then what spaces separate.
WHITE = _table(range(9, 14))
#: As WHITE, but letters stay as they are.
WHITE_AS_IS = _table(range(9, 14), lower=False)
#: A-Z lowered, line feeds become spaces.
LOWERED = _table([10])
#: As WHITE, but line feeds stay.
WHITE_IN_LINES = _table([9, 11, 12, 13])
#: A-Z lowered; every other ASCII byte that is neither digit nor letter becomes a space.
ALNUM = _table([*range(0, 48), *range(58, 65), *range(91, 97), *range(123, 128)])


class Words(NamedTuple):
    codes: np.ndarray  #: of each word, in order, its place among the distinct ones
    counts: np.ndarray  #: words of each text
    distinct: pa.Array

    @property
    def ends(self) -> np.ndarray:
        return np.cumsum(self.counts)


def translated(texts: pa.Array, table: bytes) -> pa.Array:
    """Every byte replaced by the table's; null becomes empty. Tables change ASCII bytes only, so UTF-8 stays valid."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    if not data:
        return texts
    # A slice shares the buffer of its whole batch: only its own bytes are copied.
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    own = data.slice(offsets[0], offsets[-1] - offsets[0]).to_pybytes().translate(table)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(own))


def split(texts: pa.Array, separator: str = " ") -> Words:
    """Non-empty parts between separators."""
    parts = pc.split_pattern(texts, separator)
    offsets = parts.offsets.to_numpy()
    encoded = parts.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    offsets = offsets - offsets[0]
    distinct = encoded.dictionary
    codes = encoded.indices.to_numpy()
    empty = pc.index(distinct, pa.scalar("", distinct.type)).as_py()
    if empty >= 0:
        kept = codes != empty
        counts = np.diff(np.concatenate(([0], np.cumsum(kept)))[offsets])
        codes = codes[kept]
    else:
        counts = np.diff(offsets)
    return Words(codes, counts.astype(np.int64), distinct)


def words(texts: pa.Array, table: bytes) -> Words:
    return split(translated(texts, table))


def hashed(distinct: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string, the same in every process: each (place, byte) has a random number, and a string's
    numbers are summed and mixed with its length."""
    distinct = distinct.cast(pa.large_string())
    _, offsets, data = distinct.buffers()
    offsets = np.frombuffer(offsets, np.int64)[distinct.offset : distinct.offset + len(distinct) + 1] if offsets else np.zeros(1, np.int64)
    lengths = np.diff(offsets)
    held = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64)
    place = np.arange(len(held)) - np.repeat(offsets[:-1] - offsets[0], lengths)
    with np.errstate(over="ignore"):
        numbers = mixed((place.astype(np.uint64) << np.uint64(8) | held) * _PRIME + np.uint64(1))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(numbers)))[offsets - offsets[0]]
        return mixed(np.diff(total) + lengths.astype(np.uint64) * _PRIME)


class Placed(NamedTuple):
    bytes: np.ndarray  #: of all texts in a row
    offsets: np.ndarray  #: where each text begins there, and the end
    starts: np.ndarray  #: where each word begins
    lengths: np.ndarray  #: and its length


def placed(texts: pa.Array, table: bytes) -> Placed:
    """Where the words are that spaces and line feeds separate; nothing is cut out."""
    texts = translated(texts, table)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if data else np.zeros(len(texts) + 1, np.int64)
    held = np.frombuffer(data or b"", np.uint8)[: offsets[-1]]
    letter = (held != 32) & (held != 10)
    head, tail = letter.copy(), letter.copy()
    head[1:] &= ~letter[:-1]
    tail[:-1] &= ~letter[1:]
    first, last = offsets[:-1][offsets[:-1] < len(held)], offsets[1:][offsets[1:] > 0] - 1
    head[first], tail[last] = letter[first], letter[last]  # texts meet without a separator
    starts = np.nonzero(head)[0]
    return Placed(held, offsets, starts, np.nonzero(tail)[0] + 1 - starts)


#: A longer word is hashed by ``hashed``.
_LONG = 64
_SEEDS = np.arange(_LONG + 1, dtype=np.uint64) * _PRIME
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def hashed_at(held: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of bytes, the same in every process, eight bytes at a time (not the hash of ``hashed``)."""
    eights = np.ndarray(len(held) + 1, "<u8", np.concatenate((held, np.zeros(8, np.uint8))), strides=(1,))
    out = mixed(_SEEDS[np.minimum(lengths, _LONG)] ^ (eights[starts] & _MASKS[np.minimum(lengths, 8)]))
    some, at = np.nonzero((lengths > 8) & (lengths <= _LONG))[0], 8
    while len(some):
        out[some] = mixed(out[some] ^ (eights[starts[some] + at] & _MASKS[np.minimum(lengths[some] - at, 8)]))
        at += 8
        some = some[lengths[some] > at]
    long = np.nonzero(lengths > _LONG)[0]
    if len(long):
        cut = b"".join(held[a : a + n].tobytes() for a, n in zip(starts[long].tolist(), lengths[long].tolist()))
        ends = np.concatenate(([0], np.cumsum(lengths[long])))
        out[long] = hashed(pa.LargeStringArray.from_buffers(len(long), pa.py_buffer(ends), pa.py_buffer(cut)))
    return out


def unique(x: np.ndarray) -> np.ndarray:
    """The distinct numbers, ascending, by sorting (numpy's own way for whole numbers is a slower hash table)."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: spreads the bits of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
