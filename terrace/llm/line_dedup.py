"""Exact set-similarity join of lines; of every two similar lines the later one is removed.

A line's set is its distinct words (A-Z lowered); a line without a word has none and is left alone. Two lines are
similar if the Jaccard similarity of their sets is at least ``percent``. A set so small that only an equal one is
similar (at 80 up to three words) needs no pairs: it is a class by its fingerprint and stays out of steps 1 to 5.

1. Token rarity: how often a token occurs, counted over all lines in a table of fixed size (2**22 cells by
   token hash, so that what is broadcast never grows; tokens that share a cell share its count, and one that a line repeats
   counts each time, which only makes the order a little less apt, never the result wrong).
2. Each set's tokens are ordered by (rarity, hash). Similar sets share one of their first
   ``size - ceil(t * size) + 1`` tokens (prefix filter); a token that only one line holds is left out of it.
3. Lines meet in the group of each prefix token; many small groups travel together, packed. Equal sets are one class there. A group of more than ``block`` classes
   is cut into blocks, and every two blocks meet in one place, so no task holds more than two blocks.
4. In a group, sizes must be within t, the tokens from the shared one on must suffice (positional filter), and so must
   the tokens that a 128-bit map of either set rules out. Classes without any partner leave here, without their sets.
5. The others are verified on whole sets, read again from documents that hold them. A pair counts in the group of
   its first shared token only. Links leave a task as one row for each class: their number and the earliest partner.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.shared import free_names, map_arrow, slices, stored
from terrace.llm.words import WHITE, WHITE_IN_LINES, hashed_at, mixed, placed, unique

#: Cells of the rarity table, and of one page of it.
CELL_BITS = 22
PAGE_BITS = 12
#: Text handled at a time: less than other operators take, as what is made of it then stays in a core's cache.
TEXT_BYTES = 1_000_000


@dataclass(frozen=True)
class Similarity:
    percent: int = 80
    min_tokens: int = 1  #: a line of fewer distinct words is never removed
    block: int = 2048

    @property
    def joined_from(self) -> int:
        """Words of the smallest set that another set can be similar to: n / (n + 1) reaches the threshold."""
        return max(self.min_tokens, -(-self.percent // (100 - self.percent)) if self.percent < 100 else 2**31)


@dataclass
class Lines:
    """Word sets of the lines of a batch of texts."""

    text: np.ndarray  #: which text each line is of
    number: np.ndarray  #: which line of it, from 0
    size: np.ndarray
    tokens: np.ndarray  #: distinct token hashes of all lines in a row, within a line ordered by (level, hash)

    @property
    def ends(self) -> np.ndarray:
        return np.cumsum(self.size)


def lines_of(texts: pa.Array, min_tokens: int, only: pa.Array | None = None, level: np.ndarray | None = None) -> Lines:
    """``only``: for each text the numbers of the lines to take (all if absent). ``level``: the rarity table."""
    held, offsets, starts, lengths = placed(texts, WHITE_IN_LINES)
    feeds = np.nonzero(held == 10)[0]
    per_text = np.diff(np.searchsorted(feeds, offsets)) + 1
    text = np.repeat(np.arange(len(texts)), per_text)
    number = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    counts = np.diff(np.searchsorted(starts, np.sort(np.concatenate((offsets, feeds + 1)))))
    if only is not None:
        wanted = np.array([t * 2**32 + n for t, ns in enumerate(only.to_pylist()) for n in ns], np.int64)
        keep = np.isin(text * 2**32 + number, wanted)
        kept = np.repeat(keep, counts)
        starts, lengths, text, number, counts = starts[kept], lengths[kept], text[keep], number[keep], counts[keep]
    size = np.zeros(len(counts), np.int64)
    line, tokens = np.empty(0, np.int64), np.empty(0, np.uint64)
    if len(starts):
        encoded = pa.array(hashed_at(held, starts, lengths)).dictionary_encode()
        codes, hashes = encoded.indices.to_numpy(), encoded.dictionary.to_numpy()
        order = np.argsort(hashes) if level is None else np.lexsort((hashes, level[cells(hashes)]))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        line = np.repeat(np.arange(len(counts)), counts)
        line, code = np.divmod(unique(line * len(hashes) + rank[codes]), len(hashes))
        size = np.bincount(line, minlength=len(counts))
        tokens = hashes[order][code]
    enough = size >= max(1, min_tokens)
    kept = enough[line]
    return Lines(text[enough], number[enough], size[enough], tokens[kept])


def sums_by_line(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values)))
    ends = np.cumsum(size)
    with np.errstate(over="ignore"):
        return total[ends] - total[ends - size]


def fingerprints(lines: Lines) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(sums_by_line(mixed(lines.tokens), lines.size) * np.uint64(0x9E3779B97F4A7C15) + lines.size.astype(np.uint64)).view(np.int64)


def bitmaps(lines: Lines) -> list[np.ndarray]:
    """Two 64-bit words of each line: the bits that its tokens' hashes name."""
    bit = (lines.tokens >> np.uint64(50)) & np.uint64(127)
    starts = lines.ends - lines.size
    out = []
    for half in (0, 1):
        value = np.where((bit >> np.uint64(6)) == half, np.uint64(1) << (bit & np.uint64(63)), np.uint64(0))
        out.append(np.bitwise_or.reduceat(value, starts).view(np.int64) if len(starts) else np.empty(0, np.int64))
    return out


def cells(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def rarity(docs: DataFrame, text: str, how: Similarity) -> np.ndarray:
    """How often the tokens of each cell occur, as a power of two in eighths (0: never, 1: once)."""

    def count(batches):
        held = np.zeros(1 << CELL_BITS, np.int64)
        for batch in slices(batches, "_text", TEXT_BYTES):
            text, _, starts, lengths = placed(batch.column("_text"), WHITE)
            np.add.at(held, cells(hashed_at(text, starts, lengths)), 1)
        for page in range(1 << (CELL_BITS - PAGE_BITS)):
            part = held[page << PAGE_BITS : (page + 1) << PAGE_BITS]
            at = np.nonzero(part)[0]
            if len(at):
                cell, n = at.astype(np.uint16).tobytes(), np.minimum(part[at], 2**32 - 1).astype(np.uint32).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([page]), pa.array([cell]), pa.array([n])], names=["page", "cell", "n"])

    def add(pages: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # streams, whatever the number of tasks
        total = np.zeros(1 << PAGE_BITS, np.int64)
        page = None
        for part in pages:
            for row in part.to_pylist():
                page = row["page"]
                total[np.frombuffer(row["cell"], np.uint16)] += np.frombuffer(row["n"], np.uint32)
        level = np.where(total > 0, np.minimum(1 + 8 * np.log2(np.maximum(total, 1)), 255), 0).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([page]), pa.array([level.tobytes()])], names=["page", "level"])

    counted = map_arrow(docs.select(F.col(text).alias("_text")), count, "page bigint, cell binary, n binary")
    pages = counted.groupBy("page").applyInArrow(add, "page bigint, level binary").collect()  # 4 MB in all, always
    out = np.zeros(1 << CELL_BITS, np.uint8)
    for row in pages:
        out[row["page"] << PAGE_BITS : (row["page"] + 1) << PAGE_BITS] = np.frombuffer(row["level"], np.uint8)
    return out


def prefixes(lines: Lines, level: np.ndarray, how: Similarity, first: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, pa.Array]:
    """Of each line that is ``first`` (none of the others): how many tokens ahead no other line can hold; then the prefix tokens
    that more than one line may hold, as bytes, and the last of them; then those that more than a block of lines may hold. As lines
    are ordered by ``level``, these three follow each other, so a token's place is known from its place in its list."""
    rank = level[cells(lines.tokens)]
    starts = lines.ends - lines.size
    place = np.arange(len(rank)) - np.repeat(starts, lines.size)
    length = lines.size - -(-how.percent * lines.size // 100) + 1
    length = np.where((lines.size < how.joined_from) | ~first, 0, length)
    at = np.nonzero(place < np.repeat(length, lines.size))[0]
    rank, line = rank[at], np.repeat(np.arange(len(length)), length)
    hot = rank >= min(255, max(2, int(8 * np.log2(how.block))))

    def lists(kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = np.cumsum(np.bincount(line[kept], minlength=len(length)))
        return np.concatenate(([0], ends)).astype(np.int32), lines.tokens[at[kept]].view(np.int64)

    ends, tokens = lists((rank > 1) & ~hot)
    few = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(ends * np.int32(8)), pa.py_buffer(tokens)])
    last = np.concatenate(([0], tokens))[np.where(np.diff(ends) > 0, ends[1:], 0)]
    return np.bincount(line[rank <= 1], minlength=len(length)), few, last, pa.ListArray.from_arrays(*map(pa.array, lists(hot)))


_OCCURRENCE = "doc_hash bigint, line int, fp bigint, size int, b0 bigint, b1 bigint, skipped int, few binary, last bigint, often array<bigint>"


def occurrences(docs: DataFrame, key: str, text: str, level, how: Similarity) -> DataFrame:
    """Every line with enough tokens. In each task only the first of equal sets carries its prefix."""

    def read(batches):
        seen: set[int] = set()
        for batch in slices(batches, "_text", TEXT_BYTES):
            lines = lines_of(batch.column("_text"), how.min_tokens, level=level.value)
            fp, (b0, b1) = fingerprints(lines), bitmaps(lines)
            first = np.array([not (f in seen or seen.add(f)) for f in fp.tolist()], bool)
            if len(seen) > 1_000_000:
                seen.clear()
            skipped, few, last, often = prefixes(lines, level.value, how, first)
            last = pa.array(last, mask=pc.list_value_length(often).to_numpy() == 0)  # only ``often`` asks for it
            row = pa.array(lines.text)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key).take(row), batch.column("_hash").take(row), pa.array(lines.number.astype(np.int32)),
                    pa.array(fp), pa.array(lines.size.astype(np.int32)), pa.array(b0), pa.array(b1),
                    pa.array(skipped.astype(np.int32)), few, last, often,
                ],
                names=[key, "doc_hash", "line", "fp", "size", "b0", "b1", "skipped", "few", "last", "often"],
            )

    rows = docs.select(key, F.xxhash64(text).alias("_hash"), F.col(text).alias("_text"))
    return map_arrow(rows, read, f"`{key}` {dict(docs.dtypes)[key]}, {_OCCURRENCE}")


#: A group row. ``cut``: of a group that is cut into blocks the lower and the higher one, 32 bits each, else 0. ``span``: whether no
#: prefix token is ahead of this one, place (31 bits), size (31 bits), and whether the row is of the higher block. ``before``: the
#: prefix token ahead, or 0. Few columns, because these are by far the most rows.
_ROW = "token bigint, cut bigint, span bigint, before bigint, b0 bigint, b1 bigint, fp bigint"
_NAMES = [part.split()[0] for part in _ROW.split(", ")]

#: Group rows of one bucket, about, and those that a task gathers before it hands them on.
BUCKET_ROWS = 25_000
GATHERED_ROWS = 400_000


def _of_few(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Group rows of the tokens in ``few``, one for each."""
    for batch in slices(batches, "few", 8 * GATHERED_ROWS):
        few = batch.column("few")
        n = pc.binary_length(few).to_numpy() // 8
        token = np.frombuffer(b"".join(few.to_pylist()), np.int64)
        starts = np.cumsum(n) - n
        line = np.repeat(np.arange(len(n)), n)
        skipped, size, *others = (batch.column(c).to_numpy().astype(np.int64) for c in ("skipped", "size", "b0", "b1", "fp"))
        out = np.zeros((len(token), len(_NAMES)), np.int64)
        out[:, 0] = token
        out[:, 2] = np.arange(len(token)) << 32
        out[:, 2] += (((skipped - starts) << 32) + (size << 1))[line]
        out[1:, 3] = token[:-1]
        out[starts, 2] |= -(2**63)
        out[starts, 3] = 0
        out[:, 4:] = np.stack(others, axis=1)[line]
        yield out


def _as_they_are(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        yield np.stack([batch.column(c).to_numpy() for c in _NAMES], axis=1)


def _group_hash(rows: np.ndarray) -> np.ndarray:
    return mixed(rows[:, 0].view(np.uint64) ^ mixed(rows[:, 1]))


def _packed(rows: DataFrame, read, buckets: int) -> DataFrame:
    """The group rows that ``read`` makes of the batches, those of a bucket side by side: a bucket holds whole groups, and Spark
    shuffles a few long values instead of many short rows."""

    def pack(batches):
        def flush(held: list[np.ndarray]) -> pa.RecordBatch:
            every = np.concatenate(held)
            bucket = _group_hash(every) % np.uint64(buckets)
            order = np.argsort(bucket.astype(np.uint16 if buckets <= 2**16 else np.uint32), kind="stable")
            found, n = np.unique(bucket[order], return_counts=True)
            ends = np.concatenate(([0], np.cumsum(n))) * every.itemsize * every.shape[1]
            values = [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(every[order])]
            return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.Array.from_buffers(pa.binary(), len(n), values)], names=["bucket", "rows"])

        held, n = [], 0
        for some in read(batches):
            held.append(some)
            n += len(some)
            if n >= GATHERED_ROWS:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)

    return map_arrow(rows, pack, "bucket bigint, rows binary")


def _groups(lines: DataFrame, how: Similarity, rows: int) -> DataFrame:
    """A row (``_ROW``) for each class and prefix token, packed, dealt and sorted by buckets of groups (token, cut). ``rows``: how many
    there are, about, before groups are cut."""
    large = lines.select("fp", F.explode("often").alias("token")).distinct().groupBy("token").agg(F.count("*").alias("m")).where(F.col("m") > how.block)
    large = stored(large.select("token", "m", F.ceil(F.col("m") / how.block).cast("int").alias("blocks")), "line-hot")
    rows += large.agg(F.sum(F.col("m") * F.col("blocks"))).first()[0] or 0
    previous = F.get("often", F.col("pos") - 1)
    often = lines.where(F.size("often") > 0).select("fp", "size", "b0", "b1", "skipped", "few", "last", "often", F.posexplode("often").alias("pos", "token"))
    ahead = F.floor(F.octet_length("few") / 8).cast("int")
    often = often.select(
        "token", (F.col("skipped") + ahead + F.col("pos")).alias("place"), "size", "b0", "b1", "fp",
        ((F.col("pos") == 0) & (ahead == 0)).alias("leads"), F.coalesce(previous, F.col("last")).alias("before"),
    )
    none = F.lit(0)
    split = often.join(large, "token").withColumn("own", F.pmod(F.xxhash64("fp", "token"), F.col("blocks")).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(none, F.col("blocks") - 1)))
    cut = F.shiftleft(F.least("own", "other").cast("long"), 32).bitwiseOR(F.greatest("own", "other").cast("long"))
    often = _row(often.join(large, "token", "left_anti"), none.cast("long"), none).unionByName(_row(split, cut, (F.col("own") > F.col("other")).cast("int")))
    buckets = 1 + rows // BUCKET_ROWS
    few = lines.where(F.octet_length("few") > 0).select("skipped", "size", "b0", "b1", "fp", "few")
    packs = _packed(few, _of_few, buckets).unionByName(_packed(often, _as_they_are, buckets))
    return packs.repartition("bucket").sortWithinPartitions("bucket")


def _row(rows: DataFrame, cut, higher) -> DataFrame:
    span = F.shiftleft(F.col("place").cast("long"), 32).bitwiseOR(F.shiftleft(F.col("size").cast("long"), 1)).bitwiseOR(higher.cast("long"))
    span = F.when(F.col("leads"), span.bitwiseOR(F.lit(-(2**63)))).otherwise(span)
    return rows.select("token", cut.alias("cut"), span.alias("span"), "before", "b0", "b1", "fp")


#: Bits of the number rows are sorted by that hold the size; the others are a hash of the group.
SIZE_BITS = 24


def _dealt(rows: DataFrame) -> DataFrame:
    """Dealt by group and sorted by one number, which Spark sorts many times faster than several columns."""
    size = F.shiftright(F.col("span").bitwiseAND(F.lit(2**32 - 1)), 1)
    at = F.shiftleft(F.xxhash64("token", "cut"), SIZE_BITS).bitwiseOR(F.least(size, F.lit((1 << SIZE_BITS) - 1)))
    return rows.repartition("token", "cut").withColumn("at", at).sortWithinPartitions("at")


def whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The group rows of one bucket after the other, with ``at`` as in ``_dealt`` (by another hash)."""

    def table(held: list[bytes]) -> pa.Table:
        rows = np.frombuffer(b"".join(held), np.int64).reshape(-1, len(_NAMES))
        size = (rows[:, _NAMES.index("span")] & (2**32 - 1)) >> 1
        at = (_group_hash(rows) << np.uint64(SIZE_BITS)).view(np.int64) | np.minimum(size, (1 << SIZE_BITS) - 1)
        return pa.table([*map(pa.array, np.ascontiguousarray(rows.T)), pa.array(at)], names=[*_NAMES, "at"])

    held: list[bytes] = []
    last = None
    for batch in batches:
        for bucket, rows in zip(batch.column("bucket").to_pylist(), batch.column("rows")):
            if bucket != last and held:
                yield table(held)
                held = []
            last = bucket
            held.append(rows.as_py())
    if held:
        yield table(held)


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The same rows, cut where the group's hash in ``at`` changes only."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        group = batch.column("at").to_numpy() >> SIZE_BITS
        new = np.ones(batch.num_rows, bool)
        new[1:] = group[1:] != group[:-1]
        new[0] = bool(held) and group[0] != last
        last = group[-1]
        cut = int(np.nonzero(new)[0][-1]) if new.any() else None
        if cut is None:
            held.append(batch)
            continue
        if cut:
            held.append(batch.slice(0, cut))
        if held:
            yield pa.Table.from_batches(held)
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


class Group:
    """Rows of whole groups, equal sets of a group once, and the pairs that pass the filters."""

    CHUNK = 1_000_000  #: pairs looked at in one go

    def __init__(self, table: pa.Table, how: Similarity):
        self.percent = how.percent
        columns = {c: table.column(c).to_numpy() for c in ("at", "token", "cut", "span", "fp")}
        size = (columns["span"] & (2**32 - 1)) >> 1
        order = np.lexsort((columns["fp"], columns["at"]))
        group = self._starts(columns, order)
        hashed = columns["at"][order] >> SIZE_BITS
        if (group[1:] & (hashed[1:] == hashed[:-1])).any() or size.max() >> SIZE_BITS:  # ``at`` does not tell groups or sizes apart
            order = np.lexsort((columns["fp"], size, columns["cut"], columns["token"], columns["at"] >> SIZE_BITS))
            group = self._starts(columns, order)
        fp = columns["fp"][order]
        fresh = group | np.concatenate(([True], fp[1:] != fp[:-1]))
        self.table = table.take(pa.array(order[fresh]))
        self.group = np.cumsum(group)[fresh]
        self.size, self.fp = size[order][fresh], fp[fresh]
        span, cut = columns["span"][order][fresh], columns["cut"][order][fresh]
        self.place, self.own, self.leads = span >> 32 & (2**31 - 1), span & 1, span < 0
        self.apart = cut >> 32 != cut & (2**32 - 1)
        self.maps = [self.table.column(c).to_numpy() for c in ("b0", "b1")]
        self.before = self.table.column("before").to_numpy()

    @staticmethod
    def _starts(columns: dict[str, np.ndarray], order: np.ndarray) -> np.ndarray:
        """Which rows in this order have another token or cut than the one ahead."""
        group = np.zeros(len(order), bool)
        for c in ("token", "cut"):
            group[1:] |= columns[c][order[1:]] != columns[c][order[:-1]]
        return group

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows (i, j), i before j, in ascending order of i. Those that share the token ahead of the group's as well are
        counted in an earlier group."""
        base = int(self.size.max()) * 200 + 1
        if base * (int(self.group[-1]) + 1) >= 2**62:
            raise ValueError("a line has too many words")
        end = np.searchsorted(self.group * base + self.size, self.group * base + self.size * 100 // self.percent, side="right")
        n = end - np.arange(len(end)) - 1
        total = np.cumsum(n)
        first = 0
        while first < len(n):
            last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + self.CHUNK, side="right")))
            some = n[first:last]
            i = np.repeat(np.arange(first, last), some)
            j = np.arange(len(i)) - np.repeat(np.cumsum(some) - some, some) + i + 1
            first = last
            keep = self._likely(i, j)
            if keep.any():
                yield i[keep], j[keep]

    def _likely(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        sizes, t = self.size[i] + self.size[j], self.percent
        need = -(-t * sizes // (100 + t))  # overlap / (sizes - overlap) >= t / 100
        keep = np.minimum(self.size[i] - self.place[i], self.size[j] - self.place[j]) >= need
        keep &= (self.own[i] != self.own[j]) | ~self.apart[i]
        keep &= (self.before[i] != self.before[j]) | self.leads[i] | self.leads[j]
        at = np.nonzero(keep)[0]
        i, j, need = i[at], j[at], need[at]
        for a, b in ((i, j), (j, i)):
            beyond = sum(np.bitwise_count((m[a] & ~m[b]).view(np.uint64)).astype(np.int64) for m in self.maps)
            keep[at] &= self.size[a] - beyond >= need
        return keep


def _with_partner(groups: DataFrame, how: Similarity) -> DataFrame:
    """Rows of ``groups`` that have a partner which passes the filters."""

    def scan(batches):
        for table in whole_buckets(batches):
            group = Group(table, how)
            has = np.zeros(len(group.fp), bool)
            for i, j in group.pairs():
                has[i] = has[j] = True
            yield from group.table.filter(pa.array(has)).select(_NAMES).to_batches()

    return map_arrow(groups, scan, _ROW)


def _sets(docs: DataFrame, firsts: DataFrame, key: str, text: str, level, how: Similarity) -> DataFrame:
    """(fp, key, line, doc_hash, tokens) of the lines named in ``firsts`` (key, doc_hash, line), tokens by rarity."""
    wanted = firsts.groupBy(key, "doc_hash").agg(F.collect_set("line").alias("_only"))  # lines of one document

    def read(batches):
        for batch in slices(batches, "_text", TEXT_BYTES):
            lines = lines_of(batch.column("_text"), how.min_tokens, batch.column("_only"), level.value)
            offsets = pa.array(np.concatenate(([0], lines.ends)).astype(np.int32))
            held = pa.ListArray.from_arrays(offsets, pa.array(lines.tokens.view(np.int64)))
            row = pa.array(lines.text)
            yield pa.RecordBatch.from_arrays(
                [pa.array(fingerprints(lines)), batch.column("_key").take(row), pa.array(lines.number.astype(np.int32)), batch.column("_hash").take(row), held],
                names=["fp", "_key", "_line", "_hash", "tokens"],
            )

    body = docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_hash"), F.col(text).alias("_text"))
    same = F.col("_key").eqNullSafe(F.col(key)) & (F.col("_hash") == F.col("doc_hash"))
    rows = body.join(wanted, same).select("_key", "_hash", "_text", "_only")
    schema = f"fp bigint, _key {dict(docs.dtypes)[key]}, _line int, _hash bigint, tokens array<bigint>"
    return map_arrow(rows, read, schema).dropDuplicates(["fp"])


def _verified(groups: DataFrame, how: Similarity) -> DataFrame:
    """(u, n, v) for each row that is linked: how many links of u count in this group, and of their other ends
    the one that occurs first."""

    def verify(batches):
        for table in whole_groups(batches):
            group = Group(table, how)
            tokens = group.table.column("tokens").combine_chunks()
            if isinstance(tokens, pa.ChunkedArray):
                tokens = tokens.chunk(0)
            ends = np.cumsum(pc.list_value_length(tokens).to_numpy())
            starts = ends - group.size
            _, codes = np.unique(tokens.flatten().to_numpy(), return_inverse=True)
            by_place = [("_key", "ascending"), ("_line", "ascending"), ("_hash", "ascending")]
            order = pc.sort_indices(group.table, by_place, null_placement="at_start").to_numpy()
            when = np.empty(len(order), np.int64)
            when[order] = np.arange(len(order))
            links, least = np.zeros(len(ends), np.int64), np.full(len(ends), len(ends), np.int64)
            held = np.zeros(int(codes.max()) + 1, bool)
            for i, j in group.pairs():
                at = np.concatenate(([0], np.nonzero(np.diff(i))[0] + 1, [len(i)]))
                for k, low, high in zip(i[at[:-1]].tolist(), at[:-1].tolist(), at[1:].tolist()):
                    others = j[low:high]
                    base = starts[others[0]]
                    own = codes[starts[k] : ends[k]]
                    held[own] = True
                    total = np.concatenate(([0], np.cumsum(held[codes[base : ends[others[-1]]]])))
                    held[own] = False
                    begin = starts[others] - base
                    shared = total[ends[others] - base] - total[begin]
                    home = total[begin + group.place[others]] == total[begin]  # nothing rarer is shared
                    found = others[home & (100 * shared >= how.percent * (group.size[k] + group.size[others] - shared))]
                    if len(found):
                        links[k] += len(found)
                        links[found] += 1
                        least[k] = min(least[k], when[found].min())
                        least[found] = np.minimum(least[found], when[k])
            linked = np.nonzero(links)[0]
            if len(linked):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(group.fp[linked]), pa.array(links[linked]), pa.array(group.fp[order[least[linked]]])], names=["u", "n", "v"]
                )

    return map_arrow(groups, verify, "u bigint, n bigint, v bigint")


@dataclass
class Found:
    lines: DataFrame  #: every occurrence: key, doc_hash, line, fp
    classes: DataFrame  #: fp, first (key, line of the first occurrence), copies
    links: DataFrame  #: u, n, v: number of links of a class to other classes, in parts, and the earliest of each part


def similar_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", how: Similarity = Similarity()) -> Found:
    rare = rarity(docs, text, how)
    words_held = float(np.sum(2.0 ** ((rare[rare > 1] - 1) / 8)))  # in cells that more than one occurrence shares
    level = docs.sparkSession.sparkContext.broadcast(rare)
    lines = stored(occurrences(docs, key, text, level, how), "lines")
    place = F.struct(F.col(key).alias("key"), "line", "doc_hash")
    classes = stored(lines.groupBy("fp").agg(F.min(place).alias("first"), F.count("*").alias("copies")), "line-classes")
    likely = stored(_with_partner(_groups(lines, how, int(words_held * (100 - how.percent) / 100)), how), "line-groups")
    firsts = classes.join(likely.select("fp").distinct(), "fp").select(
        F.col("first.key").alias(key), F.col("first.doc_hash").alias("doc_hash"), F.col("first.line").alias("line")
    )
    sets = stored(_sets(docs, firsts, key, text, level, how), "line-sets")
    links = stored(_verified(_dealt(likely.join(sets, "fp")), how), "line-links")
    return Found(lines.select(key, "doc_hash", "line", "fp"), classes, links)


def removals(found: Found, key: str = "doc_id") -> DataFrame:
    """key, doc_hash, removed (line numbers), n_links for every document that has a removed or a linked line. A
    line goes if a similar line stands earlier, in order of (key, line, doc_hash), whether or not that line goes too."""
    first = found.classes.select(F.col("fp").alias("v"), F.col("first").alias("other"))
    earlier = found.links.join(first, "v").groupBy("u").agg(F.min("other").alias("other"), F.sum("n").alias("n"))
    classes = found.classes.join(earlier, found.classes["fp"] == earlier["u"], "left").where("copies > 1 or u is not null")
    earliest = classes.select(
        F.col("fp"), F.least("first", F.coalesce("other", "first")).alias("earliest"), F.coalesce("n", F.lit(0)).alias("n")
    )
    rows = found.lines.join(earliest, "fp")
    later = F.struct(F.col(key).alias("key"), "line", "doc_hash") > F.col("earliest")
    return rows.groupBy(key, "doc_hash").agg(  # the lines of one document
        F.sort_array(F.collect_set(F.when(later, F.col("line")))).alias("removed"), F.sum("n").alias("n_links")
    )


def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", how: Similarity = Similarity()) -> DataFrame:
    """``key``, n_lines (all lines, blank ones too), n_removed, removed_lines (numbers from 0), n_links (links of
    the document's lines to classes of other sets) of every row.

    Null text has no lines; an empty one has one blank line. Lines without a word are never removed. Rows that repeat both key
    and text are one document and report the same; rows that repeat a key with other text are documents of their own,
    of whose lines with one number that of the least text hash is first. Null keys order first. An empty table gives an empty result; other columns are ignored.
    """
    gone = removals(similar_lines(docs, key, text, how), key).withColumnRenamed(key, "_key")
    rows = docs.select(F.col(key), F.xxhash64(text).alias("_hash"), F.coalesce(F.size(F.split(text, "\n")), F.lit(0)).alias("n_lines"))
    rows = rows.withColumn("n_lines", F.when(F.col("n_lines") < 0, 0).otherwise(F.col("n_lines")).cast("long"))
    same = rows[key].eqNullSafe(gone["_key"]) & (rows["_hash"] == gone["doc_hash"])
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return rows.join(gone, same, "left").select(
        key, "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed_lines"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", how: Similarity = Similarity(),
                    length: str | None = None) -> DataFrame:
    """``docs`` with the removed lines cut from the text. A document that loses all lines that had a word goes;
    one that loses nothing is unchanged, whatever its text. ``length``: a column to set to the characters left."""
    own_key, own_hash, removed = free_names(docs, "_key", "_hash", "_removed")
    gone = removals(similar_lines(docs, key, text, how), key).where(F.size("removed") > 0)
    gone = gone.select(F.col(key).alias(own_key), F.col("doc_hash").alias(own_hash), F.col("removed").alias(removed))
    same = docs[key].eqNullSafe(gone[own_key]) & (F.xxhash64(docs[text]) == gone[own_hash])
    lines = F.transform(F.split(text, "\n"), lambda l, n: F.when(~F.array_contains(removed, n), l))
    cut = F.array_join(F.array_compact(lines), "\n")
    rows = docs.join(gone, same, "left").withColumn(text, F.when(F.col(removed).isNull(), F.col(text)).otherwise(cut))
    if length:
        rows = rows.withColumn(length, F.when(F.col(removed).isNull(), F.col(length)).otherwise(F.length(text)))
    return rows.where(F.col(removed).isNull() | F.col(text).rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)
