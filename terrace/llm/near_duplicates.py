"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, star-shaped edges.

A document's set is its distinct 5-word shingles. One hash of each shingle gives both its bin and its value; a bin
keeps its least value, and an empty bin borrows from bins drawn by a hash of (bin, attempt) until one is full.
``rows`` bins make a band; documents that agree in a band share a bucket. With 40 bands of 8, a pair at the
threshold of 0.85 shares no bucket with probability 3e-6.

Equal sets are one class from the start, so copies cost nothing later. In a bucket every class is compared with
one centre only: the class whose buckets are largest, which for a group of edited copies tends to be what they
were copied from. A star has as many edges as members. Classes linked to their centre are one component; pairs
of a bucket that this leaves in different components are compared in a second round, inside blocks of bounded size,
by short hashes of the whole sets where both are small, else by their signatures (a pair is passed over only if
its estimate lies five standard deviations below the threshold). Every link is confirmed on the full sets.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.llm.components import components
from terrace.llm.shared import free_names, map_arrow, slices, stored
from terrace.llm.words import WHITE, hashed, mixed, unique, words

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class Settings:
    shingle: int = 5
    percent: int = 85  #: linked from 100 * intersection >= percent * union on
    bands: int = 40
    rows: int = 8
    block: int = 256  #: members of a bucket compared at a time in the second round
    few: int = 640  #: sets up to this size are also kept whole, at 16 bits a shingle

    @property
    def bins(self) -> int:
        return self.bands * self.rows


def shingle_sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts in a row, and how many each text has. A text of fewer words
    than a shingle, but not none, is one shingle."""
    codes, counts, distinct = words(texts, WHITE)
    of_word = hashed(distinct)[codes]
    sets, n = [], np.zeros(len(counts), np.int64)
    ends = np.cumsum(counts)
    with np.errstate(over="ignore"):
        whole = max(0, len(of_word) - shingle + 1)
        rolled = np.full(whole, np.uint64(shingle))
        for i in range(shingle):
            rolled = rolled * _PRIME + of_word[i : i + whole]
        rolled = mixed(rolled)
        for k, (end, count) in enumerate(zip(ends.tolist(), counts.tolist())):
            if not count:
                continue
            if count >= shingle:
                found = unique(rolled[end - count : end - shingle + 1])
            else:
                value = np.array([count], np.uint64)
                for h in of_word[end - count : end]:
                    value = value * _PRIME + h
                found = mixed(value)
            sets.append(found)
            n[k] = len(found)
    return (np.concatenate(sets) if sets else np.empty(0, np.uint64)), n


def signatures(sets: np.ndarray, n: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation minima of each non-empty set, densified."""
    rows = np.repeat(np.arange(len(n)), n)
    bin_of = ((sets >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    with np.errstate(over="ignore"):
        values = mixed(sets * _PRIME + np.uint64(1))
    out = np.full(len(n) * bins, _EMPTY)
    np.minimum.at(out, rows * bins + bin_of.astype(np.int64), values)
    out = out.reshape(len(n), bins)
    full = out != _EMPTY
    row, col = np.nonzero(~full & (n > 0)[:, None])
    attempt = 0
    while len(row):
        with np.errstate(over="ignore"):
            donor = (mixed(col.astype(np.uint64) * _PRIME + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        found = full[row, donor]
        out[row[found], col[found]] = out[row[found], donor[found]]
        row, col = row[~found], col[~found]
        attempt += 1
    return out


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    rows = signature.shape[1] // bands
    parts = signature.reshape(len(signature), bands, rows)
    with np.errstate(over="ignore"):
        key = np.arange(1, bands + 1, dtype=np.uint64)[None, :].repeat(len(signature), 0)
        for i in range(rows):
            key = mixed(key * _PRIME + parts[:, :, i])
    return key.view(np.int64)


def class_of(sets: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One number for each distinct set; 0 for the empty set."""
    ends = np.cumsum(n)
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(sets ^ _PRIME))))
        value = mixed((total[ends] - total[ends - n]) * _PRIME + n.astype(np.uint64))
    return np.where(n > 0, np.where(value == 0, np.uint64(1), value), np.uint64(0)).view(np.int64)


def _signed(docs: DataFrame, key: str, text: str, how: Settings) -> DataFrame:
    def sign(batches):
        for batch in slices(batches, "_text"):
            sets, n = shingle_sets(batch.column("_text"), how.shingle)
            signature = signatures(sets, n, how.bins)
            bands = pa.array(band_keys(signature, how.bands).ravel())
            offsets = pa.array(np.arange(len(n) + 1, dtype=np.int32) * how.bands)
            low = signature.astype(np.uint8)
            ends = np.cumsum(n)
            short = [
                unique(sets[e - k : e].astype(np.uint16)).tobytes() if k <= how.few else None for e, k in zip(ends, n)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key),
                    batch.column("_hash"),
                    pa.array(n),
                    pa.array(class_of(sets, n)),
                    pa.ListArray.from_arrays(offsets, bands),
                    pa.array([row.tobytes() for row in low], pa.binary()),
                    pa.array(short, pa.binary()),
                ],
                names=[key, "hash", "n", "cid", "bands", "sig", "short"],
            )

    schema = f"`{key}` {dict(docs.dtypes)[key]}, hash bigint, n bigint, cid bigint, bands array<bigint>, sig binary, short binary"
    return map_arrow(docs.select(key, F.xxhash64(text).alias("_hash"), F.col(text).alias("_text")), sign, schema)


def _sets_of(docs: DataFrame, wanted: DataFrame, text: str, key: str, how: Settings) -> DataFrame:
    """(cid, n, set) of the wanted classes, each from one document that holds it."""

    def read(batches):
        for batch in slices(batches, "_text"):
            sets, n = shingle_sets(batch.column("_text"), how.shingle)
            offsets = pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
            held = pa.ListArray.from_arrays(offsets, pa.array(sets.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(class_of(sets, n)), batch.column("want"), held], names=["cid", "want", "set"])

    body = docs.select(F.col(key).alias("_id"), F.xxhash64(text).alias("_hash"), F.col(text).alias("_text"))
    named = wanted.select(F.col("first.key").alias("key"), F.col("first.hash").alias("hash"), F.col("cid").alias("want"))
    rows = body.join(named, F.col("_id").eqNullSafe(F.col("key")) & (F.col("_hash") == F.col("hash")))
    read_back = map_arrow(rows.select("want", "_text"), read, "cid bigint, want bigint, set array<bigint>")
    return read_back.where("cid = want").dropDuplicates(["cid"]).select("cid", "set")


def _confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, text: str, key: str, how: Settings) -> DataFrame:
    """Pairs (u, v) that are linked, by their full sets. Lengths alone rule out many."""
    ids = pairs.select(F.col("u").alias("cid")).union(pairs.select("v")).distinct()
    sets = stored(_sets_of(docs, classes.join(ids, "cid").select("cid", "first"), text, key, how), "near-sets")
    both = pairs.join(sets.toDF("u", "a"), "u").join(sets.toDF("v", "b"), "v")
    shared = F.size(F.array_intersect("a", "b"))
    linked = both.select("u", "v", shared.alias("i"), (F.size("a") + F.size("b")).alias("s"))
    return linked.where(100 * F.col("i") >= how.percent * (F.col("s") - F.col("i"))).select("u", "v")


def _estimated(a: Column, b: Column, n_a: Column, n_b: Column, how: Settings) -> Column:
    """Whether the set sizes allow a link at all."""
    return (100 * F.least(n_a, n_b) >= how.percent * F.greatest(n_a, n_b)) & (a != b)


def alike(a: np.ndarray, b: np.ndarray, n: np.ndarray, how: Settings) -> np.ndarray:
    """Share of equal bins, and whether it leaves a link possible: not five deviations below the threshold. A
    set with fewer shingles than bins has only so many independent bins."""
    share = (a == b).mean(-1)
    t = how.percent / 100
    return share, share >= t - 5 * np.sqrt(t * (1 - t) / np.minimum(n, how.bins))


def _best_star(members: DataFrame, reps: DataFrame, how: Settings) -> DataFrame:
    """For each class the centre, among those of its buckets, that its signature is most like: (u, v)."""
    support = members.groupBy("cid").agg(F.sum("size").alias("support"))
    known = members.join(support, "cid")
    centres = known.groupBy("bucket").agg(F.max(F.struct("support", "cid")).alias("top"))
    edges = known.join(centres, "bucket").select(F.col("cid").alias("u"), F.col("top.cid").alias("v"))
    edges = edges.where("u <> v").distinct()
    signed = reps.select("cid", "n", "sig")
    pairs = edges.join(signed.toDF("u", "nu", "su"), "u").join(signed.toDF("v", "nv", "sv"), "v")
    pairs = pairs.where(_estimated(F.col("u"), F.col("v"), F.col("nu"), F.col("nv"), how))

    def weigh(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, how.bins) for c in ("su", "sv"))
                n = np.minimum(batch.column("nu").to_numpy(), batch.column("nv").to_numpy())
                share, possible = alike(a, b, n, how)
                keep = pa.array(possible)
                yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(share)], names=["u", "v", "like"]).filter(keep)

    weighed = map_arrow(pairs, weigh, "u bigint, v bigint, like double")
    best = weighed.groupBy("u").agg(F.max(F.struct("like", "v")).alias("top"))
    return best.select("u", F.col("top.v").alias("v"))


def _second_round(members: DataFrame, reps: DataFrame, how: Settings) -> DataFrame:
    """Possible pairs (u, v) of one bucket whose components differ. Buckets are cut into blocks by a hash of the
    class; every pair of blocks is compared in one place, so no task holds more than two blocks of a bucket."""
    mixed_buckets = members.groupBy("bucket").agg(F.count("*").alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    mixed_buckets = mixed_buckets.where("lo <> hi").select("bucket", F.ceil(F.col("m") / how.block).cast("int").alias("blocks"))
    rows = members.join(mixed_buckets, "bucket").join(reps.select("cid", "n", "sig", "short"), "cid")
    own = F.pmod(F.xxhash64("cid", "bucket"), F.col("blocks")).cast("int")
    placed = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select(
        "bucket", "cid", "root", "n", "sig", "short", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")
    )
    dealt = placed.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "n", "cid")

    sure, margin = how.percent / 100 + 0.02, 0.02  # short hashes of 640 shingles agree by chance in under 1 %

    def pairs_of(rows: list) -> tuple[list, list]:
        us, vs = [], []
        cid, root, n, own, lo, hi = (np.array([r[i] for r in rows]) for i in range(6))
        sig = np.frombuffer(b"".join(r[6] for r in rows), np.uint8).reshape(-1, how.bins)
        whole = np.array([r[7] is not None for r in rows])
        shorts = [np.frombuffer(r[7], np.uint16) if r[7] is not None else np.empty(0, np.uint16) for r in rows]
        sizes = np.array([len(x) for x in shorts])
        flat, ends = np.concatenate(shorts), np.cumsum(sizes)
        between = lo[0] != hi[0]
        held = np.zeros(1 << 16, bool)
        for k in range(len(rows) - 1):
            end = int(np.searchsorted(n, n[k] * 100 // how.percent, side="right"))
            later = slice(k + 1, end)
            wanted = np.nonzero((root[later] != root[k]) & ((own[later] != own[k]) | (not between)))[0] + k + 1
            if not len(wanted):
                continue
            _, possible = alike(sig[wanted], sig[k], np.minimum(n[wanted], n[k]), how)
            wanted = wanted[possible]
            near = np.ones(len(wanted))
            exact = whole[wanted] & whole[k]
            if exact.any():
                some = wanted[exact]
                held[shorts[k]] = True
                total = np.concatenate(([0], np.cumsum(held[flat[ends[some[0]] - sizes[some[0]] : ends[some[-1]]]])))
                base = ends[some[0]] - sizes[some[0]]
                shared = total[ends[some] - base] - total[ends[some] - sizes[some] - base]
                held[shorts[k]] = False
                near[exact] = shared / np.maximum(1, sizes[some] + sizes[k] - shared)
                wanted, near, exact = (x[(near >= how.percent / 100 - margin) | ~exact] for x in (wanted, near, exact))
            for j, like, known in zip(wanted.tolist(), near.tolist(), exact.tolist()):
                if root[j] != root[k]:
                    us.append(int(cid[k]))
                    vs.append(int(cid[j]))
                    if known and like >= sure:  # will be confirmed: from here on one component
                        root[root == root[j]] = root[k]
        return us, vs

    def compare(batches):
        held, at = [], None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("cid", "root", "n", "own", "lo", "hi", "sig", "short", "bucket")]
            us, vs = [], []
            for row in zip(*columns):
                where = (row[8], row[4], row[5])
                if where != at:
                    if len(held) > 1:
                        u, v = pairs_of(held)
                        us, vs = us + u, vs + v
                    held, at = [], where
                held.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])
        if len(held) > 1:
            us, vs = pairs_of(held)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    found = map_arrow(dealt, compare, "u bigint, v bigint")
    return found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _judged(docs: DataFrame, key: str, text: str, how: Settings) -> DataFrame:
    """``key``, hash (of the text), n, component_id, kept of every row."""
    signed = stored(_signed(docs, key, text, how), "near-signatures")
    full = signed.where("n > 0")
    place = F.struct(F.col(key).isNull().alias("unnamed"), F.col(key).alias("key"), "hash")
    classes = full.groupBy("cid").agg(F.min(place).alias("first"))
    reps = stored(full.select("cid", "n", "bands", "sig", "short").dropDuplicates(["cid"]), "near-classes")
    buckets = reps.select("cid", F.explode("bands").alias("bucket"))
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = stored(buckets.join(sizes, "bucket"), "near-buckets")

    stars = stored(_best_star(members, reps, how), "near-stars")
    linked = stored(_confirmed(stars, docs, classes, text, key, how), "near-links")
    roots = components(linked)
    rooted = members.join(roots.withColumnRenamed("node", "cid"), "cid", "left")
    rooted = rooted.select("bucket", "cid", F.coalesce("root", "cid").alias("root"))
    rest = stored(_second_round(rooted, reps, how), "near-rest")
    more = _confirmed(rest, docs, classes, text, key, how)
    roots = stored(components(linked.union(more)), "near-components")

    grouped = classes.join(roots.withColumnRenamed("node", "cid"), "cid", "left")
    grouped = stored(grouped.select("cid", "first", F.coalesce("root", "cid").alias("root")), "near-grouped")
    several = roots.select("root").distinct()
    least = grouped.join(several, "root", "left_semi").groupBy("root").agg(F.min("first").alias("least"))
    named = grouped.join(least, "root", "left").select("cid", F.coalesce("least", "first").alias("least"))
    result = signed.select(key, "hash", "n", "cid").join(named, "cid", "left")
    own = F.col(key).eqNullSafe(F.col("least.key")) & (F.col("hash") == F.col("least.hash"))
    return result.select(
        key, "hash", "n", F.coalesce("least.key", key).alias("component_id"), F.coalesce((F.col("n") == 0) | own, F.lit(False)).alias("kept")
    )


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", how: Settings = Settings()) -> DataFrame:
    """``key``, n_shingles, component_id (the least key reachable over links, the row's own included), kept (the row
    has that least key and, where several texts of the component have it, the first text by hash) of every row.

    Null and empty texts have no shingles, link with nothing and are kept. Rows that repeat both key and text report
    the same component and are kept or not together; a key that repeats with other text stands for each of its texts.
    A null key takes part in links and is never a component's name where another key is; of a component of null
    keys only, one text is kept. An empty table gives an empty result; other columns are ignored.
    """
    judged = _judged(docs, key, text, how)
    return judged.select(key, F.col("n").alias("n_shingles"), "component_id", "kept")


def kept_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", how: Settings = Settings()) -> DataFrame:
    """One document of each component, and every row without a shingle. Of rows that repeat a kept key with the
    same text one stays, whatever their other columns hold."""
    own_key, own_hash, repeats, text_hash = free_names(docs, "_key", "_hash", "_repeats", "_own")
    judged = _judged(docs, key, text, how).where("kept")
    places = judged.groupBy(F.col(key).alias(own_key), F.col("hash").alias(own_hash)).agg(
        ((F.count("*") > 1) & (F.max("n") > 0)).alias(repeats)
    )
    places = stored(places, "near-kept")
    body = docs.withColumn(text_hash, F.xxhash64(text))

    def held(some: DataFrame) -> DataFrame:
        return body.join(some, F.col(key).eqNullSafe(F.col(own_key)) & (F.col(text_hash) == F.col(own_hash)), "left_semi")

    once = held(places.where(F.col(repeats))).dropDuplicates([key, text_hash])
    return held(places.where(~F.col(repeats))).unionByName(once).select(*docs.columns)
