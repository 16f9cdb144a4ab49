"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text, compared window by window.

Both dictionaries share a base, which zstandard trains on ordinary windows. Besides, the toxic one has text pieces that recur
in toxic documents in ever other surroundings, the ordinary one as much ordinary text. These stand ahead of the base (which is
then searched first, so that common text is found there by both) or after it, whichever tells the classes better apart in
calibration. A window of 64 bytes (some ten words) is compressed with each. What the toxic dictionary saves over the ordinary
one tells, as the common syllables cost the same in both. A document's score is a logistic curve over its windows' savings: their sum, how many lie beyond
calibrated thresholds, the largest.

Fitting uses a bounded sample of labelled documents (``max_toxic``, ``max_ordinary``, by a hash of the id; of each the
first ``max_bytes``). Three quarters of it give the dictionaries, the rest calibrates.

1. Byte strings of ``piece`` bytes are counted once for each distinct surroundings, so that copies of a document,
   or of a passage, count once. The log-likelihood ratio of toxic against ordinary counts says which are telling.
2. Stretches of telling strings in toxic texts are the toxic pieces; the commonest are taken until every telling string is held.
3. Scoring reads whole texts in one pass, unshuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.llm.shared import crc32_of_id, free_names, map_arrow, slices, stored
from terrace.llm.words import ALNUM, mixed

FOLDS = 5
#: What a dictionary ends in whose last bytes are pieces: zstandard does not look for matches in the last ones.
CLOSE = b"~~~~~~~~~~"


@dataclass(frozen=True)
class Fitting:
    max_toxic: int = 2_000  #: documents of the sample, about
    max_ordinary: int = 4_000
    max_bytes: int = 20_000  #: of each
    window: int = 64  #: bytes
    stride: int = 32
    piece: int = 6  #: bytes of the strings that are counted
    around: int = 10  #: bytes on either side that make their surroundings ...
    away: int = 24  #: ... and how far off they begin, so that a phrase is not its own surroundings
    min_count: int = 6  #: surroundings of a telling string in toxic text, at least
    min_odds: float = 8.0
    min_ratio: float = 45.0  #: twice the log-likelihood ratio
    max_strings: int = 20_000  #: telling strings, and stretches of them, that are looked at
    longest: int = 40  #: bytes of a stretch
    toxic_bytes: int = 8_192
    base_bytes: int = 32_768
    base_windows: int = 15_000
    base_window: int = 200
    beyond: tuple[int, ...] = (4, 6)  #: bytes saved in a window


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]
    how: Fitting


def held_out(key: str = "doc_id") -> Column:
    return crc32_of_id(key) % FOLDS == 0


def plain(texts: pa.Array) -> Iterator[bytes]:
    """Each text's letters, digits and other-than-ASCII, lowered, one space for all else between and around."""
    for text in texts.cast(pa.binary()).to_pylist():
        yield b" " + b" ".join((text or b"").translate(ALNUM).split()) + b" "


def strings(text: bytes, how: Fitting) -> np.ndarray:
    """The ``piece`` bytes from each place on, as numbers."""
    held = np.frombuffer(text, np.uint8).astype(np.int64)
    n = max(0, len(held) - how.piece + 1)
    out = np.zeros(n, np.int64)
    for k in range(how.piece):
        out = out << 8 | held[k : k + n]
    return out


def surroundings(text: bytes, how: Fitting) -> np.ndarray:
    """A hash of the bytes some way ahead of and after each place's string."""
    pad = how.away + how.around
    held = np.frombuffer(bytes(pad) + text + bytes(pad), np.uint8).astype(np.uint64)
    n = max(0, len(text) - how.piece + 1)
    out = np.zeros(n, np.uint64)
    after = pad + how.piece + how.away
    with np.errstate(over="ignore"):
        for k in (*range(how.around), *range(after, after + how.around)):
            out = out * np.uint64(0x9E3779B97F4A7C15) + held[k : k + n] + np.uint64(1)
    return mixed(out).view(np.int64)


class Windows:
    """What the toxic dictionary saves over the ordinary one in each window of a text."""

    def __init__(self, toxic: bytes, ordinary: bytes, how: Fitting):
        self.toxic, self.ordinary, self.how = self._compressor(toxic), self._compressor(ordinary), how

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        known = zstandard.ZstdCompressionDict(content or b"-", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        settings = zstandard.ZstdCompressionParameters(
            window_log=18, hash_log=16, chain_log=17, search_log=9, min_match=4, target_length=64,
            strategy=zstandard.STRATEGY_LAZY2, write_checksum=False, write_content_size=False, write_dict_id=False,
            format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        )
        return zstandard.ZstdCompressor(dict_data=known, compression_params=settings)

    def savings(self, text: bytes) -> np.ndarray:
        toxic, ordinary, how = self.toxic.compress, self.ordinary.compress, self.how
        if not text.strip():
            return np.empty(0)
        cut = [text[s : s + how.window] for s in range(0, max(1, len(text) - how.stride), how.stride)]
        return np.array([len(ordinary(w)) - len(toxic(w)) for w in cut], float)

    def features(self, texts: pa.Array) -> np.ndarray:
        out = []
        for text in plain(texts):
            saved = self.savings(text)
            n = len(saved)
            if not n:
                out.append([1.0] + [0.0] * (4 + len(self.how.beyond)))
                continue
            over = [np.log1p((saved >= b).sum()) for b in self.how.beyond]
            total, excess = np.clip(saved, 0, None).sum() / np.sqrt(n), np.sqrt(np.clip(saved - 1, 0, None).mean())
            out.append([1.0, total, *over, excess, np.clip(saved.max(), -3, 12) / 5, np.log1p(n) / 10])
        return np.array(out).reshape(-1, 5 + len(self.how.beyond))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights by Newton's method, and the log loss."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-9, 1 - 1e-9)
    return w, float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def fit(docs: DataFrame, labels: DataFrame, how: Fitting = Fitting(), key: str = "doc_id", text: str = "text") -> Model:
    """Learn from the labelled documents outside the held-out fold. Without labels of both classes nothing is
    learned, and every score is the same. A key that repeats gives one text, the least."""
    usable = labels.where(F.col("toxic").isin(0, 1) & ~held_out(key)).select(F.col(key).alias("key"), F.col("toxic").cast("int").alias("toxic"))
    usable = usable.groupBy("key").agg(F.max("toxic").alias("toxic"))  # a repeated label is one
    sizes = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return Model(b"", b"", (-2.0,), how)
    share = F.when(F.col("toxic") == 1, how.max_toxic / sizes[1]).otherwise(how.max_ordinary / sizes[0])
    lot = F.pmod(F.xxhash64("key"), F.lit(1_000_000)) / 1_000_000
    drawn = stored(usable.where(lot < share), "toxicity-drawn")  # max_toxic + max_ordinary rows, about: small enough to send
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    rows = rows.join(F.broadcast(drawn), "key").groupBy("key", "toxic").agg(F.min("text").alias("text"))
    rows = rows.select("toxic", F.encode("text", "UTF-8").substr(1, how.max_bytes).alias("text"), (crc32_of_id("key") % 4 == 3).alias("calibrate"))
    return _fit(stored(rows, "toxicity-sample"), how)


def _telling(learn: DataFrame, how: Fitting) -> list[int]:
    def seen(batches):
        for batch in batches:
            for toxic in (0, 1):
                own = batch.filter(pa.array(batch.column("toxic").to_numpy() == toxic))
                texts = list(plain(own.column("text")))
                if not texts:
                    continue
                pairs = np.stack([np.concatenate([f(t, how) for t in texts]) for f in (strings, surroundings)], 1)
                order = np.lexsort((pairs[:, 1], pairs[:, 0]))
                pairs = pairs[order]
                fresh = np.ones(len(pairs), bool)
                fresh[1:] = (pairs[1:] != pairs[:-1]).any(1)
                pairs = pairs[fresh]
                columns = [pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(np.full(len(pairs), toxic, np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["string", "around", "toxic"])

    rows = map_arrow(learn.select("text", "toxic"), seen, "string bigint, around bigint, toxic int").repartition("string")
    counts = rows.distinct().groupBy("string").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("o"))
    counts = stored(counts, "toxicity-counts")
    whole = counts.agg(F.sum("t"), F.sum("o")).first()
    n_toxic, n_ordinary = (float(x or 1) for x in whole)
    t, o = F.col("t"), F.col("o")
    odds = (t / n_toxic) / ((o + 0.5) / n_ordinary)
    expected = (t + o) / (n_toxic + n_ordinary)
    ratio = 2 * (t * F.log(t / (n_toxic * expected)) + F.when(o > 0, o * F.log(o / (n_ordinary * expected))).otherwise(0))
    found = counts.where((t >= how.min_count) & (odds >= how.min_odds)).withColumn("ratio", ratio).where(F.col("ratio") >= how.min_ratio)
    return [r["string"] for r in found.orderBy(F.desc("ratio"), "string").limit(how.max_strings).collect()]


def _stretches(learn: DataFrame, telling: np.ndarray, how: Fitting) -> list[bytes]:
    """Pieces of toxic text that consist of telling strings, the commonest first."""

    def seen(batches):
        for batch in batches:
            out: list[bytes] = []
            for text in plain(batch.column("text")):
                held = strings(text, how)
                if len(held):
                    hit = telling[np.minimum(np.searchsorted(telling, held), len(telling) - 1)] == held
                    edges = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
                    places = zip(np.nonzero(edges == 1)[0].tolist(), np.nonzero(edges == -1)[0].tolist())
                    out += {text[s : min(e - 1 + how.piece, s + how.longest)] for s, e in places}
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["stretch"])

    if not len(telling):
        return []
    found = map_arrow(learn.where("toxic = 1").select("text"), seen, "stretch binary").groupBy("stretch").count().where("count > 1")
    return [bytes(r["stretch"]) for r in found.orderBy(F.desc("count"), "stretch").limit(how.max_strings).collect()]


def _fit(sample: DataFrame, how: Fitting) -> Model:
    learn = sample.where(~F.col("calibrate"))
    telling = np.array(sorted(_telling(learn, how)), np.int64)
    missing, pieces = set(telling.tolist()), b""
    for stretch in _stretches(learn, telling, how):
        own = missing.intersection(strings(stretch, how).tolist())
        if own and len(pieces) + len(stretch) <= how.toxic_bytes:
            pieces = stretch + pieces  # the commonest last, where they are cheapest to refer to
            missing -= own

    def cut(batches):
        for batch in batches:
            out = [t[s : s + how.base_window] for t in plain(batch.column("text")) for s in range(0, 10 * how.base_window, 2 * how.base_window) if t[s:].strip()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["w"])

    windows = map_arrow(learn.where("toxic = 0").select("text"), cut, "w binary").distinct()
    windows = [bytes(r["w"]) for r in windows.orderBy(F.xxhash64("w"), "w").limit(how.base_windows).collect()]
    try:
        base = zstandard.train_dictionary(how.base_bytes, windows, k=200, d=6).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little text to train on
        base = b"".join(windows)[: how.base_bytes]
    opposite = b"".join(windows)[: len(pieces)]
    layouts = [(pieces + base, opposite + base), (base + pieces + CLOSE, base + opposite + CLOSE)]

    def measured(batches):
        compare = [Windows(*layout, how) for layout in layouts]
        for batch in batches:
            held = [pa.array(c.features(batch.column("text")).tolist(), pa.list_(pa.float64())) for c in compare]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *held], names=["y", "x0", "x1"])

    schema = "y int, x0 array<double>, x1 array<double>"
    rows = map_arrow(sample.where("calibrate").select("text", "toxic"), measured, schema).collect()  # a part of the sample
    y = np.array([r["y"] for r in rows], float)
    if not 0 < y.sum() < len(y):
        return Model(*layouts[0], (-3.0, 0.5, 2.0, 2.0, 0.0, 0.0, 0.0), how)
    tried = [(*logistic(np.array([r[f"x{k}"] for r in rows]), y), k) for k in (0, 1)]
    weights, _, best = min(tried, key=lambda x: (x[1], x[2]))
    return Model(*layouts[best], tuple(float(w) for w in weights), how)


@lru_cache(maxsize=2)
def windows_of(toxic: bytes, ordinary: bytes, how: Fitting) -> Windows:
    return Windows(toxic, ordinary, how)


def scored(docs: DataFrame, model: Model, text: str = "text", carry: tuple[str, ...] | None = None) -> DataFrame:
    """``docs`` (all columns, or those to ``carry``) with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) from the text alone. Null, empty
    and wordless texts have no windows and get the curve's value for none; very long texts are scored whole; repeated rows
    score alike; an empty table stays empty. Columns named score or predicted are replaced."""
    own = [c for c in carry or docs.columns if c not in ("score", "predicted")]
    (body,) = free_names(docs, "scored_text")

    def score(batches):
        compare, weights = windows_of(model.toxic, model.ordinary, model.how), np.array(model.weights)
        for batch in slices(batches, body):
            if len(weights) == 1:
                z = np.full(batch.num_rows, weights[0])
            else:
                z = compare.features(batch.column(body)) @ weights
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            columns = [batch.column(c) for c in own]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*own, "score", "predicted"]
            )

    kinds = dict(docs.dtypes)
    schema = "".join(f"`{c}` {kinds[c]}, " for c in own) + "score double, predicted int"
    return map_arrow(docs.select(*own, F.col(text).alias(body)), score, schema)


def toxicity(docs: DataFrame, labels: DataFrame, how: Fitting = Fitting(), key: str = "doc_id") -> DataFrame:
    """``key``, held_out, score, predicted of every row of ``docs``. As :func:`scored`; a null key has no label and the fold of crc32 0."""
    model = fit(docs, labels, how, key)
    rows = docs.select(key, held_out(key).alias("held_out"), "text")
    return scored(rows, model, carry=(key, "held_out"))
