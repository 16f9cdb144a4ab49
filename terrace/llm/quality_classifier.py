"""Quality scores by kernel ridge regression: random Fourier features of document statistics, isotonic calibration.

1. Each text becomes some two dozen statistics of its bytes, words and lines, in one pass; texts go no further.
2. cos(w . x + b) with normal w and uniform b approximates a Gaussian kernel over the standardised statistics.
3. Every partition sums z z' and z y of its labelled rows for each fold; the sums of partitions are added in two steps and
   solved on the driver, a matrix of ``features`` squared a fold, whatever the number of rows.
4. The sums of the other folds give each fold weights that have not seen it. Their scores, counted in narrow bins, are
   made monotone (pool adjacent violators); the last weights are of all folds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.llm.shared import crc32_of_id, map_arrow, slices, stored
from terrace.llm.words import WHITE_AS_IS, split, translated, unique, words

FOLDS = 5
#: Fold that is never learned from; the others take turns.
HELD_OUT = 0

_CLASSES = ("lower", "upper", "digit", "blank", "symbol", "call", "stop", "other", "wide")
_SYMBOLS, _CALLS, _STOPS = b"#$%&*+/<=>@\\^_`{|}~[]", b"!?", b".,;:"


@dataclass(frozen=True)
class Fitting:
    features: int = 384
    width: float = 5.0  #: of the kernel, in standard deviations of the statistics
    ridge: float = 1e-4  #: for each row
    bins: int = 4_000  #: of raw scores from -1 to 2
    seed: int = 11


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None  #: of the features and a constant; None if nothing could be learned
    knots: np.ndarray  #: raw scores ...
    levels: np.ndarray  #: ... and the shares of label 1 there
    how: Fitting


def held_out(key: str = "doc_id") -> Column:
    return crc32_of_id(key) % FOLDS == HELD_OUT


def _byte_classes() -> np.ndarray:
    table = np.full(256, _CLASSES.index("other"))
    for name, members in (
        ("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)), ("blank", (32, *range(9, 14))),
        ("symbol", _SYMBOLS), ("call", _CALLS), ("stop", _STOPS), ("wide", range(128, 256)),
    ):
        table[list(members)] = _CLASSES.index(name)
    return table


CLASS_OF = _byte_classes()


def by_class(texts: pa.Array) -> np.ndarray:
    """Bytes of each class in each text."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = CLASS_OF[np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]]
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))
    return np.bincount(row * len(_CLASSES) + held, minlength=len(texts) * len(_CLASSES)).reshape(len(texts), len(_CLASSES))


def _distinct(row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """How many distinct values each row has."""
    if not len(value):
        return np.zeros(rows)
    return np.bincount(unique(row * (int(value.max()) + 1) + value) // (int(value.max()) + 1), minlength=rows)


STATISTICS = 24


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of STATISTICS numbers for each text; a null text counts as empty, and shares of nothing are 0."""
    n = len(texts)
    texts = translated(texts, bytes(range(256)))
    bytes_of = by_class(texts)
    total = bytes_of.sum(1)

    def share(part, of):
        return np.divide(part, of, out=np.zeros(n), where=np.asarray(of) > 0)

    codes, counts, distinct = words(texts, WHITE_AS_IS)
    codes = codes.astype(np.int64)
    row = np.repeat(np.arange(n), counts)
    kinds = by_class(distinct) if len(distinct) else np.zeros((1, len(_CLASSES)))
    named = dict(zip(_CLASSES, kinds.T))
    letters = named["lower"] + named["upper"] + named["wide"]
    length = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(float) if len(distinct) else np.zeros(1)
    starts, ends = (pc.match_substring_regex(distinct, p).to_numpy(zero_copy_only=False) for p in (r"^[A-Z]", r"[.!?]$"))

    def mean(of_word):
        held = np.bincount(row, weights=np.asarray(of_word, float)[codes], minlength=n) if len(codes) else np.zeros(n)
        return share(held, counts)

    average = mean(length)
    spread = np.sqrt(np.maximum(mean(length**2) - average**2, 0))
    inner = row[1:] == row[:-1] if len(row) else np.empty(0, bool)
    pairs = (codes[:-1] * max(1, len(distinct)) + codes[1:])[inner] if len(row) else np.empty(0, np.int64)
    _, pairs = np.unique(pairs, return_inverse=True)
    pair_row = row[1:][inner] if len(row) else np.empty(0, np.int64)
    held, times = np.unique(row * max(1, len(distinct)) + codes, return_counts=True)
    commonest = np.zeros(n)
    np.maximum.at(commonest, held // max(1, len(distinct)), times)

    line_codes, line_counts, lines = split(texts, "\n")
    line_row = np.repeat(np.arange(n), line_counts)
    closed = pc.match_substring_regex(lines, r"[.!?][\"')»”]*\s*$").to_numpy(zero_copy_only=False) if len(lines) else np.zeros(1)
    closed = np.bincount(line_row, weights=np.asarray(closed, float)[line_codes], minlength=n) if len(line_codes) else np.zeros(n)

    return np.stack(
        [
            np.log1p(total), np.log1p(counts), average, spread, share(np.bincount(held // max(1, len(distinct)), minlength=n), counts),
            *(share(bytes_of[:, k], total) for k in range(len(_CLASSES))),
            mean(starts), mean((named["upper"] > 1) & (named["lower"] == 0)), mean(named["symbol"] > 0), mean(ends), mean(letters == 0),
            np.log1p(line_counts), np.log1p(share(counts, line_counts)), share(_distinct(line_row, line_codes.astype(np.int64), n), line_counts),
            share(closed, line_counts), share(_distinct(pair_row, pairs, n), np.maximum(counts - 1, 0)),
        ], 1,
    )


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fold and stats (array of float) of every row."""

    def measure(batches):
        for batch in slices(batches, "_text"):
            found = statistics(batch.column("_text")).astype(np.float32)
            held = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * STATISTICS), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("fold"), held], names=["key", "fold", "stats"])

    rows = docs.select(F.col(key).alias("key"), (crc32_of_id(key) % FOLDS).cast("int").alias("fold"), F.col(text).alias("_text"))
    return map_arrow(rows, measure, f"key {dict(docs.dtypes)[key]}, fold int, stats array<float>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, STATISTICS).astype(float)


def features(stats: np.ndarray, model: Model) -> np.ndarray:
    """The random features and a constant. Statistics beyond ten standard deviations count as ten."""
    lot = np.random.default_rng(model.how.seed)
    directions = lot.normal(size=(STATISTICS, model.how.features)) / model.how.width
    shifts = lot.uniform(0, 2 * np.pi, model.how.features)
    z = np.clip((stats - model.mean) / model.scale, -10, 10)
    return np.hstack([np.cos(z @ directions + shifts) * np.sqrt(2 / model.how.features), np.ones((len(z), 1))])


def _added(sums: DataFrame, schema: str, parts: int) -> DataFrame:
    """Rows (fold, n, a, b) of float64 arrays added up in each of ``parts`` tasks; a task holds one sum a fold."""

    def add(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                own = [row["n"], *(np.frombuffer(row[c]) for c in ("a", "b"))]
                held[row["fold"]] = [x + y for x, y in zip(held[row["fold"]], own)] if row["fold"] in held else own
        for fold, (n, a, b) in held.items():
            yield pa.RecordBatch.from_pylist([{"fold": fold, "n": n, "a": a.tobytes(), "b": b.tobytes()}], schema=_SUMS)

    return map_arrow(sums.repartition(parts), add, schema)


_SUMS = pa.schema([("fold", pa.int32()), ("n", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])
_SUMS_SQL = "fold int, n bigint, a binary, b binary"
#: Sums that one task adds in a step; well above the number of folds, as a task gives one sum for each.
FAN_IN = 64


def normal_equations(labelled: DataFrame, model: Model) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """For each fold the rows and the sums of z z' and z y over ``labelled`` (fold, stats, y)."""

    def sum_up(batches):
        size = model.how.features + 1
        held: dict[int, list] = {}
        for batch in batches:
            z, y = features(_matrix(batch.column("stats")), model), batch.column("y").to_numpy().astype(float)
            fold = batch.column("fold").to_numpy()
            for k in np.unique(fold).tolist():
                sums = held.setdefault(k, [0, np.zeros((size, size)), np.zeros(size)])
                own, label = z[fold == k], y[fold == k]
                sums[0] += len(own)
                sums[1] += own.T @ own
                sums[2] += own.T @ label
        for fold, (n, a, b) in held.items():
            yield pa.RecordBatch.from_pylist([{"fold": fold, "n": n, "a": a.tobytes(), "b": b.tobytes()}], schema=_SUMS)

    sums = stored(map_arrow(labelled.select("fold", "stats", "y"), sum_up, _SUMS_SQL), "quality-sums")
    rows = sums.count()
    while rows > FAN_IN:
        sums = stored(_added(sums, _SUMS_SQL, -(-rows // FAN_IN)), "quality-sums")
        rows = sums.count()
    size = model.how.features + 1
    out: dict[int, tuple] = {}
    for row in sums.toLocalIterator():  # FAN_IN matrices at most
        n, a, b = out.get(row["fold"], (0, 0.0, 0.0))
        out[row["fold"]] = (n + row["n"], a + np.frombuffer(row["a"]).reshape(size, size), b + np.frombuffer(row["b"]))
    return out


def solved(parts: list[tuple[int, np.ndarray, np.ndarray]], ridge: float) -> np.ndarray:
    n, a, b = (sum(p[k] for p in parts) for k in range(3))
    return np.linalg.solve(a + ridge * n * np.eye(len(b)), b)


def isotonic(at: np.ndarray, n: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and levels of the least-squares non-decreasing curve through the shares ones / n at ascending places."""
    blocks: list[list[float]] = []
    for x, count, positive in zip(at.tolist(), n.tolist(), ones.tolist()):
        blocks.append([x * count, count, positive])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [u + v for u, v in zip(blocks[-1], last)]
    held = np.array(blocks)
    return held[:, 0] / held[:, 1], held[:, 2] / held[:, 1]


def raw_bins(how: Fitting, raw: np.ndarray) -> np.ndarray:
    return np.clip(((raw + 1) / 3 * how.bins).astype(np.int64), 0, how.bins - 1)


def fit(stats: DataFrame, labels: DataFrame, how: Fitting = Fitting(), key: str = "doc_id", label: str = "quality") -> Model:
    """Learn from all labelled rows of ``stats`` outside the held-out fold. Labels other than 0 and 1 are ignored, repeated
    ones of a key are one (the highest). Without both labels nothing is learned, and every score is the same."""
    known = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("y"))
    labelled = stored(stats.where(F.col("fold") != HELD_OUT).join(known, "key").select("fold", "stats", "y"), "quality-labelled")
    sums = [f(F.col("stats")[k]).alias(f"{f.__name__}{k}") for k in range(STATISTICS) for f in (F.avg, F.stddev_pop)]
    found = labelled.agg(F.count("*").alias("n"), F.sum("y").alias("ones"), *sums).first()
    if not found["n"] or not 0 < found["ones"] < found["n"]:
        level = np.array([0.5 if not found["n"] else found["ones"] / found["n"]])
        return Model(np.zeros(STATISTICS), np.ones(STATISTICS), None, np.zeros(1), level, how)
    mean, scale = (np.array([found[f"{f}{k}"] for k in range(STATISTICS)], float) for f in ("avg", "stddev_pop"))
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), None, np.zeros(1), np.zeros(1), how)
    parts = normal_equations(labelled, model)
    weights = solved(list(parts.values()), how.ridge)
    folds = {k: solved([p for j, p in parts.items() if j != k] or [parts[k]], how.ridge) for k in parts}

    def score(batches):
        for batch in batches:
            z, fold = features(_matrix(batch.column("stats")), model), batch.column("fold").to_numpy()
            raw = np.zeros(len(fold))
            for k in np.unique(fold).tolist():
                raw[fold == k] = z[fold == k] @ folds[k]
            yield pa.RecordBatch.from_arrays([pa.array(raw_bins(how, raw)), batch.column("y")], names=["bin", "y"])

    counts = map_arrow(labelled.select("fold", "stats", "y"), score, "bin bigint, y int")
    counts = counts.groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("ones")).orderBy("bin").collect()  # bins at most
    at, n, ones = np.array([tuple(r) for r in counts], float).T
    knots, levels = isotonic((at + 0.5) / how.bins * 3 - 1, n, ones)
    return Model(model.mean, model.scale, weights, knots, levels, how)


def scores(stats: np.ndarray, model: Model) -> np.ndarray:
    if model.weights is None:
        return np.full(len(stats), model.levels[0])
    return np.interp(features(stats, model) @ model.weights, model.knots, model.levels)


def scored(stats: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """key, fold, score (0 to 1) and predicted (1 from ``threshold`` on) of rows that :func:`measured` gave."""

    def score(batches):
        for batch in batches:
            found = scores(_matrix(batch.column("stats")), model)
            columns = [batch.column("key"), batch.column("fold"), pa.array(found), pa.array((found >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "fold", "score", "predicted"])

    return map_arrow(stats, score, f"key {dict(stats.dtypes)['key']}, fold int, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame, how: Fitting = Fitting(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, held_out, score and predicted of every row of ``docs``, from the text alone.

    Null and empty texts have statistics of zero and get the curve's value there; texts of any length are measured whole.
    Repeated rows score alike, a null key is held in the fold of crc32 0 and has no label. Without labels of both kinds
    every score is the share of label 1 (a half without any). An empty table gives an empty result; other columns are ignored.
    """
    stats = stored(measured(docs, key, text), "quality-statistics")
    found = scored(stats, fit(stats, labels, how, key))
    return found.select(F.col("key").alias(key), (F.col("fold") == HELD_OUT).alias("held_out"), "score", "predicted")
