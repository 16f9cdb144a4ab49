"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary.

Every language has a probability for each lower-case piece of a public sentencepiece vocabulary. A word's
probability is the sum over all ways to cut it into pieces (forward algorithm); a text's is the product over its
words. Probabilities are learned by expectation maximisation over word counts of a bounded sample of labelled
documents (``max_documents`` of each language, by a hash of the id); the expectation step is a Spark job, what
returns to the driver is one number for each piece and language.

A word is a run of letters, digits and non-ASCII characters (A-Z lowered); words without a letter say nothing.
Words are whole, however long: sums are rescaled on the way, so that none underflows, and scoring goes through a long
word in stretches that hand on the sums of their last places. Distinct words are scored once and kept.
"""

from __future__ import annotations

import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.llm.shared import crc32_of_id, map_arrow, slices, stored
from terrace.llm.words import ALNUM, mixed, words

PIECES = "piece_bpe_32k.model"
FOLDS, HELD = 4, 2
LONGEST = 24  #: characters of a piece; the vocabulary's longer ones are left out
RESCALED = 8  #: places between two rescalings: (least probability) ** (RESCALED + LONGEST) is still a number
MAX_DOCUMENTS = 3_000
#: Longer words of the sample are scored, but not learned from.
LEARNED_CHARACTERS = 65_536
ROUNDS = 3
#: Of a character that no piece covers, in every language.
UNKNOWN = 1e-7
KEPT_WORDS = 300_000
KEPT_CHARACTERS = 8_000_000
#: Words times places handled at a time, and places of one word.
_CELLS = 1 << 16
_STRETCH = 1 << 16
_PRIME = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Pieces by the hash of their characters, in two tables that together have no collision."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        found = {model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
        self.pieces = sorted(p for p in found if p == p.lower() and len(p) <= LONGEST)
        self.longest = max(map(len, self.pieces))
        width = self.longest
        chars = np.zeros((len(self.pieces), width + 1), np.uint64)
        lengths = np.array([len(p) for p in self.pieces])
        for row, piece in enumerate(self.pieces):
            chars[row, 1 : len(piece) + 1] = [ord(c) for c in piece]
        sums = prefix_hashes(chars[:, 1:])
        self.keys = mixed(sums[np.arange(len(lengths)), lengths] + lengths.astype(np.uint64))
        self.tables = [np.full(1 << 20, -1, np.int32) for _ in range(2)]
        for table, shift in zip(self.tables, (44, 20)):
            left = np.setdiff1d(np.arange(len(self.keys)), np.concatenate([t[t >= 0] for t in self.tables]))
            table[(self.keys[left] >> np.uint64(shift)) & np.uint64((1 << 20) - 1)] = left
        assert sum((t >= 0).sum() for t in self.tables) == len(self.keys), "two pieces share both places"

    def find(self, key: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these keys; -1 for none."""
        out = np.full(len(key), -1, np.int32)
        for table, shift in zip(self.tables, (44, 20)):
            at = table[(key >> np.uint64(shift)) & np.uint64((1 << 20) - 1)]
            out = np.where((at >= 0) & (self.keys[at] == key), at, out)
        return out


def prefix_hashes(chars: np.ndarray) -> np.ndarray:
    """H[:, j]: polynomial hash of the first j characters."""
    out = np.zeros((len(chars), chars.shape[1] + 1), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(chars.shape[1]):
            out[:, j + 1] = out[:, j] * _PRIME + chars[:, j].astype(np.uint64)
    return out


def powers(n: int) -> np.ndarray:
    out = np.ones(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out[i + 1] = out[i] * _PRIME
    return out


class Lattice:
    """All pieces in some strings: for each place, the strings and pieces that start there, and where those end."""

    def __init__(self, vocabulary: Vocabulary, some: list[str]):
        self.lengths = np.array([len(w) for w in some], np.int64)
        self.width = int(self.lengths.max()) if len(some) else 0
        self.longest = vocabulary.longest
        chars = np.array(some, dtype=f"U{max(1, self.width)}").view(np.uint32).reshape(len(some), -1)
        sums, power = prefix_hashes(chars), powers(self.longest)
        unknown = len(vocabulary.pieces)
        found = []
        with np.errstate(over="ignore"):
            for n in range(1, min(self.longest, self.width) + 1):
                row, start = np.nonzero(np.arange(n, self.width + 1) <= self.lengths[:, None])
                key = mixed(sums[row, start + n] - sums[row, start] * power[n] + np.uint64(n))
                piece = vocabulary.find(key)
                if n == 1:
                    piece = np.where(piece < 0, unknown, piece)
                hit = piece >= 0
                found.append(np.stack((start[hit], start[hit] + n, row[hit], piece[hit])).astype(np.int32))
        arcs = np.concatenate(found, 1) if found else np.empty((4, 0), np.int32)
        order = np.argsort(arcs[0] * np.int64(len(some)) + arcs[2], kind="stable")  # by place, then string
        self.starts, self.ends, self.rows, self.pieces = arcs[:, order]
        self.borders = np.searchsorted(self.starts, np.arange(self.width + 2))

    def forward(self, p: np.ndarray, first: np.ndarray | None = None, until: int | None = None):
        """(alpha[place, string, language], log of what alpha was divided by, {place: divisor}); ``p`` has a last row for
        the unknown character. At every RESCALED-th place, it and those ahead are divided by their greatest; each
        segmentation passes each of these places once. ``first``: alpha of the first places; ``until``: the place to stop at."""
        alpha = np.zeros((self.width + self.longest + 1, len(self.lengths), p.shape[1]))
        alpha[: 1 if first is None else len(first)] = 1 if first is None else first
        log, divisors = np.zeros(alpha.shape[1:]), {}
        for i in range(self.width if until is None else until):
            if i % RESCALED == 0 and i:
                ahead = alpha[i : i + self.longest]
                most = ahead.max(0)
                most[most == 0] = 1
                ahead /= most
                log += np.log(most)
                divisors[i] = most
            at = slice(self.borders[i], self.borders[i + 1])
            rows = self.rows[at]
            alpha[self.ends[at], rows] += alpha[i, rows] * p[self.pieces[at]]  # an end and a string meet once
        return alpha, log, divisors

    def log_totals(self, p: np.ndarray) -> np.ndarray:
        alpha, log, _ = self.forward(p)
        return np.log(alpha[self.lengths, np.arange(len(self.lengths))]) + log

    def expected(self, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected pieces under the current probabilities; ``weight``: count of each string in each language."""
        alpha, _, divisors = self.forward(p)
        every = np.arange(len(self.lengths))
        beta = np.zeros_like(alpha)
        beta[self.lengths, every] = weight / alpha[self.lengths, every]
        times = np.zeros((len(self.pieces), p.shape[1]))
        for i in range(self.width - 1, -1, -1):
            at = slice(self.borders[i], self.borders[i + 1])
            rows = self.rows[at]
            through = p[self.pieces[at]] * beta[self.ends[at], rows]
            firsts = np.nonzero(np.diff(rows, prepend=-1))[0]
            if len(firsts):
                beta[i, rows[firsts]] += np.add.reduceat(through, firsts)
            times[at] = alpha[i, rows] * through
            if i in divisors:  # from here on, all comes from before this place
                beta[i : i + self.longest] /= divisors[i]
        return np.stack([np.bincount(self.pieces, times[:, k], len(p)) for k in range(p.shape[1])], 1)


def blocks(some: list[str]):
    """Places of the strings, of like lengths together, _CELLS or one string at a time."""
    order = sorted(range(len(some)), key=lambda i: len(some[i]))
    first = 0
    for k, at in enumerate(order):
        if k > first and (k - first + 1) * (len(some[at]) + 1) > _CELLS:
            yield order[first:k]
            first = k
    if order:
        yield order[first:]


def log_totals(vocabulary: Vocabulary, some: list[str], p: np.ndarray) -> np.ndarray:
    """Log of the summed probability of all segmentations, of each string in each language."""
    out = np.zeros((len(some), p.shape[1]))
    for at in blocks(some):
        if len(some[at[-1]]) <= _STRETCH:
            out[at] = Lattice(vocabulary, [some[i] for i in at]).log_totals(p)
            continue
        for i in at:
            out[i] = _long_total(vocabulary, some[i], p)
    return out


def _long_total(vocabulary: Vocabulary, word: str, p: np.ndarray) -> np.ndarray:
    ahead = np.ones((1, 1, p.shape[1]))
    total = np.zeros(p.shape[1])
    for first in range(0, len(word), _STRETCH):
        stretch = word[first : first + _STRETCH + vocabulary.longest]
        places = min(_STRETCH, len(word) - first)
        alpha, log, _ = Lattice(vocabulary, [stretch]).forward(p, ahead, places)
        ahead = alpha[places : places + vocabulary.longest]
        most = ahead.max(0)
        ahead, total = ahead / most, total + log[0] + np.log(most[0])
    return total + np.log(ahead[0, 0])


@lru_cache(maxsize=2)
def vocabulary(name: str = PIECES) -> Vocabulary:
    import public_tokenizers

    return Vocabulary(public_tokenizers.path(name))


def spoken(distinct: list[str]) -> list[str]:
    """Each word lowered and marked as one; empty if it has no letter."""
    return [f"▁{w.lower()}" if any(map(str.isalpha, w)) else "" for w in distinct]


def held_out(key: str = "doc_id") -> Column:
    return crc32_of_id(key) % FOLDS == HELD


class Model:
    def __init__(self, languages: list[str], p: np.ndarray):
        self.languages, self.p = languages, p


def _probabilities(counts: np.ndarray) -> np.ndarray:
    smooth = counts + 0.05
    return np.vstack([smooth / smooth.sum(0), np.full((1, counts.shape[1]), UNKNOWN)])


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", max_documents: int = MAX_DOCUMENTS,
        rounds: int = ROUNDS) -> Model:
    """Learn from documents with a language, outside the held-out fold: of each language at most about ``max_documents``,
    of them the words of at most LEARNED_CHARACTERS."""
    usable = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(key))
    sizes = {r[lang]: r["count"] for r in usable.groupBy(lang).count().collect()}  # one row for each language
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((1, 0)))
    number = F.element_at(F.create_map(*(F.lit(x) for n, l in enumerate(languages) for x in (l, n))), F.col(lang))
    share = F.element_at(F.create_map(*(F.lit(x) for l in languages for x in (l, max_documents / sizes[l]))), F.col(lang))
    lot = F.pmod(F.xxhash64(key), F.lit(1_000_000)) / 1_000_000
    sample = usable.where(lot < share).select(number.alias("lang"), F.col(text).alias("_text"))

    def split_words(batches):
        for batch in slices(batches, "_text"):
            of = batch.column("lang").to_numpy()
            codes, counts, distinct = words(batch.column("_text"), ALNUM)
            known = spoken(distinct.to_pylist())
            pairs, n = np.unique(np.repeat(of, counts) * max(1, len(distinct)) + codes, return_counts=True)
            langs, code = np.divmod(pairs, max(1, len(distinct)))
            rows = [(int(l), known[c], int(k)) for l, c, k in zip(langs, code, n) if 0 < len(known[c]) <= LEARNED_CHARACTERS]
            columns = zip(*rows) if rows else ([], [], [])
            kinds = (pa.int32(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "w", "n"])

    counted = map_arrow(sample, split_words, "lang int, w string, n bigint")
    one = [F.sum(F.when(F.col("lang") == i, F.col("n")).otherwise(0)) for i in range(len(languages))]
    counts = stored(counted.groupBy("w").agg(F.array(*one).alias("n")), "language-words")
    p = _probabilities(np.ones((len(vocabulary().pieces), len(languages))))
    for _ in range(rounds):
        shared = docs.sparkSession.sparkContext.broadcast(p)

        def expect(batches):
            total = np.zeros_like(shared.value)
            for batch in batches:
                some, n = batch.column("w").to_pylist(), np.array(batch.column("n").to_pylist(), float).reshape(batch.num_rows, -1)
                for at in blocks(some):
                    total += Lattice(vocabulary(), [some[i] for i in at]).expected(shared.value, n[at])
            piece, of = np.nonzero(total[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(of), pa.array(total[piece, of])], names=["piece", "lang", "n"])

        sums = map_arrow(counts, expect, "piece bigint, lang bigint, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n"))
        found = np.zeros((len(vocabulary().pieces), len(languages)))
        for r in sums.collect():  # pieces x languages at most
            found[r["piece"], r["lang"]] = r["n"]
        p = _probabilities(found)
    return Model(languages, p)


class Scorer:
    def __init__(self, p: np.ndarray):
        self.p = p
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.held = 0
        self.logs = np.empty((0, self.p.shape[1]), np.float32)
        self.letters = np.empty(0, bool)

    def places(self, distinct: list[str]) -> np.ndarray:
        if len(self.place) > KEPT_WORDS or self.held > KEPT_CHARACTERS:
            self._forget()
        new = [w for w in distinct if w not in self.place]
        known = spoken(new)
        said = [k for k, w in enumerate(known) if w]
        logs = np.zeros((len(new), self.p.shape[1]))
        logs[said] = log_totals(vocabulary(), [known[k] for k in said], self.p)
        self.held += sum(map(len, new))
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
        self.logs = np.concatenate((self.logs, logs.astype(np.float32)))
        self.letters = np.concatenate((self.letters, np.array([bool(w) for w in known], bool)))
        return np.fromiter((self.place[w] for w in distinct), np.int64, len(distinct))

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each text in each language, and its words with a letter."""
        codes, counts, distinct = words(texts, ALNUM)
        place = self.places(distinct.to_pylist())[codes]
        row = np.repeat(np.arange(len(counts)), counts)
        logs = [np.bincount(row, self.logs[place, k], len(counts)) for k in range(self.p.shape[1])]
        return np.stack(logs, 1), np.bincount(row, self.letters[place], len(counts))


#: The scorer of the model at work in this process.
_scorers: dict[str, Scorer] = {}


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, held_out, lang_pred, score of every row, from the text alone. ``und`` with score 0 where the text is
    null or has no letter, or where nothing was learned. score: the language's share of the probability of all
    learned languages. Words of any length and very long texts are scored whole. Null keys and repeated rows are scored like
    others; an empty table gives an empty result; other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model.p)
    languages = np.array([*model.languages, "und"], dtype=object)

    def score(batches):
        scorer = _scorers.get(name)
        if scorer is None:
            _scorers.clear()
            scorer = _scorers[name] = Scorer(shared.value)
        for batch in slices(batches, "_text"):
            if model_size:
                logs, n = scorer.score(batch.column("_text"))
                best = logs.argmax(1)
                share = 1 / np.exp(logs - logs.max(1)[:, None]).sum(1)
            else:
                n = np.zeros(batch.num_rows)
                best, share = np.zeros(batch.num_rows, int), n
            best, share = np.where(n > 0, best, model_size), np.where(n > 0, share, 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), batch.column("held_out"), pa.array(languages[best].tolist(), pa.string()), pa.array(share)],
                names=[key, "held_out", "lang_pred", "score"],
            )

    model_size, name = len(model.languages), uuid.uuid4().hex
    schema = f"`{key}` {dict(docs.dtypes)[key]}, held_out boolean, lang_pred string, score double"
    return map_arrow(docs.select(key, held_out(key).alias("held_out"), F.col(text).alias("_text")), score, schema)


def language_id(docs: DataFrame, max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    return identify(docs, fit(docs, max_documents=max_documents))
