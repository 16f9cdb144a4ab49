"""Each operator against a brute-force twin or an exact round trip, and on awkward tables."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terrace.llm import (
    decontaminate, language_id, line_dedup, near_duplicates, packing, quality_rules, queries, sharding, token_counts, toxicity, warc,
)
from terrace.llm.shared import shared_folder
from terrace.llm.words import WHITE, WHITE_IN_LINES, hashed_at, placed, translated

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def white_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def sample(spark):
    """Made texts with copies, edited copies, shared lines, toxic words and a benchmark passage."""
    rng = np.random.default_rng(5)
    vocabulary = {
        "en": ["".join(rng.choice(list("aeiostrnhl"), 3 + i % 4)) for i in range(120)],
        "de": ["".join(rng.choice(list("üäzkgchseun"), 3 + i % 5)) for i in range(120)],
    }
    passage = " ".join(vocabulary["en"][i] for i in rng.integers(0, 120, 14))
    shared = " ".join(vocabulary["en"][i] for i in rng.integers(0, 120, 60))
    rows, toxic = [], []
    for i in range(220):
        lang = "de" if i % 3 == 0 else "en"
        lines = [" ".join(rng.choice(vocabulary[lang], 15)).capitalize() + "." for _ in range(6)]
        if i % 10 == 1:
            lines.insert(2, shared)
        if i % 10 == 2:
            lines.append(f"Also, {passage.upper()}!")
        if i % 5 == 4:
            lines[0] += " grobbelfink schnurzpiep"
            toxic.append(i)
        rows.append([i, "\n".join(lines), lang, f"s{i % 3}", 0])
    for i in range(220, 260):  # copies and edited copies
        words = rows[i % 20][1].split(" ")
        if i % 2:
            words[7] = "changed"
        rows.append([i, " ".join(words), rows[i % 20][2], "s0", 0])
    return {
        "docs": spark.createDataFrame([tuple(r) for r in rows], DOCS).cache(),
        "texts": {r[0]: r[1] for r in rows},
        "benchmark": spark.createDataFrame([(1, passage), (2, "x y"), (3, None), (4, "")], "item_id long, text string"),
        "labels": spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(220)], "doc_id long, quality int, toxic int"),
        "toxic": toxic,
    }


AWKWARD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", None, 3), (None, "null id here", "en", "a", 1),
    (4, "same text " * 40, "en", "a", 9), (4, "same text " * 40, "en", "a", 9), (5, "same text " * 40, None, "b", 9),
    (4, "other text under an id that repeats", "en", "a", 1), (6, "Ein Wort\n" * 20000, "de", "b", 5),
    (7, "日本語 ÀÉ <|endoftext|> \x1c x", "en", "a", 7), (8, "x" * 50000, "en", "a", 8),
]


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, blanks, ties, repeats, very long texts; extra columns whose names operators use themselves."""
    extra = ", score string, n string, cid string, bands string, place string, part string, line string, size string, _text string"
    return spark.createDataFrame([(*r, *"abcdefghi") for r in AWKWARD], DOCS + extra)


def operators(spark, benchmark, labels):
    return {
        "counts": lambda d: token_counts.counts_after_cleaning(d, token_counts.Rollup(spark, shared_folder(spark, "t"))),
        "contamination": lambda d: decontaminate.contamination(d, benchmark),
        "pack": packing.pack,
        "shard": sharding.shard,
        "language": language_id.language_id,
        "toxicity": lambda d: toxicity.toxicity(d, labels),
        "lines": line_dedup.line_dedup,
        "without": line_dedup.without_repeats,
        "near": near_duplicates.near_duplicates,
        "quality": quality_rules.judged,
    }


@pytest.mark.parametrize("name", ["counts", "contamination", "pack", "shard", "language", "toxicity", "lines", "near", "quality"])
def test_awkward_and_empty_tables(spark, sample, awkward, name):
    run = operators(spark, sample["benchmark"], sample["labels"])[name]
    got = run(awkward).collect()
    if name == "pack":
        assert sum(r["length"] for r in got if r["start"] == 0) and {r["doc_id"] for r in got} == {r[0] for r in AWKWARD}
    elif name == "counts":
        assert sum(r["n_docs"] for r in got) == len({r[1] or "" for r in AWKWARD})
    else:
        assert len(got) == len(AWKWARD)
    assert run(awkward.limit(0)).collect() == []


def test_token_counts(spark, sample):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rollup = token_counts.Rollup(spark, shared_folder(spark, "rollup"))
    counts = token_counts.counted(sample["docs"])
    expected = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) for i, t in sample["texts"].items()}
    assert {r["doc_id"]: r["n_tokens"] for r in counts.collect()} == expected
    assert rollup.commit("a", token_counts.signed(counts, 1))
    assert not rollup.commit("a", token_counts.signed(counts, 1))
    assert rollup.commit("b", token_counts.signed(counts.where("doc_id < 100"), -1))
    assert sum(r["n_tokens"] for r in rollup.totals().collect()) == sum(n for i, n in expected.items() if i >= 100)
    assert rollup.commit("c", token_counts.signed(counts.where("doc_id >= 100"), -1)) and rollup.totals().collect() == []


def test_commits_do_not_depend_on_success_markers_and_totals_are_kept(spark):
    rows = spark.createDataFrame([("s", "en", "t", 1, 10, 100), (None, None, "t", 1, 5, 50)], "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint, n_bytes bigint")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    rollup = token_counts.Rollup(spark, shared_folder(spark, "rollup"))
    conf.set("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    try:
        assert rollup.commit("a", rows) and not rollup.commit("a", rows) and rollup.committed("a")
    finally:
        conf.unset("mapreduce.fileoutputcommitter.marksuccessfuljobs")
    rows.write.parquet(rollup._folder("died"))  # an attempt that was never recorded
    assert sorted(map(tuple, rollup.totals().collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    rollup.compact()
    rollup.compact()
    assert rollup.commit("b", token_counts.signed(rows.where("source = 's'"), -1)) and not rollup.commit("a", rows)
    assert len(rollup.totals().inputFiles()) > 0 and not any("batch=a" in f for f in rollup.totals().inputFiles())
    assert [tuple(r) for r in rollup.totals().collect()] == [(None, None, "t", 1, 5, 50)]
    rollup.compact()
    assert [tuple(r) for r in rollup.totals().collect()] == [(None, None, "t", 1, 5, 50)]
    assert not any("batch=" in f for f in rollup.totals().inputFiles())


def test_the_life_of_a_corpus_equals_plain_counts(spark):
    """The query's groups against counting each kept document once."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = token_counts.counts_after_cleaning(docs, token_counts.Rollup(spark, shared_folder(spark, "rollup")))
    kept, want = {}, collections.Counter()
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        kept.setdefault("\n".join(dict.fromkeys((r.text or "").split("\n"))), r)
    for folded, r in kept.items():
        for k, n in enumerate((1, len(tokenizer.encode(folded, add_special_tokens=False).ids), len(folded.encode()))):
            want[r.source, r.lang, k] += n
    got = {(r.source, r.lang, k): n for r in found.collect() for k, n in enumerate((r.n_docs, r.n_tokens, r.n_bytes))}
    assert got == dict(want)


def test_decontamination(sample):
    items = {1: None, 2: None}
    for r in sample["benchmark"].collect():
        items[r["item_id"]] = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(r["text"]))
    for r in decontaminate.contamination(sample["docs"], sample["benchmark"]).collect():
        text = sample["texts"][r["doc_id"]]
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
        hit, found = set(), set()
        for item, w in items.items():
            n = min(10, len(w))
            for k in range(len(w) - n + 1 if w else 0):
                for at in range(len(words) - n + 1):
                    if words[at : at + n] == w[k : k + n]:
                        hit |= set(range(at, at + n))
                        found.add(str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) == (len(words), len(hit), len(found), digest)
        for span in r["byte_ranges"]:
            cut = text.encode()[span["first"] : span["end"]].decode()
            assert lowered(cut).split()[0] in items[1] and not cut.endswith("!")


def test_packing(sample):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = packing.pack(sample["docs"], length=256).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in sample["texts"].items():
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert zlib.crc32(np.array(ids[r["start"] : at], "<u4").tobytes()) == r["ids_crc32"]
        assert at == len(ids)
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 256
    assert sum(sum(n for _, n in h) < 256 for h in sequences.values()) == 1  # one range, one padded sequence


def test_hilbert_neighbours():
    grid = np.array([(x, y) for x in range(16) for y in range(16)])
    key = packing.hilbert(grid, 4)
    assert sorted(key) == list(range(256))
    path = grid[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_sharding(spark, sample):
    rows = sharding.shard(sample["docs"], shards=7, virtual_nodes=16).collect()
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        text = sample["texts"][r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(text) + 8, zlib.crc32(text))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and len(slots) == 7


def test_hot_keys_are_ranked_in_parts(spark, monkeypatch):
    """A third of the rows has a null id and one text, a tenth one id; every slot is still taken once."""
    monkeypatch.setattr(sharding, "LEAST_PART", 50)
    monkeypatch.setattr(sharding, "HOT_ARC", 4)
    ids = [*[None] * 1000, *[7] * 300, *range(100, 1800)]
    docs = spark.createDataFrame([(i, "same" if i is None else str(i)) for i in ids], "doc_id long, text string")
    found = sharding.shard(docs.repartition(5), shards=5, virtual_nodes=16)
    rows = found.collect()
    assert collections.Counter(r["doc_id"] for r in rows) == collections.Counter(ids)
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(600)) for s in slots.values()) and len(slots) == 5


def test_a_new_shard_moves_few_keys(spark):
    """Law rows has no slack, so some keys also move between old shards; few do."""
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    before, after = ({r["doc_id"]: r["shard"] for r in sharding.shard(docs, shards=n).collect()} for n in (24, 25))
    moved = sum(before[i] != after[i] for i in before)
    between_old = sum(before[i] != after[i] != 24 for i in before)
    assert moved < 0.08 * len(before) and between_old < 0.04 * len(before)


def test_ring_walk_keeps_keys_at_their_own_shard_while_it_has_room():
    points = sharding.ring(3, 4)
    segments = sharding.walk({0: 5, 3: 100, 7: 6}, points, 3)
    assert sum(end - first for _, first, end, _, _ in segments) == 111
    assert segments[0][:3] == (0, 0, 5) and segments[0][3] == points[0][1]


def test_language_id(sample):
    rows = language_id.language_id(sample["docs"]).collect()
    truth = {r["doc_id"]: r["lang"] for r in sample["docs"].collect()}
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 30 and all(r["lang_pred"] == truth[r["doc_id"]] for r in held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)


def test_forward_algorithm_sums_all_segmentations():
    vocabulary = language_id.vocabulary()
    p = language_id._probabilities(np.random.default_rng(1).random((len(vocabulary.pieces), 2)))
    known = {piece: i for i, piece in enumerate(vocabulary.pieces)}

    def every(word):
        if not word:
            return np.ones(2)
        total = np.zeros(2)
        for n in range(1, len(word) + 1):
            piece = known.get(word[:n], len(known) if n == 1 else None)
            if piece is not None:
                total = total + p[piece] * every(word[n:])
        return total

    some = ["the", "wörter", "zzq☃", "another"]
    marked = language_id.spoken(some)
    assert np.allclose(language_id.log_totals(vocabulary, marked, p), np.log([every(w) for w in marked]), rtol=1e-9)


def test_long_words_are_scored_whole(monkeypatch):
    """Sums and expected pieces of words of any length, against plain sums in whole fractions."""
    vocabulary = language_id.vocabulary()
    p = language_id._probabilities(np.random.default_rng(2).random((len(vocabulary.pieces), 2)) ** 8 * 1000)
    known = {piece: i for i, piece in enumerate(vocabulary.pieces)}
    exact = [[Fraction(x) for x in row] for row in p]
    some = language_id.spoken(["the", "internationalization" * 3, "ज्ञान☃" * 12, "x" * 70, "another"])

    def places(word):
        for i in range(len(word)):
            for n in range(1, min(vocabulary.longest, len(word) - i) + 1):
                piece = known.get(word[i : i + n], len(known) if n == 1 else None)
                if piece is not None:
                    yield i, i + n, piece

    expected, logs = np.zeros_like(p), []
    for word in some:
        logs.append([])
        for lang in range(2):
            before, after = [Fraction(int(i == 0)) for i in range(len(word) + 1)], [Fraction(int(i == len(word))) for i in range(len(word) + 1)]
            arcs = list(places(word))
            for i, j, piece in arcs:
                before[j] += before[i] * exact[piece][lang]
            for i, j, piece in reversed(arcs):
                after[i] += after[j] * exact[piece][lang]
            for i, j, piece in arcs:
                expected[piece, lang] += 3 * float(before[i] * exact[piece][lang] * after[j] / before[-1])
            logs[-1].append(math.log(before[-1].numerator) - math.log(before[-1].denominator))
    assert min(map(min, logs)) < -500
    got = language_id.Lattice(vocabulary, some)
    assert np.allclose(got.log_totals(p), logs, rtol=1e-9)
    assert np.allclose(got.expected(p, np.full((len(some), 2), 3.0)), expected, rtol=1e-9, atol=1e-12)
    monkeypatch.setattr(language_id, "_STRETCH", 24)
    monkeypatch.setattr(language_id, "_CELLS", 1)
    assert np.allclose(language_id.log_totals(vocabulary, some, p), logs, rtol=1e-9)
    endless = language_id.log_totals(vocabulary, ["▁" + "word" * 20_000], p)
    assert np.isfinite(endless).all() and (endless < -10_000).all()


def test_toxicity(sample):
    rows = toxicity.toxicity(sample["docs"].where("doc_id < 220"), sample["labels"]).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(r["predicted"] == int(r["doc_id"] in sample["toxic"]) == int(r["score"] >= 0.5) for r in rows if r["held_out"])


def test_line_dedup(sample):
    order = [(i, k, frozenset(white_words(lowered(l)))) for i, t in sorted(sample["texts"].items()) for k, l in enumerate(t.split("\n"))]
    order = [x for x in order if len(x[2]) >= 5]
    gone, links = collections.defaultdict(set), collections.Counter()
    for at, (i, k, s) in enumerate(order):
        similar = [(p, u) for p, (_, _, u) in enumerate(order) if 100 * len(s & u) >= 80 * len(s | u)]
        if any(p < at for p, _ in similar):
            gone[i].add(k)
        links[i] += len({u for _, u in similar if u != s})
    for r in line_dedup.line_dedup(sample["docs"]).collect():
        assert (set(r["removed_lines"]), r["n_links"]) == (gone[r["doc_id"]], links[r["doc_id"]])
    kept = {r["doc_id"]: r["text"] for r in line_dedup.without_repeats(sample["docs"]).collect()}
    for i, text in sample["texts"].items():
        left = [l for k, l in enumerate(text.split("\n")) if k not in gone[i]]
        assert kept.get(i, "") == "\n".join(left)


def test_short_lines_are_compared_too(spark):
    """Copies and near copies of lines of any length, against brute force over every line with a word."""
    rng = np.random.default_rng(8)
    vocabulary = ["".join(rng.choice(list("aeiostrn"), 4)) for _ in range(9)]
    texts = {i: "\n".join(" ".join(rng.choice(vocabulary, rng.integers(0, 7))) for _ in range(6)) for i in range(60)}
    texts |= {60: "All rights reserved.\nx\n日本語日本語", 61: "日本語日本語\n\nall RIGHTS reserved.", 62: "ha " * 300, 63: "Ha"}
    order = [(i, k, frozenset(white_words(lowered(l)))) for i, t in texts.items() for k, l in enumerate(t.split("\n"))]
    order = [x for x in order if x[2]]
    for percent in (80, 60):
        gone, links = collections.defaultdict(set), collections.Counter()
        for at, (i, k, s) in enumerate(order):
            similar = [(p, u) for p, (_, _, u) in enumerate(order) if 100 * len(s & u) >= percent * len(s | u)]
            if any(p < at for p, _ in similar):
                gone[i].add(k)
            links[i] += len({u for _, u in similar if u != s})
        docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        rows = line_dedup.line_dedup(docs, how=line_dedup.Similarity(percent=percent)).collect()
        assert {r[0]: (set(r["removed_lines"]), r["n_links"]) for r in rows} == {i: (gone[i], links[i]) for i in texts}
        assert gone[61] == {0, 2} and gone[63] == {0}


def test_lines_meet_in_small_blocks_as_well(sample):
    small = line_dedup.line_dedup(sample["docs"], how=line_dedup.Similarity(block=4)).collect()
    assert sorted(small) == sorted(line_dedup.line_dedup(sample["docs"]).collect()) and any(r["n_links"] for r in small)


def test_line_classes_are_counted_once_and_slices_copied_alone(sample):
    """Who reads the classes must not group all lines again; a slice of a batch must not be translated with its whole batch."""
    found = line_dedup.similar_lines(sample["docs"])
    plan = found.classes._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation" in plan and "Aggregate" not in plan and found.classes.agg({"copies": "sum"}).first()[0] == found.lines.count()
    texts = pa.array(["Ab\tC", None, "É\nZ", "x" * 100_000])
    part = translated(texts.slice(0, 3), WHITE)
    part.validate(full=True)
    assert part.to_pylist() == ["ab c", "", "É z"] and part.buffers()[2].size == len("Ab\tCÉ\nZ".encode())
    assert translated(texts.slice(2, 1), WHITE).to_pylist() == ["É z"] and translated(texts.slice(1, 1), WHITE).to_pylist() == [""]


@pytest.mark.parametrize("block", [2048, 4])
def test_line_groups_travel_packed(sample, block):
    """Every prefix token is a group row once, whole groups in one bucket, many rows in one long value."""
    how = line_dedup.Similarity(block=block)
    level = sample["docs"].sparkSession.sparkContext.broadcast(line_dedup.rarity(sample["docs"], "text", how))
    lines = line_dedup.occurrences(sample["docs"], "doc_id", "text", level, how).cache()
    tokens = collections.Counter(t for r in lines.collect() for t in [*np.frombuffer(r["few"], np.int64).tolist(), *r["often"]])
    packs = line_dedup._groups(lines, how, 100 * line_dedup.BUCKET_ROWS).withColumn("at", F.spark_partition_id()).collect()
    held = [(p["bucket"], p["at"], row) for p in packs for row in np.frombuffer(p["rows"], np.int64).reshape(-1, 7).tolist()]
    uncut = collections.Counter(row[0] for _, _, row in held if row[1] == 0)
    cut = {row[0] for _, _, row in held if row[1]}
    assert all(uncut[t] == tokens[t] for t in tokens if t not in cut) and set(uncut) | cut == set(tokens) and bool(cut) == (block == 4)
    assert len({(row[0], row[1]) for _, _, row in held}) == len({(b, at, row[0], row[1]) for b, at, row in held})
    assert len({b for b, _, _ in held}) > 50 and 2 * len(packs) < len(held)


def test_words_are_hashed_where_they_stand():
    texts = ["Ab\tC  ab", None, "", "É\nz ab", "ab", " ", "日本語" * 9 + " x" * 3, "y" * 64 + " " + "y" * 65, "y" * 65 + "\x0by" * 2, "abcdefgh abcdefg abcdefgh\0"]
    for first in (0, 3, 7):
        at = placed(pa.array(texts).slice(first), WHITE_IN_LINES)
        words = [w for t in texts[first:] for w in white_words(lowered(t or ""))]
        found = [at.bytes[a : a + n].tobytes().decode() for a, n in zip(at.starts, at.lengths)]
        hashes = hashed_at(at.bytes, at.starts, at.lengths).tolist()
        assert found == words and len(set(zip(words, hashes))) == len(set(words)) == len(set(hashes))
    nothing = placed(pa.array([None, ""], pa.string()), WHITE)
    assert not len(nothing.starts) and not len(hashed_at(nothing.bytes, nothing.starts, nothing.lengths))


def test_near_duplicates(sample):
    sets = {}
    for i, t in sample["texts"].items():
        w = white_words(lowered(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    root = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
    rows = near_duplicates.near_duplicates(sample["docs"]).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows} == {
        i: (len(s), root[i], root[i] == i) for i, s in sets.items()
    }


def test_repeated_lines_under_null_and_repeated_keys(spark):
    """The same first line in documents that share a key: of different texts one keeps it, wherever it stands."""
    head = "one header line of seven words here"
    rows = [(k, f"{head}\nbody {k} {n} alpha beta gamma {k}x{n}") for k in (None, 4) for n in range(4)]
    for times in (1, 2):  # rows equal in key and text are one document, however often they stand there
        docs = spark.createDataFrame(rows * times, "doc_id long, text string")
        left = [r["doc_id"] for r in line_dedup.without_repeats(docs).collect() if head in r["text"].split("\n")]
        assert left == [None] * times
        removed = [r["removed_lines"] for r in line_dedup.line_dedup(docs).collect()]
        assert sorted(removed) == [[]] * times + [[0]] * 7 * times


def test_near_duplicates_under_null_and_repeated_keys(spark):
    rng = np.random.default_rng(11)
    texts = [" ".join(f"w{n}" for n in rng.integers(0, 10**6, 300)) for _ in range(6)]
    edited = [t.replace(t.split()[150], f"changed{k}") for k, t in enumerate(texts)]
    rows = [
        (1, texts[0]), (None, edited[0]), (None, texts[0]),  # copies of a named document
        (None, texts[1]), (None, edited[1]), (None, texts[1]),  # no one has a name
        (4, texts[2]), (4, texts[3]), (3, edited[3]),  # an id with two texts, one of them a copy
        (5, texts[4]), (5, edited[4]), (5, texts[4]), (None, None), (None, ""), (None, texts[5]),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_duplicates.near_duplicates(docs).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in found) == sorted(
        [("1", "1"), ("3", "3"), ("4", "3"), ("4", "4"), *[("5", "5")] * 3, *[("None", "1")] * 2, *[("None", "None")] * 6]
    )
    left = [(r["doc_id"], r["text"]) for r in near_duplicates.kept_documents(docs).collect()]
    unnamed = [x for x in left if x[1] in (texts[1], edited[1])]
    repeated = [x for x in left if x[0] == 5]
    assert len(unnamed) == 1 and len(repeated) == 1
    rest = [x for x in left if x not in unnamed and x not in repeated]
    assert sorted(rest, key=str) == sorted([(1, texts[0]), (4, texts[2]), (3, edited[3]), (None, None), (None, ""), (None, texts[5])], key=str)


def test_second_round_finds_a_chain(spark):
    """A chain in which no member is like all others: every link must be found, wherever the centres fall."""
    base = [f"w{i}" for i in range(200)]
    texts = []
    for step in range(12):
        texts.append(" ".join(base))
        base = base[:]
        for k in range(2):
            base[(step * 17 + k * 5) % 200] = f"n{step}_{k}"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["component_id"] for r in near_duplicates.near_duplicates(docs).collect()} == {0}


def test_quality_rules(sample, awkward):
    """Base measures of every row, those of the awkward table too, by value."""

    def measured(key, text):
        w = white_words(text)
        seen, covered = collections.defaultdict(list), set()
        for i in range(len(w) - 2):
            seen[tuple(w[i : i + 3])].append(i)
        for at in seen.values():
            covered |= {i + k for i in at for k in range(3) if len(at) > 1}
        lines = [x for x in (text or "").split("\n") if white_words(x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        return key, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed

    for docs in (awkward, sample["docs"]):
        found = quality_rules.judged(docs).collect()
        assert collections.Counter(tuple(r[:7]) for r in found) == collections.Counter(measured(r["doc_id"], r["text"]) for r in docs.collect())
        assert all(not r["kept"] or not r["base_failed"] and 2 * r["n_lost_words"] <= r["n_words"] for r in found)


@pytest.mark.parametrize("line", ["यह {} एक छोटा वाक्य है।", "هل هذا {} سؤال قصير؟", "这 是 {} 一个 短 句子。", "это {} короткое предложение.", "dies ist {} „ein Satz“"])
def test_short_sentences_of_any_script_are_prose(spark, line):
    prose, menu = ("\n".join(x.format(f"w{i}") for i in range(30)) for x in (line, line[:-1]))
    docs = spark.createDataFrame([(1, prose), (2, menu)], "doc_id long, text string")
    found = {r["doc_id"]: (r["n_lost_words"], r["n_words"]) for r in quality_rules.judged(docs).collect()}
    assert found[1][0] == 0 and found[2][0] == found[2][1]


def test_scripts_without_spaces_are_measured_by_letters(spark):
    """Words are what spaces separate, here half a sentence; Thai sets no sentence ends."""
    text = "\n".join(f"นี่คือประโยคที่ค่อนข้างยาวในภาษาไทย ซึ่งไม่มีจุดจบของประโยค {i}" for i in range(30))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [(r["kept"], r["n_lost_words"]) for r in quality_rules.judged(docs).collect()] == [(True, 0)]


def test_quality_rules_drop_pages_of_menus_and_shouts(spark):
    menu = "\n".join("Home | News | Sport | Contact | About | Help" for _ in range(12))
    shout = "\n".join(" ".join(f"WORD{i}{j}!!" for j in range(12)) for i in range(8))
    prose = "\n".join(" ".join(f"word{i}{j}" for j in range(12)) + "." for i in range(8))
    docs = spark.createDataFrame([(1, menu), (2, shout), (3, prose)], "doc_id long, text string")
    assert {r["doc_id"]: r["kept"] for r in quality_rules.judged(docs).collect()} == {1: False, 2: False, 3: True}


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "PART", 7)
    monkeypatch.setattr(warc, "BLOCK", 3)
    pages = [(i, f"https://www.Site{i % 4}.example.org/p/{i % 6}?q={i}", f"<p>{i % 5}</p>") for i in range(60)]
    pages += [(90, None, None), (91, "", ""), (92, "http://[bad", "ü" * 100_000)]
    rows = {r["page_id"]: r for r in warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    last = {}
    for i, _, html in pages:
        last[html or ""] = max(i, last.get(html or "", -1))
    assert set(rows) == {p[0] for p in pages}
    for i, _, html in pages:
        body, winner = (html or "").encode(), last[html or ""]
        digest = __import__("base64").b32encode(hashlib.sha1(body).digest()).decode()
        expected = (len(body), digest, "response" if winner == i else "revisit", None if winner == i else winner)
        assert tuple(rows[i])[1:] == expected
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(empty).collect() == []


def test_warc_returns_each_row_under_null_and_repeated_pages(spark, monkeypatch):
    monkeypatch.setattr(warc, "PART", 7)
    monkeypatch.setattr(warc, "BLOCK", 3)
    url = "https://a.example/x"
    pages = [(None, url, f"<p>{'n' * k}</p>") for k in range(12)] + [(None, None, "u" * k) for k in range(1, 6)]
    pages += [(7, url, f"<p>{'r' * k}</p>") for k in range(5)] + [(7, url, "<p></p>"), (-1, url, "<p>nn</p>"), (9, None, None)]
    rows = warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    last = collections.defaultdict(list)
    for i, _, html in pages:
        last[html or ""] += [] if i is None else [i]
    expected = []
    for i, _, html in pages:
        body, winner = (html or "").encode(), max(last[html or ""], default=None)
        digest = __import__("base64").b32encode(hashlib.sha1(body).digest()).decode()
        first = winner in (None, i)
        expected.append((i, len(body), digest, *(("response", None) if first else ("revisit", winner))))
    assert sorted(map(tuple, rows), key=str) == sorted(expected, key=str)


def test_inner_names_do_not_clash(spark):
    """Documents come back unchanged, with columns named as the operators' own ones."""
    line = " ".join(f"word{k}" for k in range(12))
    rows = [(1, f"{line}\nfirst one", "a", "b", "c", "d"), (2, f"{line}\nsecond one", "e", "f", "g", "h"), (None, "third", "i", "j", "k", "l")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, _key string, _hash string, _removed string, _own string")
    cut = sorted(map(tuple, line_dedup.without_repeats(docs).collect()), key=str)
    assert cut == sorted([rows[0], (2, "second one", *rows[1][2:]), rows[2]], key=str)
    docs = docs.withColumnRenamed("_removed", "_repeats")
    assert sorted(map(tuple, near_duplicates.kept_documents(docs).collect()), key=str) == sorted(rows, key=str)


def test_kept_follows_the_key_in_the_query(spark, monkeypatch):
    words = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join(words)), (1, " ".join([*words, "edited"])), (2, " ".join(words)), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    found = sorted(tuple(r) for r in queries.op9_near_duplicates(spark, "").collect())
    assert found == [(1, 56, 1, True), (1, 57, 1, True), (2, 56, 1, False), (3, 0, 3, True)]


def test_url_keys():
    assert warc.url_key("https://www.Example.co.uk/a?b=1") == "uk,co,example)/a?b=1"
    assert warc.url_key(None) == ")/"
