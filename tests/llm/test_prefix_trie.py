"""The prefix trie against a walk over all prefixes in memory."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import pytest

from terrace.llm import prefix_trie, queries

WORDS = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(sequences: dict[int, list[tuple[str, str]]]) -> list[tuple]:
    members, below = defaultdict(list), defaultdict(set)
    for key, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(key)
            if d:
                below[tuple(turns[: d - 1])].add(tuple(turns[:d]))
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(WORDS.findall(node[-1][1])) if node else 0
        saved[node] = own + sum(saved[x] for x in below[node])
        leaves[node] = sum(leaves[x] for x in below[node]) or 1
    out = []
    for node, keys in members.items():
        ended = ",".join(str(k) for k in sorted(k for k in keys if len(sequences[k]) == len(node)))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(keys), len(node), parent, len(keys), len(below[node]), leaves[node], saved[node], hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out, key=str)


def ordered(rows) -> dict[int, list[tuple[str, str]]]:
    out = defaultdict(list)
    for key, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        if key is not None:
            out[key].append((role or "", text or ""))
    return dict(out)


def with_heads(sequences):
    out = {}
    for key, own in sequences.items():
        h = zlib.crc32(str(key).encode()) % 4
        out[key] = sequences.get(key - key % 20, [])[:h] + own[h:]
    return out


def result(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=str)


AWKWARD = [
    *[(k, t, "user", f"same {t}") for k in range(100, 400) for t in range(3)],  # copies
    *[(k, t, "user", f"step {t}") for k in range(400, 430) for t in range(k - 399)],  # each ends one turn after the last
    *[(500, t, "bot", "long " * (t % 5)) for t in range(900)],
    *[(501, t, "bot", "long " * (t % 5)) for t in range(900)],
    (600, None, None, None), (600, 0, None, "null first"), (601, 0, "", ""), (602, 1, "a", "bc"), (603, 1, "ab", "c"),
    (604, -1, "user", "same 0"), (605, 7, "user", "x" * 300_000), (None, 0, "user", "nobody's"), (None, 1, "user", "nobody's"),
]


@pytest.mark.parametrize("heads", [False, True])
def test_awkward_conversations(spark, heads):
    turns = spark.createDataFrame([(*r, 1) for r in AWKWARD], f"{SCHEMA}, depth int")  # a clashing name as well
    sequences = ordered(AWKWARD)
    if heads:
        found = prefix_trie.prefix_trie(queries.with_shared_heads(turns))
        sequences = with_heads(sequences)
    else:
        found = prefix_trie.prefix_trie(prefix_trie.digested(turns))
    assert result(found) == brute(sequences)


def test_turnless_alone_and_empty(spark):
    kind = "conv_id bigint, turns array<struct<digest:binary,words:bigint>>"
    assert result(prefix_trie.prefix_trie(spark.createDataFrame([], kind))) == []
    assert result(prefix_trie.prefix_trie(spark.createDataFrame([(7, []), (3, None)], kind))) == brute({7: [], 3: []})
    assert result(prefix_trie.prefix_trie(spark.createDataFrame([(3, [(b"x", 2), (b"y", 1)])], kind))) == brute({3: [("", "a b"), ("", "c")]})


def test_equal_turns_in_any_order_of_rows(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (2, 0, "user", "a"), (2, 0, "user", "b")]
    found = prefix_trie.prefix_trie(prefix_trie.digested(spark.createDataFrame(rows, SCHEMA))).collect()
    assert sorted((r.conv_id, r.depth, r.n_convs) for r in found) == [(1, 0, 2), (1, 1, 2), (1, 2, 2)]


def test_keys_of_one_end_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 50)
    members = spark.range(0, 30_000, 1, 7).selectExpr("cast(if(id % 3 = 0, 'hot', string(id % 7)) as binary) as end", "id * 977 % 30011 as key")
    want = defaultdict(list)
    for row in members.collect():
        want[bytes(row.end)].append(row.key)
    got = {bytes(r.end): r.sha for r in prefix_trie.ends(members).collect()}
    assert got == {end: hashlib.sha256(",".join(map(str, sorted(keys))).encode()).hexdigest() for end, keys in want.items()}


def test_whole_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(queries.op13_prefix_trie(spark, sf_dir)) == brute(with_heads(ordered(rows)))
