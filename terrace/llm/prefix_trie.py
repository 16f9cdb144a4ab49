"""Prefix trie of conversations by truncation peeling: from the greatest depth up, last turns are stripped and what then
agrees is merged with the conversations that end there.

A row stands for a node: its members' number and least key, and what its subtree sums up to. Peeling strips its last turn
and regroups, which finds the node above and its sums in one aggregation. Turns on which nothing meets need no regrouping:
between two depths at which a sequence meets another one, all nodes have the same members, so that stretch of turns is
stripped at once and kept as one row (a stretch). Rounds are therefore one for each depth at which anything meets, not one for
each turn of the longest conversation. A round reads only the rows that meet at its depth.

1. Turns become digests of 128 bits, conversations arrays of them; texts are not moved again.
2. Equal conversations become one row, with a digest of each prefix and the words up to it.
3. A prefix that goes on in more than one way (or ends in one conversation and goes on in another) is a meeting; a minimum
   and a maximum of what follows it tell, so a first turn that a third of all conversations share sends a row a task.
4. The rounds: group by meeting, sum, strip down to the next meeting. Sums combine ahead of the shuffle.
5. Stretches are joined with the meeting above them, for its least key, and unfolded into nodes.

Keys of equal conversations are hashed in order: ranges of (end, key) are written as joined text in pieces of bounded size,
and the pieces of one end stream through its hash. SHA-256 has no parts, so this last step is one stream for each end.
"""

from __future__ import annotations

import hashlib


import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.llm.shared import map_arrow, shared_folder, stored

#: Characters of joined keys in one row.
PIECE = 1 << 16
ROOT = b""
NO_ENDS = hashlib.sha256(b"").hexdigest()

_MARKS = "array<struct<depth:int,node:binary>>"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def digested(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """key and its turns (array of digest and words), ordered by ``turn``, null first, and by the digest where that ties.

    A null role or text counts as empty. Turns without a key belong to no conversation. A conversation's digests (some 30 bytes
    a turn, never its texts) are in one row."""
    said, spoken = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    content = F.concat(F.length(said).cast("string"), F.lit(":"), said, spoken)
    rows = turns.where(F.col(key).isNotNull()).select(
        F.col(key).alias("key"), F.struct(F.col(turn).alias("at"), F.unhex(F.left(F.sha2(content, 256), F.lit(32))).alias("digest"), word_count(spoken).alias("words")).alias("turn")
    )
    grouped = rows.groupBy("key").agg(F.sort_array(F.collect_list("turn")).alias("turns"))  # one conversation's
    return grouped.select(F.col("key").alias(key), F.transform("turns", lambda t: F.struct(t["digest"], t["words"])).alias("turns"))


def _prefixes(conversations: DataFrame, key: str) -> DataFrame:
    """key, path (digest of each prefix, from one turn on) and upto (words of the first 0, 1, ... turns)."""

    def chain(batches):
        for batch in batches:
            paths, upto = [], []
            for turns in batch.column("turns").to_pylist():
                last, total, path, sums = ROOT, 0, [], [0]
                for turn in turns or []:
                    last = hashlib.blake2b(last + turn["digest"], digest_size=16).digest()
                    total += turn["words"]
                    path.append(last)
                    sums.append(total)
                paths.append(path)
                upto.append(sums)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(paths, pa.list_(pa.binary())), pa.array(upto, pa.list_(pa.int64()))], names=["key", "path", "upto"]
            )

    return map_arrow(conversations.select(F.col(key).cast("bigint").alias("key"), "turns"), chain, "key bigint, path array<binary>, upto array<bigint>")


def _end(path: str = "path") -> Column:
    return F.coalesce(F.try_element_at(path, F.lit(-1)), F.lit(ROOT))


def ends(members: DataFrame) -> DataFrame:
    """end, sha of the ascending keys, comma-joined, of every end in ``members`` (end, key)."""

    def join(batches):
        held: list[str] = []
        size, first, end = 0, None, None
        out: list[tuple] = []

        def close():
            if held:
                out.append((end, first, ",".join(held)))

        for batch in batches:
            for own, key in zip(batch.column("end").to_pylist(), batch.column("key").to_pylist()):
                if own != end or size >= PIECE:
                    close()
                    held, size, first, end = [], 0, key, own
                held.append(str(key))
                size += len(held[-1]) + 1
            if out:
                yield _rows(out, ("end", "first", "piece"))
                out = []
        close()
        if out:
            yield _rows(out, ("end", "first", "piece"))

    def hash_in_order(batches):
        end, state = None, None
        for batch in batches:
            out = []
            for own, piece in zip(batch.column("end").to_pylist(), batch.column("piece").to_pylist()):
                if own != end:
                    if state:
                        out.append((end, state.hexdigest()))
                    end, state = own, hashlib.sha256(piece.encode())
                else:
                    state.update(b"," + piece.encode())
            if out:
                yield _rows(out, ("end", "sha"))
        if state:
            yield _rows([(end, state.hexdigest())], ("end", "sha"))

    ranged = members.select("end", "key").repartitionByRange("end", "key").sortWithinPartitions("end", "key")
    pieces = map_arrow(ranged, join, "end binary, first bigint, piece string")
    return map_arrow(pieces.repartition("end").sortWithinPartitions("end", "first").select("end", "piece"), hash_in_order, "end binary, sha string")


def _rows(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    kinds = {"end": pa.binary(), "first": pa.int64(), "piece": pa.string(), "sha": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[n]) for n, c in zip(names, zip(*rows))], names=list(names))


def _classes(conversations: DataFrame, key: str) -> DataFrame:
    """A row for each distinct sequence: end, path, upto, n, least and sha (of its members' keys)."""
    found = stored(_prefixes(conversations, key).withColumn("end", _end()), "trie-paths")
    classes = found.groupBy("end").agg(F.count("*").alias("n"), F.min("key").alias("least"), F.first("path").alias("path"), F.first("upto").alias("upto"))
    classes = stored(classes, "trie-classes")
    several = found.select("end", "key").join(classes.where("n > 1").select("end"), "end", "left_semi")
    shas = stored(ends(several), "trie-ends")
    alone = F.sha2(F.col("least").cast("string"), 256)
    return stored(classes.join(shas, "end", "left").withColumn("sha", F.coalesce("sha", alone)), "trie-ended")


def _meetings(classes: DataFrame) -> DataFrame:
    """end, depth, node for every prefix of a class (but the root) at which it meets another class."""
    nodes = classes.select("end", "path", F.posexplode("path").alias("pos", "node"))
    follows = F.coalesce(F.get("path", F.col("pos") + 1), F.lit(ROOT))
    ways = [F.xxhash64(F.lit(seed), follows) for seed in (1, 2)]
    seen = nodes.select("node", *(w.alias(f"w{k}") for k, w in enumerate(ways)))
    seen = seen.groupBy("node").agg(*(f(f"w{k}").alias(f"{f.__name__}{k}") for k in (0, 1) for f in (F.min, F.max)))
    meetings = stored(seen.where("min0 <> max0 or min1 <> max1").select("node"), "trie-meetings")
    return nodes.select("end", (F.col("pos") + 1).alias("depth"), "node").join(meetings, "node", "left_semi")


class _Peeling:
    """Rows on their way up, kept in the shared folder by the depth of the meeting that each waits for."""

    ARRIVAL = f"node binary, n bigint, least bigint, children bigint, leaves bigint, saved bigint, sha string, upto array<bigint>, marks {_MARKS}"
    STRETCH = "above binary, top int, depth int, n bigint, least bigint, children bigint, leaves bigint, saved bigint, sha string, upto array<bigint>"

    def __init__(self, spark):
        self.spark, self.folder = spark, shared_folder(spark, "trie-peeling")

    def wait(self, rows: DataFrame, when: int | str) -> None:
        rows.write.partitionBy("meets").parquet(f"{self.folder}/arrivals/from={when}")

    def arrived(self, depth: int) -> DataFrame:
        read = self.spark.read.schema(f"{self.ARRIVAL}, meets int, from string")
        return read.parquet(f"{self.folder}/arrivals").where(F.col("meets") == depth)

    def strip(self, done: DataFrame, when: int | str) -> None:
        """Down to the next meeting: the turns between become a stretch, the row waits for that meeting."""
        done = stored(done, "trie-round")
        mark, left = F.col("marks")[0], F.size("marks") - 1
        upto = F.slice("upto", mark["depth"] + 1, F.col("depth") - mark["depth"])
        stretches = done.select(
            mark["node"].alias("above"), (mark["depth"] + 1).alias("top"), "depth", "n", "least", "children", "leaves", "saved", "sha", upto.alias("upto")
        )
        stretches.write.parquet(f"{self.folder}/stretches/from={when}")
        stripped = F.get("upto", F.col("depth") - 1) - F.get("upto", mark["depth"])
        up = done.select(
            mark["node"].alias("node"), "n", "least", F.lit(1).cast("long").alias("children"), "leaves",
            (F.col("saved") + (F.col("n") - 1) * stripped).alias("saved"), F.lit(None).cast("string").alias("sha"),
            F.slice("upto", F.lit(1), mark["depth"] + 1).alias("upto"), F.slice("marks", F.lit(2), left).alias("marks"), mark["depth"].alias("meets"),
        )
        self.wait(up, when)

    def merged(self, depth: int) -> DataFrame:
        """The nodes at which rows meet at ``depth``, whole."""
        sums = self.arrived(depth).groupBy("node").agg(
            F.sum("n").alias("n"), F.min("least").alias("least"), F.sum("children").alias("children"), F.sum("leaves").alias("leaves"),
            F.sum("saved").alias("saved"), F.max("sha").alias("sha"), F.first("upto").alias("upto"), F.first("marks").alias("marks"),
        )
        own = F.coalesce(F.get("upto", F.lit(depth)) - F.get("upto", F.lit(depth - 1)), F.lit(0)) if depth else F.lit(0)
        return sums.select(
            "node", F.lit(depth).alias("depth"), "n", "least", "children", F.greatest("leaves", F.lit(1)).alias("leaves"),
            (F.col("saved") + (F.col("n") - 1) * own).alias("saved"), F.coalesce("sha", F.lit(NO_ENDS)).alias("sha"), "upto", "marks",
        )

    def stretches(self) -> DataFrame:
        return self.spark.read.schema(f"{self.STRETCH}, from string").parquet(f"{self.folder}/stretches")


def prefix_trie(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """A row for each distinct sequence of first turns of ``conversations`` (an integer key, unique and not null, and turns: an
    array of digest and words, as :func:`digested` gives), the empty one included: key (the least member's), depth,
    parent_key, n_convs, n_children, n_leaves, saved_tokens and ends_sha256. A node is known by its key and depth.

    Null or empty turns end at the root. An empty table has no node at all. Equal conversations are members of one node, however many;
    a very long conversation is a path of its own. Other columns are ignored.
    """
    spark = conversations.sparkSession
    classes = _classes(conversations, key)
    if classes.isEmpty():
        return classes.select(*_named(key, F.lit(0), F.lit(None).cast("bigint"), "n", *["n"] * 3, "sha"))
    meetings = stored(_meetings(classes), "trie-marks")
    marks = meetings.groupBy("end").agg(F.collect_list(F.struct("depth", "node")).alias("marks"))  # of one sequence
    rooted = F.array(F.struct(F.lit(0).alias("depth"), F.lit(ROOT).alias("node")))
    marks_of = F.sort_array(F.concat(F.coalesce("marks", F.array().cast(_MARKS)), rooted), asc=False)
    rows = classes.join(marks, "end", "left").withColumn("marks", marks_of).withColumn("depth", F.size("path"))
    rows = stored(rows.drop("path"), "trie-marked")

    peeling = _Peeling(spark)
    meets = F.col("marks")[0]["depth"] == F.col("depth")
    none = F.lit(0).cast("long")
    peeling.wait(
        rows.where(meets).select(
            F.col("end").alias("node"), "n", "least", none.alias("children"), none.alias("leaves"), none.alias("saved"), "sha", "upto",
            F.slice("marks", F.lit(2), F.size("marks") - 1).alias("marks"), F.col("depth").alias("meets"),
        ), "ends",
    )
    last_words = F.get("upto", F.col("depth")) - F.get("upto", F.col("depth") - 1)
    leaves = rows.where(~meets).select(
        "depth", "n", "least", none.alias("children"), F.lit(1).cast("long").alias("leaves"), ((F.col("n") - 1) * last_words).alias("saved"), "sha", "upto", "marks"
    )
    peeling.strip(leaves, "leaves")

    depths = sorted((r["depth"] for r in meetings.select("depth").distinct().collect()), reverse=True)
    parents = []
    for depth in depths:
        nodes = stored(peeling.merged(depth), "trie-nodes")
        peeling.strip(nodes.drop("node"), depth)
        parents.append(nodes.select("node", F.col("least").alias("parent")))
    root = stored(peeling.merged(0), "trie-root")
    least = root.first()["least"]

    stretches = peeling.stretches()
    below = stretches.where("top > 1")
    known = stretches.where("top = 1").withColumn("parent", F.lit(least).cast("bigint"))
    for part in parents and [_united(parents)]:
        known = known.unionByName(below.join(part, below["above"] == part["node"]).drop("node"))
    nodes = known.select("*", F.posexplode("upto").alias("pos", "before"))
    at, bottom = F.col("top") + F.col("pos"), F.col("top") + F.col("pos") == F.col("depth")
    saved = F.col("saved") + (F.col("n") - 1) * (F.element_at("upto", -1) - F.col("before"))
    nodes = nodes.select(
        *_named(
            key, at, F.when(F.col("pos") == 0, F.col("parent")).otherwise(F.col("least")), "n",
            F.when(bottom, F.col("children")).otherwise(1), "leaves", saved, F.when(bottom, F.col("sha")).otherwise(NO_ENDS),
        )
    )
    return nodes.unionByName(root.select(*_named(key, F.lit(0), F.lit(None), "n", "children", "leaves", "saved", "sha")))


def _united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _named(key: str, depth, parent, n, children, leaves, saved, sha) -> list[Column]:
    given = {key: "least", "depth": depth, f"parent_{key}": parent, "n_convs": n, "n_children": children, "n_leaves": leaves, "saved_tokens": saved}
    columns = [(F.col(c) if isinstance(c, str) else c).cast("long").alias(name) for name, c in given.items()]
    return [*columns, (F.col(sha) if isinstance(sha, str) else sha).alias("ends_sha256")]
