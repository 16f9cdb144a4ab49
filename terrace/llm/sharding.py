"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

Every shard owns ``virtual_nodes`` points of a ring; a key belongs to the arc that starts at the last point
before its hash. An arc's keys go to the shard of its point until that shard is full; the others continue
clockwise to the next point. Capacities are floor or ceiling of rows / shards, so they sum to the rows: every
shard ends full and counts differ by one at most (law ``rows``).

Only the number of rows of each arc is needed to decide this, so the walk runs over a table of fixed size
(shards x virtual nodes), whatever the input. Rows are ranked inside their arc by (hash, id) and look up the
segment of ranks that they fall into. Keys are ids, not texts: copies of one text spread like all other rows.

An arc that far outgrows the others holds a key which many rows share (null ids, say). Its rows are dealt by lot into
parts, each part is ranked by itself, and the counts of the parts before it are added.
"""

from __future__ import annotations

import hashlib
import json
from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.llm.shared import stored

SHARDS = 24
VIRTUAL_NODES = 256
#: Rows of an arc, in arcs of average size and at least a number, from which on it is ranked in parts of as many.
HOT_ARC = 16
LEAST_PART = 10_000


def ring(shards: int = SHARDS, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node, clockwise. Positions are signed 64-bit numbers."""

    def at(shard: int, node: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{shard}/{node}".encode(), digest_size=8).digest(), "big", signed=True)

    return sorted((at(s, v), s) for s in range(shards) for v in range(virtual_nodes))


def arc_of(key: Column, points: list[tuple[int, int]]) -> Column:
    """Number of the last point at or before the key's hash; before the first point the ring closes."""
    positions = F.split(F.lit(",".join(str(p) for p, _ in points)), ",").cast("array<bigint>")
    steps = [1 << b for b in reversed(range(len(points).bit_length()))]
    passed = F.aggregate(  # binary search: how many points lie at or before the key
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda at, step: F.when(
            (at + step <= len(points)) & (F.get(positions, at + step - 1) <= key), at + step
        ).otherwise(at),
    )
    return F.when(passed == 0, len(points) - 1).otherwise(passed - 1)


def walk(counts: dict[int, int], points: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Where the ranks of each arc go: (arc, first rank, end rank, shard, slot of the first rank).

    All arcs hand their keys to their own point first; what a full shard refuses moves one point clockwise, as
    often as needed. ``counts`` has at most one entry for each point.
    """
    rows = sum(counts.values())
    room = [rows // shards + (s < rows % shards) for s in range(shards)]
    slot = [0] * shards
    segments = []
    waiting = deque((arc, arc, 0, n) for arc, n in sorted(counts.items()) if n)
    while waiting:
        arc, point, first, end = waiting.popleft()
        shard = points[point][1]
        taken = min(room[shard], end - first)
        if taken:
            segments.append((arc, first, first + taken, shard, slot[shard]))
            room[shard] -= taken
            slot[shard] += taken
        if first + taken < end:
            waiting.append((arc, (point + 1) % len(points), first + taken, end))
    return segments


def shard(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS,
          virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """``key``, size (UTF-8 bytes of the text plus 8), text_crc32, law, shard, slot, grown_shard of every row.

    Null text counts as empty; null keys hash alike and are ranked like ties; repeated rows are kept as rows
    of their own, whatever their number; an empty table gives an empty result; other columns are ignored.
    """
    points = ring(shards, virtual_nodes)
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = stored(
        df.select(
            F.col(key),
            (F.octet_length(body) + 8).cast("long").alias("size"),
            F.crc32(body).alias("text_crc32"),
            F.xxhash64(F.col(key)).alias("_place"),
            F.floor(F.rand(7) * (1 << 30)).cast("int").alias("_lot"),  # written, so a lost task changes none
        ).withColumn("_arc", arc_of(F.col("_place"), points)),
        "sharding",
    )
    counts = {r["_arc"]: r["count"] for r in rows.groupBy("_arc").count().collect()}  # at most shards x virtual_nodes rows
    part_rows = max(LEAST_PART, HOT_ARC * sum(counts.values()) // len(points))
    by_arc: dict[int, list] = {}
    for arc, first, end, owner, slot in walk(counts, points, shards):
        by_arc.setdefault(arc, []).append({"e": end, "s": owner, "o": slot - first})
    plan = df.sparkSession.sql(
        "SELECT inline(from_json('"
        + json.dumps([{"a": a, "k": -(-counts[a] // part_rows), "p": p} for a, p in by_arc.items()])
        + "', 'array<struct<a:int,k:int,p:array<struct<e:bigint,s:int,o:bigint>>>>'))"
    )
    planned = rows.join(F.broadcast(plan), rows["_arc"] == plan["a"])  # one row for each point at most
    dealt = planned.withColumn("_part", F.pmod("_lot", "k"))
    before = Window.partitionBy("_of").orderBy("_nr").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.where("k > 1").groupBy(F.col("_arc").alias("_of"), F.col("_part").alias("_nr")).count()
    # parts of hot arcs only: no more than points / HOT_ARC of them, and one for each hot arc
    offsets = sizes.select("_of", "_nr", F.sum("count").over(before).alias("_before"))
    within = Window.partitionBy("_arc", "_part").orderBy("_place", key, "text_crc32", "size")
    ranked = dealt.withColumn("_row", F.row_number().over(within) - 1)
    met = ranked.join(F.broadcast(offsets), (F.col("_arc") == F.col("_of")) & (F.col("_part") == F.col("_nr")), "left")
    placed = met.withColumn("_rank", F.col("_row") + F.coalesce("_before", F.lit(0)))
    piece = F.get(F.filter("p", lambda s: s["e"] > F.col("_rank")), F.lit(0))
    return placed.withColumn("_piece", piece).select(
        key,
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("_piece.s").alias("shard"),
        (F.col("_rank") + F.col("_piece.o")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
