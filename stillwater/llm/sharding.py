"""Sharding on a consistent-hash ring with bounded loads (built-in functions only)."""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sorted_ranks

#: Places on the ring; a virtual node stands at one of them.
RING_BITS = 16


def ring(shards: int, virtual_nodes: int = 32, bits: int = RING_BITS) -> list[tuple[int, int]]:
    """The virtual nodes as (place, shard), in clockwise order; a place belongs to one shard."""
    import hashlib

    taken: dict[int, int] = {}
    for s in range(shards):
        for v in range(virtual_nodes):
            at = int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big") >> (64 - bits)
            while at in taken:  # the next free place clockwise
                at = (at + 1) % (1 << bits)
            taken[at] = s
    return sorted(taken.items())


def quotas(total: int, shards: int) -> list[int]:
    """The rows that each shard can hold: the counts differ by one at most."""
    return [total // shards + (s < total % shards) for s in range(shards)]


def overflow(counts: dict[int, int], nodes: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Walk the ring with the number of keys in each arc; give (arc, from rank, to rank, shard, first slot).

    Every arc first fills the shard of its own virtual node; what a full shard
    cannot take moves on clockwise.  All overflows move one node at a time,
    the earlier ranks of an arc staying nearer.  The work depends on the
    number of virtual nodes alone.
    """
    room, used = list(room), [0] * len(room)
    waiting = [(a, 0, counts[a]) for a in sorted(counts) if counts[a]]
    out, step = [], 0
    while waiting:
        left = []
        for a, lo, hi in waiting:
            s = nodes[(a + step) % len(nodes)][1]
            n = min(hi - lo, room[s])
            if n:
                out.append((a, lo, lo + n, s, used[s]))
                room[s] -= n
                used[s] += n
            if lo + n < hi:
                left.append((a, lo + n, hi))
        waiting, step = left, step + 1
    return out


def shard_rows(rows: DataFrame, key_col: str, shards: int, virtual_nodes: int = 32) -> DataFrame:
    """Put every row into one of ``shards`` shards; adds ``shard`` and ``slot`` (gapless from 0 in each shard).

    A key is hashed to a place on the ring and belongs to the next virtual
    node clockwise.  Rows of one arc are ranked by hash and key with a range
    sort that spreads an arc of any size; a key that many rows share therefore
    overflows like any other.  Only the count of each arc reaches the driver
    (``shards * virtual_nodes`` numbers).  Shard counts differ by one at most.

    A null key is hashed as the empty text; repeated rows count each; an empty
    table gives an empty result.  All columns of ``rows`` stay, whatever their
    names; columns called ``shard`` or ``slot`` are replaced.
    """
    spark = rows.sparkSession
    nodes = ring(shards, virtual_nodes)
    places = [p for p, _ in nodes]
    arc_of = [bisect.bisect_left(places, p) % len(places) for p in range(1 << RING_BITS)]
    # 2**16 rows at any size of input.
    table = F.broadcast(spark.createDataFrame(list(enumerate(arc_of)), "place int, arc int"))
    # the caller's columns by number, so that no name of theirs meets one of ours
    own = [F.col(f"`{c}`").alias(f"own{i}") for i, c in enumerate(rows.columns)]
    key = f"own{rows.columns.index(key_col)}"
    at = rows.select(*own).withColumn("hash", F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit(""))))
    at = at.withColumn("place", F.shiftrightunsigned("hash", 64 - RING_BITS).cast("int")).join(table, "place").drop("place")
    ranked = sorted_ranks(at, "arc", [F.col("hash"), F.col(key), *(F.col(f"own{i}") for i in range(len(own)) if f"own{i}" != key)])
    counts = {r["arc"]: r["n"] for r in ranked.groupBy("arc").agg(F.count("*").alias("n")).collect()}
    moves = overflow(counts, nodes, quotas(sum(counts.values()), shards))
    by_arc: dict[int, list] = {}
    for a, lo, hi, s, slot in moves:
        by_arc.setdefault(a, []).append((lo, hi, s, slot))
    plan = spark.createDataFrame(list(by_arc.items()), "arc int, to array<struct<lo: long, hi: long, shard: int, slot: long>>")
    out = ranked.join(F.broadcast(plan), "arc").withColumn("to", F.filter("to", lambda t: (F.col("rank") >= t.lo) & (F.col("rank") < t.hi))[0])
    back = [F.col(f"own{i}").alias(c) for i, c in enumerate(rows.columns) if c not in ("shard", "slot")]
    return out.select(*back, F.col("to.shard").alias("shard"), (F.col("to.slot") + F.col("rank") - F.col("to.lo")).alias("slot"))
