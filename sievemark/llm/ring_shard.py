"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has `vnodes` points on a ring of 2^62 places; a text belongs to the arc that ends at the next point
clockwise, so rows of equal texts share a place. A shard takes at most its capacity: n // shards rows, and one more for the first n % shards of them. Each shard
fills from its own arcs first, in ring order; rows that overflow it go on clockwise to the first shard with room. As the
capacities sum to n, shard counts end at most one apart (law `rows`), and most rows stay where a plain ring puts them.

Rows of one arc take the same way, so only arcs are followed one by one: shards * vnodes rows, however large the table.
Each arc's way is a list of (shard, count); a row's rank within its arc picks the shard and the slot. Equal texts have neighbouring ranks, so
they are parted only where an entry of a way ends: at most one group for each entry, and there are at most shards + arcs entries.

Defined results: a null text counts as empty, of size 16; ids don't matter for the place; repeated rows are counted, then
numbered one after another; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import in_parts, running
from .common import documents, expanded, text_of, written

SHARDS, VNODES = 40, 128
RING_BITS, CELL_BITS = 62, 12


def ring(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(place, shard) in ring order."""
    at = lambda s, v: int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big") >> (64 - RING_BITS)
    return sorted((at(s, v), s) for s in range(shards) for v in range(vnodes))


def ways(points: list[tuple[int, int]], counts: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, last rank, shard, slot of the first rank): where the keys of each arc go, by the bounded-load walk."""
    room, used, out = list(room), [0] * len(room), []

    def put(arc: int, rank: int, n: int, shard: int) -> None:
        out.append((arc, rank, rank + n - 1, shard, used[shard]))
        used[shard] += n
        room[shard] -= n

    ranks = [0] * len(points)
    for a, (_, s) in enumerate(points):
        if n := min(counts[a], room[s]):
            put(a, 0, n, s)
            ranks[a] = n
    nxt = list(range(len(points)))  # the next arc, from each, whose shard may have room

    def free(a: int) -> int:
        way = []
        while room[points[a][1]] == 0:
            way.append(a)
            a = nxt[a] = (nxt[a] + 1) % len(points) if nxt[a] == a else nxt[a]
        for x in way:
            nxt[x] = a
        return a

    for a in range(len(points)):
        while (left := counts[a] - ranks[a]) > 0:
            s = points[free(a)][1]
            n = min(left, room[s])
            put(a, ranks[a], n, s)
            ranks[a] += n
    return out


def capacities(n: int, shards: int) -> list[int]:
    return [n // shards + (s < n % shards) for s in range(shards)]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_of(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 64 - RING_BITS).alias("place"),
    )


def assign(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, arc, home (the shard of a ring without bounds), shard, slot."""
    spark = docs.sparkSession
    points = ring(shards, vnodes)
    width = 1 << (RING_BITS - CELL_BITS)
    # Arc a holds the places after the point before it, up to its own; those after the last point belong to arc 0.
    edges = [(a, points[a - 1][0] + 1 if a else 0, p) for a, (p, _) in enumerate(points)] + [(0, points[-1][0] + 1, (1 << RING_BITS) - 1)]
    cells = [(c, a, lo, hi) for a, lo, hi in edges for c in range(lo // width, hi // width + 1) if lo <= hi]
    arcs = F.broadcast(spark.createDataFrame(cells, "cell long, arc int, lo long, hi long"))  # shards * vnodes + 2^CELL_BITS rows
    rows = (
        keyed(docs, id_col, text_col)
        .groupBy("doc_id", "size", "text_crc32", "place")
        .agg(F.count(F.lit(1)).alias("copies"))  # repeated rows come as one
        .withColumn("cell", F.shiftrightunsigned("place", RING_BITS - CELL_BITS))
        .join(arcs, "cell")
        .where("place >= lo and place <= hi")
        .select("doc_id", "size", "text_crc32", "copies", "place", "arc")
    )
    rows = written(rows, "ring")
    counts = [0] * len(points)
    for arc, n in rows.groupBy("arc").agg(F.sum("copies")).collect():  # a row per arc
        counts[arc] = n
    moved = ways(points, counts, capacities(sum(counts), shards))
    home = [(a, s) for a, (_, s) in enumerate(points)]
    # The walk fills at least one shard or ends one arc with each entry: at most shards + arcs entries.
    to = F.broadcast(spark.createDataFrame(moved, "arc int, first long, last long, shard int, slot0 long"))
    homes = F.broadcast(spark.createDataFrame(home, "arc int, home int"))
    # Equal texts stand together, and in hash order among themselves, so that a text that a third of the rows share spans as many parts as it fills.
    order = ["place", "_h", "size", "text_crc32", "doc_id"]
    parts = in_parts(rows.withColumn("_h", F.xxhash64("doc_id")), ["arc", *order], "ring-order")
    ranked = running(parts, ["arc"], order, {"before": F.col("copies")})
    each = expanded(ranked, "before", "copies", "rank")
    return (
        each.join(to, "arc")
        .where("rank >= first and rank <= last")
        .join(homes, "arc")
        .select("doc_id", "size", "text_crc32", "arc", "home", "shard", (F.col("slot0") + F.col("rank") - F.col("first")).alias("slot"))
    )


def op3_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home"
    )
