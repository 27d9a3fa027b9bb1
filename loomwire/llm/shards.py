"""Operator 2, sharding: a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points on a ring of 64-bit hashes; the stretch up to a point is its arc. A key's
hash picks its arc. A shard takes at most its capacity; what an arc cannot give to its owner goes on clockwise
to the owner of the next arc, and so on. Only the sizes of the arcs (shards x vnodes numbers) reach the
driver, where the walk is worked out; the rows are then placed by their rank inside their arc, so no shard or
arc is ever gathered in one task.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwire.llm.columns import aside, count_at_most, table
from loomwire.operators.ranking import RESERVED, rank_in_groups
from loomwire.session import cut

SHARDS, VNODES = 40, 64


def ring_points(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """``(point, shard)`` in ring order. A shard's points do not depend on how many shards there are."""
    points = []
    for s in range(shards):
        for v in range(vnodes):
            h = hashlib.blake2b(f"shard-{s}/point-{v}".encode(), digest_size=8).digest()
            points.append((int.from_bytes(h, "big", signed=True), s))
    return sorted(points)


def capacities(total: int, shards: int, slack: float) -> list[int]:
    """Rows a shard may take: its even share (the first ones one more) raised by ``slack``."""
    share, rest = divmod(total, shards)
    return [int((share + (s < rest)) * (1 + slack)) for s in range(shards)]


def walk(sizes: dict[int, int], owners: list[int], limits: list[int]) -> list[tuple[int, int, int, int]]:
    """Pieces ``(arc, first rank, shard, first slot)``: how each arc's rows spread clockwise over the shards."""
    room, filled = list(limits), [0] * len(limits)
    begun = dict.fromkeys(sizes, 0)
    pieces, waiting, hop = [], sorted(a for a, n in sizes.items() if n), 0
    while waiting:
        still = []
        for arc in waiting:
            shard = owners[(arc + hop) % len(owners)]
            n = min(sizes[arc] - begun[arc], room[shard])
            if n:
                pieces.append((arc, begun[arc], shard, filled[shard]))
                begun[arc] += n
                filled[shard] += n
                room[shard] -= n
            if begun[arc] < sizes[arc]:
                still.append(arc)
        waiting, hop = still, hop + 1
    return pieces


def arc_of(key: Column, points: list[tuple[int, int]]) -> Column:
    """Number of the first ring point after the key's hash, the ring closing on itself."""
    edges = F.expr(f"array({', '.join(f'{p}L' for p, _ in points)})")
    return F.pmod(count_at_most(edges, F.xxhash64(key)), F.lit(len(points)))


def shard(keys: DataFrame, key: str, n_shards: int = SHARDS, vnodes: int = VNODES, slack: float = 0.0) -> DataFrame:
    """Add ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard) to the rows of ``keys``.

    With ``slack`` 0 the row counts of two shards differ by at most one; with ``slack`` e a shard holds at most
    its even share times 1 + e, and fewer rows move when a shard is added. Rows with one key share an arc but
    spill over like any others, so a hot key (null is a key too) cannot overfill a shard. Repeated rows are placed
    one by one. An empty table gives none; ``keys`` may not have the two columns added.
    Which of two equal keys goes where follows from a hash of the whole row; the result is repeatable.
    """
    given, (keys, back) = key, aside(keys, ["_arc", "_pieces", "rank", "_mine", *RESERVED])
    key = keys.columns[back(keys).columns.index(given)]
    points = ring_points(n_shards, vnodes)
    owners = [s for _, s in points]
    columns = keys.columns
    rows = cut(keys.withColumn("_arc", arc_of(F.col(key), points)))
    # at most n_shards * vnodes numbers, whatever the size of the table
    sizes = {r["_arc"]: r["n"] for r in rows.groupBy("_arc").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    limits = capacities(total, n_shards, slack)
    while sum(limits) < total:
        limits = [x + 1 for x in limits]
    pieces: dict[int, list] = {}
    for arc, first, s, slot in walk(sizes, owners, limits):
        pieces.setdefault(arc, []).append((first, s, slot))
    plan = rows.sparkSession.createDataFrame(
        [(a, p) for a, p in pieces.items()] or [(-1, [(0, 0, 0)])], "_arc int, _pieces array<struct<first: long, shard: int, slot: long>>"
    )
    ranked = rank_in_groups(rows, ["_arc"], F.xxhash64(F.lit(2), *[F.col(c) for c in columns]), "rank")
    mine = F.element_at(F.filter("_pieces", lambda p: p["first"] <= F.col("rank")), -1)
    placed = ranked.join(F.broadcast(plan), "_arc").withColumn("_mine", mine)
    return back(placed.select(*columns, F.col("_mine.shard").alias("shard"), (F.col("_mine.slot") + F.col("rank") - F.col("_mine.first")).alias("slot")))


def op2_shards(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 under the law ``rows``: a null text has the size 16 and the checksum of
    no bytes; the key is the doc_id."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    keys = docs.select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32")
    )
    return shard(keys, "doc_id", SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
