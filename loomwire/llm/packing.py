"""Operator 8, best-fit packing by linear grouping.

The driver plans on the histogram of piece lengths, which has no more entries than a sequence has tokens. Large
lengths are split into groups of equal cardinality and rounded up to each group's largest; configurations of few
sizes that fill a sequence best are taken as often as the counts allow; the real pieces take the places of the rounded
ones by their rank in the group; small pieces then go best-fit into the room that is really left. Ranks are
worked out on the cluster, so pieces and sequences are never gathered.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwire.llm.columns import aside, count_at_most, table
from loomwire.llm.tokens import default_path, encoder
from loomwire.operators.ranking import RESERVED, rank_in_groups
from loomwire.session import cut, stored

CAPACITY, GROUPS, SMALL = 2048, 512, 256
SEPARATOR = b"\0\0\0\0"


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32 and, if asked for, ``ids``.

    A document is its tokens and one separator (id 0), so a null or empty text is one piece of one token. Only longer
    ones than ``capacity`` are cut; the first piece takes what does not fill a whole one.
    """
    path = path or default_path()

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = encoder(path)
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
                data = memoryview(tool.encode(text) + SEPARATOR)
                n = len(data) // 4
                end = n % capacity or min(n, capacity)
                start = number = 0
                while start < n:
                    part = data[4 * start : 4 * end]
                    out.append((doc, number, start, end - start, zlib.crc32(part), np.frombuffer(part, "<u4").astype("int32") if with_ids else None))
                    start, end, number = end, end + capacity, number + 1
            found = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])
            found["doc_id"] = pd.array(found["doc_id"], "Int64")
            yield found if with_ids else found.drop(columns="ids")

    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInPandas(split, kind)


def grouped(histogram: dict[int, int], groups: int, small: int) -> list[tuple[int, int, int]]:
    """``(least, greatest, count)`` of the groups of large lengths, longest first, of about equal counts."""
    large = sorted((x for x in histogram if x > small), reverse=True)
    share = sum(histogram[x] for x in large) / max(1, groups)
    out, held, top = [], 0, None
    for x in large:
        top = top or x
        held += histogram[x]
        if held >= share or x == large[-1]:
            out.append((x, top, held))
            held, top = 0, None
    return out


def best_filling(room: int, sizes: list[int], counts: list[int]) -> list[int]:
    """How many of each size (longest first) fill ``room`` best, no more than there are."""
    choice = np.full(room + 1, -1)  # the size whose piece ends the best way to this sum
    choice[0] = len(sizes)
    for k, (size, count) in enumerate(zip(sizes, counts, strict=True)):
        base = choice >= 0
        for _ in range(min(count, room // size)):
            moved = np.zeros_like(base)
            moved[size:] = base[:-size]
            fresh = moved & (choice < 0)
            choice[fresh] = k
            if not fresh.any():
                break
            base = fresh
    at, took = int(np.flatnonzero(choice >= 0)[-1]), [0] * len(sizes)
    while at:
        k = int(choice[at])
        took[k] += 1
        at -= sizes[k]
    return took


def configurations(groups: list[tuple[int, int, int]], capacity: int) -> list[tuple[int, list[int]]]:
    """``(how many sequences, pieces of each group)``: the longest size left, with the best filling of the rest."""
    sizes, left, out = [g[1] for g in groups], [g[2] for g in groups], []
    for g in range(len(groups)):
        while left[g]:
            free = [n - (i == g) for i, n in enumerate(left)]
            took = best_filling(capacity - sizes[g], sizes, free)
            took[g] += 1
            times = min(left[i] // n for i, n in enumerate(took) if n)
            out.append((times, took))
            left = [n - times * took[i] for i, n in enumerate(left)]
    return out


def best_fit(small: dict[int, int], free: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Where pieces of the lengths ``small`` go among sequences with room ``free`` (room -> count).

    Returns ``(length, first rank, room, first sequence)`` for runs of equal pieces that go to a run of the sequences
    which began with that room, and the number of new sequences, which are those of room -1."""
    held: dict[int, list[tuple[int, int, int]]] = {f: [(f, 0, n)] for f, n in free.items() if n}
    opened, out = 0, []
    for length in sorted(small, reverse=True):
        rank, wanted = 0, small[length]
        while rank < wanted:
            room = min((f for f in held if f >= length), default=None)
            if room is None:
                more = -(-(wanted - rank) // (capacity // length))
                held[capacity] = [(-1, opened, opened + more)]
                opened, room = opened + more, capacity
            kind, low, high = held[room].pop()
            if not held[room]:
                del held[room]
            n = min(high - low, wanted - rank)
            out.append((length, rank, kind, low))
            if low + n < high:
                held.setdefault(room, []).append((kind, low + n, high))
            if room > length:
                held.setdefault(room - length, []).append((kind, low, low + n))
            rank += n
    return out, opened


def pack(items: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``items`` (any columns, with ``length`` from 1 to ``capacity``).

    Sequences hold at most ``capacity`` tokens and their pieces lie gapless from 0. Items that repeat are packed one by
    one; no items give no rows. ``items`` should be cheap to read again (stored). They may not have the two columns added.
    """
    items, back = aside(items, ["_kind", "_rank", "_plan", "_room", "_seat", "_spot", *RESERVED])
    spark, columns = items.sparkSession, items.columns
    histogram = {int(r["length"]): r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    if not histogram:
        return back(items.select(*columns, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
    classes = grouped(histogram, groups, small)
    plan, base, begun = {i: [] for i in range(len(classes))}, 0, [0] * len(classes)
    for times, took in configurations(classes, capacity):
        for i, n in enumerate(took):
            if n:
                plan[i].append((begun[i], n, base))
                begun[i] += n * times
        base += times
    # a kind is the group of a large length (-1, -2, ...) or a small length itself
    kind = F.when(F.col("length") <= small, F.col("length").cast("int"))
    least = F.expr(f"array({', '.join(str(g[0]) for g in reversed(classes))})") if classes else None
    if classes:
        kind = kind.otherwise(-(F.lit(len(classes)) - count_at_most(least, F.col("length").cast("int")) + 1))
    spread = F.xxhash64(F.lit(5), *[F.col(c) for c in columns if not items.schema[c].dataType.simpleString().startswith("array")])
    ranked = cut(rank_in_groups(items.withColumn("_kind", kind), ["_kind"], spread, "_rank"))
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    mine = lambda starts: F.get(F.col("_plan"), count_at_most(F.transform("_plan", starts), F.col("_rank")) - 1)
    spots = frame([(-1 - i, p) for i, p in plan.items()] or [(0, [])], "_kind int, _plan array<struct<first: long, n: int, base: long>>")
    seat = mine(lambda p: p["first"])
    large = (
        ranked.join(F.broadcast(spots), "_kind").withColumn("_seat", seat)
        .select(*columns, (F.col("_seat.base") + F.floor((F.col("_rank") - F.col("_seat.first")) / F.col("_seat.n"))).cast("long").alias("sequence_id"))
    )
    large = cut(large)
    rest = {x: n for x, n in histogram.items() if x <= small}
    rooms = large.groupBy("sequence_id").agg((F.lit(capacity) - F.sum("length")).cast("int").alias("_room"))
    rooms = cut(rank_in_groups(cut(rooms.filter(F.col("_room") > 0)), ["_room"], F.xxhash64("sequence_id"), "_seat"))
    free = {r["_room"]: r["n"] for r in rooms.groupBy("_room").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    runs, _ = best_fit(rest, free, capacity)
    by_length: dict[int, list] = {}
    for length, first, room, low in runs:
        by_length.setdefault(length, []).append((first, room, low))
    spots = frame(list(by_length.items()) or [(0, [])], "_kind int, _plan array<struct<first: long, room: int, low: long>>")
    placed = (
        ranked.join(F.broadcast(spots), "_kind").withColumn("_spot", mine(lambda p: p["first"]))
        .select(*columns, F.col("_spot.room").alias("_room"), (F.col("_spot.low") + F.col("_rank") - F.col("_spot.first")).alias("_seat"))
    )
    fresh = placed.filter("_room = -1").select(*columns, (F.lit(base) + F.col("_seat")).cast("long").alias("sequence_id"))
    filled = placed.filter("_room >= 0").join(rooms, ["_room", "_seat"]).select(*columns, "sequence_id")
    every = large.unionByName(fresh).unionByName(filled)
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), *[c for c in columns if c != "length"])  # at most ``capacity`` rows
    running = F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return back(every.select(*columns, "sequence_id", (running - F.col("length")).cast("long").alias("offset")))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    return pack(stored(pieces(docs, capacity, path), "pieces"), capacity)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))
