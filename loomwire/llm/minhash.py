"""Operator 6, MinHash near-duplicates with tensored banding.

Two small collections of minhash groups are computed, and every pair of a group of the first and one of the
second is the key of a table: ``FIRST`` + ``SECOND`` groups give ``FIRST`` x ``SECOND`` tables. With two minhashes in
a group of the first collection and one in the second, 26 minhashes serve 60 tables of three. Two texts of
similarity s miss all tables with probability at most (1 - s^2)^10 + (1 - s)^6: 5e-4 at 0.75, 1e-4 at 0.8, 1e-6
at 0.9. Every link is confirmed on the full shingle sets.

Each bucket of a table belongs to its hub, the member that shares most buckets with others, and the members of all of a
hub's buckets are a group. A group's members are compared with its most central one, so a group of copies costs a star.
What is apart still is compared with one another where the members share one of their rarest shingles within the
group, which loses no link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwire.llm.columns import aside, row_key, sized, table
from loomwire.llm.hashing import minima, mix, shingle_sets, signed
from loomwire.operators.graph import connected_components
from loomwire.session import Workspace, cut, n_rows, stored

WORDS, PERCENT = 5, 75
FIRST, SECOND = 10, 6
#: Components from which on a group gets further centres, as long as one comparison in ``YIELD`` gives a link.
CROWD, YIELD = 64, 64


def _profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    salt_a, salt_b = np.arange(FIRST, dtype=np.uint64), np.arange(SECOND, dtype=np.uint64) + np.uint64(1000)
    for batch in batches:
        out = []
        for h in shingle_sets(batch["text"].tolist(), WORDS):
            if not len(h):
                out.append((0, None, None, None, None))
                continue
            m = minima(h, 2 * FIRST + SECOND)
            a = mix(m[: 2 * FIRST : 2] * np.uint64(3) + mix(m[1 : 2 * FIRST : 2] + salt_a))
            b = mix(m[2 * FIRST :] + salt_b)
            with np.errstate(over="ignore"):
                s1, s2 = mix(h.sum(dtype=np.uint64, keepdims=True)), mix(np.bitwise_xor.reduce(mix(h), keepdims=True) + np.uint64(len(h)))
            out.append((len(h), signed(s1)[0], signed(s2)[0], signed(a), signed(b)))
        n, s1, s2, a, b = zip(*out, strict=True) if out else ((),) * 5
        yield pd.DataFrame(
            {"doc_id": batch["doc_id"], "row_key": batch["row_key"], "n_shingles": n, "node": pd.array(s1, "Int64"), "check": pd.array(s2, "Int64"), "a": a, "b": b}
        )


def profiles(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, ``row_key`` (64 bits of id and text), size of the shingle set, ``node`` (64 bits of
    the set), minhash groups ``a`` and ``b``. Texts with equal sets share a node, so copies take part once.
    """
    rows = docs.select("doc_id", row_key().alias("row_key"), "text")
    raw = rows.mapInPandas(_profile, "doc_id long, row_key long, n_shingles long, node long, check long, a array<long>, b array<long>")
    return raw.withColumn("node", F.when(F.col("node").isNotNull(), F.xxhash64("node", "check", "n_shingles")))


def _confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pairs of texts that are linked. Rows come ordered by ``src``, whose set is kept from row to row."""
    last, left = None, None
    for batch in batches:
        good = []
        for s, d, ts, hd in zip(batch["src"], batch["dst"], batch["text_src"], shingle_sets(batch["text_dst"].tolist(), WORDS), strict=True):
            if last != s:
                last, left = s, next(shingle_sets([ts], WORDS))
            both = len(np.intersect1d(left, hd, assume_unique=True))
            if 100 * both >= PERCENT * (len(left) + len(hd) - both):
                good.append((s, d))
        yield pd.DataFrame(good, columns=["src", "dst"]) if good else pd.DataFrame({"src": pd.array([], "int64"), "dst": pd.array([], "int64")})


def texts_of(asked: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """``(node, text)`` for the nodes ``asked``; ``nodes(node, rep, n)`` has the row key of a text with the node's set.
    Only these texts are shuffled."""
    wanted = cut(asked.select("node").distinct().join(nodes.select("node", "rep"), "node"))
    one = docs.select(row_key().alias("rep"), "text").join(sized(wanted, n_rows(wanted)), "rep")
    return one.select("node", "text").dropDuplicates(["node"])


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs(src, dst)`` whose full shingle sets are similar enough; ``texts(node, text)`` has all their texts."""
    by_dst = pairs.join(texts.select(F.col("node").alias("dst"), F.col("text").alias("text_dst")), "dst")
    both = by_dst.join(texts.select(F.col("node").alias("src"), F.col("text").alias("text_src")), "src")
    return cut(both.select("src", "dst", "text_src", "text_dst").sortWithinPartitions("src").mapInPandas(_confirm, "src long, dst long"))


def _explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sets = [signed(h) for h in shingle_sets(batch["text"].tolist(), WORDS)]
        sizes = [len(x) for x in sets]
        yield pd.DataFrame({c: np.repeat(batch[c].to_numpy(), sizes) for c in ("hub", "node")} | {"shingle": np.concatenate([*sets, np.zeros(0, np.int64)])})


def band(n: Column) -> Column:
    """Sizes by tenths, so that only sets of possible sizes are joined."""
    return F.floor(F.log(n) / F.log(F.lit(1.1))).cast("int")


def in_groups(facing: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """``(hub, node, n, component)`` of the groups ``facing(hub, node)`` that hold several components."""
    rows = facing.join(nodes.select("node", "n"), "node").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ = rows.groupBy("hub").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
    return rows.join(open_.select("hub"), "hub")


def counted(every: DataFrame) -> DataFrame:
    """``every(hub, node, shingle)`` with ``times``, in how many of the group's texts a shingle is."""
    return every.join(every.groupBy("hub", "shingle").agg(F.count("*").alias("times")), ["hub", "shingle"])


def central_pairs(rows: DataFrame, timed: DataFrame) -> DataFrame:
    """``(hub, node)`` where ``hub`` is the most central of the given members of a group and ``node`` one in another component.

    The sum over a text's shingles of the number of texts that hold them is its overlap with all texts of the group
    together, so this is linear in the shingles."""
    total = timed.groupBy("hub", "node").agg(F.sum("times").alias("total"))
    sizes = rows.groupBy("hub").agg(F.count("*").alias("k"), F.avg("n").alias("mean"))
    overlap = F.col("total") / F.col("k")
    scored = total.join(sizes, "hub").join(rows, ["hub", "node"]).withColumn("score", overlap / (F.col("n") + F.col("mean") - overlap))
    centre = scored.groupBy("hub").agg(F.max(F.struct("score", "node", "component")).alias("c")).select("hub", F.col("c.node").alias("centre"), F.col("c.component").alias("own"))
    return rows.join(centre, "hub").filter("component <> own").select(F.col("centre").alias("hub"), "node")


def outside(rows: DataFrame) -> DataFrame:
    """Of the groups with CROWD components or more the members outside the largest one."""
    parts = rows.groupBy("hub", "component").agg(F.count("*").alias("size"))
    many = parts.groupBy("hub").agg(F.max(F.struct("size", "component")).alias("main"), F.count("*").alias("k")).filter(F.col("k") >= CROWD)
    return rows.join(many.select("hub", F.col("main.component").alias("main")), "hub").filter("component <> main").drop("main")


def rest_pairs(members: DataFrame, timed: DataFrame, space: Workspace) -> DataFrame:
    """Candidate pairs of members of one group that are in different components still.

    Under any order of shingles two sets of the wanted similarity share one of their first n - ceil(0.75 n) + 1, and
    the first shared one lies early enough in both to leave room for the overlap (Xiao et al. 2008). Here each
    group has its own order, with the shingles common in the group last; so texts that have no more in common than the
    group's passage, or than all copies of one text, do not meet. Of the components that hold a shingle the largest
    only waits for the others, so its members never meet one another. ``timed`` is what :func:`counted` gives.
    """
    members = space.store(members, "members")
    ranked = timed.join(members.select("hub").distinct(), "hub", "left_semi").groupBy("hub", "node").agg(F.sort_array(F.collect_list(F.struct("times", "shingle"))).alias("s"))  # one text's
    first = F.size("s") - F.ceil(F.size("s") * PERCENT / 100).cast("int") + 1
    keys = ranked.select("hub", "node", F.posexplode(F.slice("s", F.lit(1), first)).alias("place", "s")).join(members, ["hub", "node"])
    keys = space.store(keys.select("hub", "node", "n", "component", "s.shingle", F.col("place").cast("long").alias("place")), "prefixes")
    groups = keys.groupBy("hub", "shingle", "component").agg(F.count("*").alias("size"))
    several = groups.groupBy("hub", "shingle").agg(F.max(F.struct("size", "component")).alias("main"), F.count("*").alias("k")).filter("k > 1")
    live = space.store(keys.join(several.select("hub", "shingle", F.col("main.component").alias("main")), ["hub", "shingle"]), "live")
    n, left = F.col("n"), F.col("n") - F.col("place")  # what is left from this shingle on bounds the overlap, and so the other's size
    low, high = F.ceil(n * PERCENT / 100), F.floor(F.least(n * 100 / PERCENT, left * (100 + PERCENT) / PERCENT - n))
    asking = live.filter((F.col("component") != F.col("main")) & (low <= high)).withColumn("band", F.explode(F.sequence(band(low), band(high))))
    asking = asking.select("hub", "shingle", "band", F.col("node").alias("src"), F.col("n").alias("m"), F.col("component").alias("c"), F.col("place").alias("p"))
    asked = live.withColumn("band", band(n))
    overlap = F.ceil((F.col("n") + F.col("m")) * PERCENT / (100 + PERCENT))
    room = F.least(F.col("n") - F.col("place"), F.col("m") - F.col("p"))
    same = [asking[c] == asked[c] for c in ("hub", "shingle", "band")]
    met = asking.join(asked, [*same, F.col("c") != F.col("component"), near_pairs(F.col("n"), F.col("m")), room >= overlap])
    return cut(met.select(F.least("src", "node").alias("src"), F.greatest("src", "node").alias("dst")).distinct())


def table_keys(classes: DataFrame) -> DataFrame:
    """``(key, node)``: the key of each of the tables, formed by pairing the two collections."""
    pairs = F.flatten(F.transform("a", lambda x, i: F.transform("b", lambda y, j: F.xxhash64(x, y, i, j))))
    return classes.select(F.explode(pairs).alias("key"), "node")


def near_pairs(a, b):
    """Whether sets of these sizes can be similar enough at all."""
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def candidate_buckets(rows: DataFrame) -> DataFrame:
    """The rows of keys that at least two nodes share."""
    shared = rows.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select("key")
    return rows.join(shared, "key")


def relabelled(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """The components ``(node, component)`` after ``edges`` too, given those before."""
    if labels is None:
        return cut(connected_components(edges))
    names = labels.select("node", "component")
    for end in ("src", "dst"):
        edges = edges.join(names.select(F.col("node").alias(end), F.col("component").alias(f"{end}_of")), end, "left").withColumn(end, F.coalesce(f"{end}_of", end)).drop(f"{end}_of")
    merged = cut(connected_components(cut(edges.select("src", "dst").distinct())).withColumnRenamed("component", "into"))
    there = names.join(merged.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("into", "component").alias("component"))
    fresh = merged.join(names, "node", "left_anti").select("node", F.col("into").alias("component"))
    return cut(there.unionByName(fresh).distinct())


def hubs_of(buckets: DataFrame) -> DataFrame:
    """``(hub, node)``: every member of a bucket beside the member of the greatest ``weight``, itself included."""
    hubs = buckets.groupBy("key").agg(F.max(F.struct("weight", F.xxhash64("node").alias("o"), "node")).alias("hub")).select("key", F.col("hub.node").alias("hub"))
    return buckets.join(hubs, "key").select("hub", "node").distinct()


def sized_pairs(facing: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(src, dst)`` of the centres and members whose sizes allow a link."""
    sides = facing.join(nodes.select("node", "n"), "node").join(nodes.select(F.col("node").alias("hub"), F.col("n").alias("m")), "hub")
    return cut(sides.filter(near_pairs(F.col("n"), F.col("m"))).select(F.col("hub").alias("src"), F.col("node").alias("dst")).distinct())


def link(prof: DataFrame, docs: DataFrame, space: Workspace) -> DataFrame:
    """``(node, component)`` of all nodes that are linked with another.

    Nodes stand for texts of equal sets. Each group's members meet the most central of them; groups that still hold many
    components go on with the most central of those outside the largest one, while that links enough of them; the rest
    meets by rarest shingles. So the pairs of a bucket are never written out, and no candidate is left undecided.
    """
    full = prof.filter("node IS NOT NULL")
    nodes = cut(full.groupBy("node").agg(F.min("row_key").alias("rep"), F.max("n_shingles").alias("n")))
    # a row per node; rows that repeat id and text repeat here, which distinct() below bears
    mine = full.select(F.col("row_key").alias("rep"), "node", "a", "b")
    one = mine.join(nodes, ["node", "rep"]).select("node", "a", "b")
    found = space.store(candidate_buckets(table_keys(one)).distinct(), "found")
    weights = found.join(found.groupBy("key").agg(F.count("*").alias("m")), "key").groupBy("node").agg(F.sum("m").alias("weight"))
    buckets = space.store(found.join(weights, "node"), "buckets")
    space.drop("found")
    texts = space.store(texts_of(buckets, nodes, docs), "texts")
    every = space.store(hubs_of(buckets), "hubs")
    space.drop("buckets")
    # what several later queries read is kept, so that none of them repeats the joins that make it
    of = space.store(every.join(every.groupBy("hub").agg(F.count("*").alias("k")), "hub"), "facing")
    space.drop("hubs")
    couples, facing = of.filter("k = 2 AND node <> hub").select("hub", "node"), of.filter("k > 2").select("hub", "node")
    every = space.store(facing.join(texts, "node").select("hub", "node", "text").mapInPandas(_explode, "hub long, node long, shingle long"), "shingles")
    timed = space.store(counted(every), "timed")
    space.drop("shingles")
    # a couple is decided by its one pair; larger groups go on from their centres
    alone = space.store(facing.join(nodes.select("node", "n"), "node").withColumn("component", F.col("node")), "alone")
    pairs, labels = sized_pairs(central_pairs(alone, timed).unionByName(couples).distinct(), nodes), None
    while n := n_rows(pairs):
        edges = confirm(pairs, texts)
        labels = relabelled(labels, edges)
        rows = cut(in_groups(facing, nodes, labels))
        if n_rows(edges) * YIELD < n:
            break
        met = cut(outside(rows))
        fresh = counted(timed.select("hub", "node", "shingle").join(met.select("hub", "node"), ["hub", "node"]))
        pairs = sized_pairs(central_pairs(met, fresh).distinct(), nodes)
    if labels is None:  # no size fits its centre's
        labels = docs.sparkSession.createDataFrame([], "node long, component long")
        rows = cut(in_groups(facing, nodes, labels))
    pairs = rest_pairs(rows, timed, space)
    return relabelled(labels, confirm(pairs, texts)) if n_rows(pairs.limit(1)) else labels


def grouped(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, row_key, n_shingles, ``component`` (64 bits, equal for near-duplicates; null
    without shingles), component_id (the least doc_id of the component). A written table of narrow rows."""
    space = Workspace(docs.sparkSession, "minhash")
    prof = space.store(profiles(docs), "profiles")
    labels = link(prof, docs, space)
    placed = prof.select("doc_id", "row_key", "n_shingles", "node").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.filter("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = placed.join(least, "component", "left").withColumn("component_id", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    out = stored(out.select("doc_id", "row_key", "n_shingles", "component", "component_id"), "near-groups")
    space.close()
    return out


def stays() -> Column:
    """Whether a row of :func:`grouped` is the one of its component that is kept."""
    return F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, row_key, n_shingles, component_id, kept.

    Texts null, empty or blank have no shingles: component_id is their own doc_id and they are kept. Rows with equal
    sets, repeated rows included, are one class. A null doc_id takes part in linking but names no component: its
    component_id is the least doc_id it is linked with (null if there is none, and then it is kept).
    """
    return grouped(docs).select("doc_id", "row_key", "n_shingles", "component_id", stays().alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that :func:`near_duplicates` keeps, each once even where id and text repeat; all columns stay.

    The rows to drop are joined, not those to keep: they are fewer, and up to a checked number of them are broadcast.
    """
    docs, back = aside(docs, ["row_key"])
    marked = cut(near_duplicates(docs).groupBy("row_key").agg(F.count("*").alias("n"), F.max("kept").alias("kept")))
    gone = marked.filter("NOT kept OR n > 1").select("row_key")
    again = marked.filter("kept AND n > 1").select("row_key")
    keyed = docs.withColumn("row_key", row_key())
    once = keyed.join(sized(gone, n_rows(gone)), "row_key", "left_anti")
    repeated = keyed.join(sized(again, n_rows(again)), "row_key", "left_semi").dropDuplicates(["row_key"])
    return back(once.unionByName(repeated).select(*docs.columns))


def op6_minhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents")).drop("row_key")


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, array_to_string(w[i:i+4], ' ') AS g FROM w, unnest(range(1, len(w) - 3)) AS t(i) WHERE len(w) >= 5
    UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
r AS (SELECT doc_id AS v, doc_id AS u FROM n UNION SELECT r.v, e.y FROM r JOIN e ON r.u = e.x),
c AS (SELECT v AS doc_id, min(u) AS component_id FROM r GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id,
  d.doc_id = coalesce(c.component_id, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
