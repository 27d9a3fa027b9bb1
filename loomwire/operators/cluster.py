"""Clusters of articles: D6, D8, D9, A1-A4, A12.

Members are a long table ``(cluster_id, id)``; a cluster's id is its least member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwire.config import DEFAULT, FusionConfig
from loomwire.functions.fingerprints import fingerprint_hash, fingerprint_similarity
from loomwire.functions.vectors import clamp01, vec_dot, vec_normalize
from loomwire.operators.graph import connected_components
from loomwire.operators.simjoin import cell_centres, cosine_links, cosine_pairs, nearest_groups, shared_entity_pairs, tfidf_groups, tfidf_links, tfidf_nearest, tfidf_terms, unit
from loomwire.session import cut, n_rows


#: Members of a component of the threshold graph up to which one task links it; larger ones are contracted part by part.
TASK_MEMBERS = 2048
#: So many times as many vectors are linked in one task that holds no matrix, but sums alone (:func:`chained_linkage`).
CHAINED = 8
#: Numbers that stand for a text where parts are drawn.
SKETCH = 24


def average_linkage(dots: np.ndarray, n: np.ndarray, threshold: float, limit: np.ndarray | None = None) -> np.ndarray:
    """The first member of each one's cluster. ``dots``: inner products between the sums of the groups, ``n`` their sizes.

    One merge at a time, the nearest pair first, ties to the smaller places, while that is nearer than ``threshold``; each row
    remembers its nearest later one. ``limit`` is how near a group's nearest outside this part is: a group merges only
    while its nearest here is nearer than that; else it waits, and so does whatever is nearest to one that waits.
    Average linkage never brings a merged group nearer than its members were, so what merges here would merge anyhow."""
    k = len(n)
    dots, n, of = dots.astype(float), n.astype(float), np.arange(k)
    link = 1.0 - dots / np.outer(n, n)
    link[np.tril_indices(k)] = np.inf
    near = link.argmin(axis=1)
    best = link[np.arange(k), near]
    limit, waits = np.full(k, np.inf) if limit is None else limit.astype(float), np.zeros(k, bool)
    while k:
        a = int(best.argmin())
        if not best[a] < threshold:
            break
        b = int(near[a])
        if waits[a] or waits[b] or best[a] >= min(limit[a], limit[b]):
            waits[[a, b]] = True
            for i in (a, b):
                link[i, waits], link[waits, i] = np.inf, np.inf
            for i in np.flatnonzero(waits | (near == a) | (near == b)).tolist():
                near[i] = link[i].argmin()
                best[i] = link[i, near[i]]
            continue
        dots[a] += dots[b]
        dots[:, a] += dots[:, b]
        n[a] += n[b]
        limit[a] = min(limit[a], limit[b])
        of[of == b] = a
        alive = np.isfinite(n)
        n[b], alive[b] = np.inf, False
        link[b, :] = link[:, b] = np.inf
        best[b] = np.inf
        fresh = 1.0 - dots[a] / (n[a] * n)
        fresh[~alive] = np.inf
        link[:a, a], link[a, a + 1 :] = fresh[:a], fresh[a + 1 :]
        stale = np.flatnonzero(alive & ((near == a) | (near == b)))
        for i in {a, *stale.tolist()}:
            near[i] = link[i].argmin()
            best[i] = link[i, near[i]]
        closer = np.flatnonzero((link[:a, a] < best[:a]) | ((link[:a, a] == best[:a]) & (a < near[:a])))
        near[closer], best[closer] = a, link[closer, a]
    return of


def chained_linkage(sums: np.ndarray, n: np.ndarray, threshold: float) -> np.ndarray:
    """What :func:`average_linkage` gives without limits, from the ``sums`` of the groups and their sizes ``n``, in memory for these alone.

    A chain goes from a group to its nearest and on to that one's nearest, until two are nearest to each other; these merge, which reducibility
    allows at any time (Murtagh 1983). A group without a near one is done. There are at most three searches for each group, each one product
    of all means with one."""
    mean, n, of = sums / n[:, None], n.astype(float), np.arange(len(n))
    place, alive, chain = np.arange(len(n)), np.ones(len(n), bool), []
    while True:
        if not chain:
            left = np.flatnonzero(alive)
            if not len(left):
                return of
            if 2 * len(left) < len(alive):
                mean, n, place, alive, left = mean[left], n[left], place[left], alive[left], np.arange(len(left))
            chain = [int(left[0])]
        a = chain[-1]
        near = np.where(alive, mean @ mean[a], -np.inf)
        near[a] = -np.inf
        b = int(near.argmax())
        if not 1.0 - near[b] < threshold:
            alive[a] = False
            chain.pop()
        elif len(chain) > 1 and near[chain[-2]] >= near[b] - 1e-13:  # products of two rows may differ in their last digits by who asks
            a, b = sorted(chain[-2:])
            del chain[-2:]
            mean[a] = (n[a] * mean[a] + n[b] * mean[b]) / (n[a] + n[b])
            n[a] += n[b]
            alive[b] = False
            of[of == place[b]] = place[a]
        else:
            chain.append(b)


def in_parts(groups: DataFrame, pairs: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """``(cid, component)`` of the groups in components of ``pairs(a, b)`` up to ``most`` members and in larger ones. Clusters never reach beyond one."""
    labels = cut(connected_components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnRenamed("node", "cid"))
    size = labels.groupBy("component").agg(F.count("*").alias("size"))
    sized = labels.join(size, "component")
    return sized.filter(F.col("size") <= most).drop("size"), sized.filter(F.col("size") > most).drop("size")


def _named(labels: list[DataFrame], groups: DataFrame) -> DataFrame:
    """``(id, cluster_id)`` of all groups; those without label stay alone."""
    known = labels[0].unionByName(labels[1]) if len(labels) > 1 else labels[0]
    return groups.select(F.col("cid").alias("id")).join(known, "id", "left").select("id", F.coalesce("cluster_id", "id").alias("cluster_id"))


def _parts(groups: DataFrame, sketch: Column, seed: int) -> DataFrame:
    """``(cid, part)``: groups in parts of about half of TASK_MEMBERS, those with near ``sketch`` vectors together where possible. Another
    seed draws other lines between the parts."""
    marked = cut(groups.select("cid", sketch.alias("x")))
    n = marked.count()
    wanted = -(-2 * n // TASK_MEMBERS)
    drawn = marked.filter(F.pmod(F.xxhash64("cid", F.lit(seed)), F.lit(max(1, n // (20 * wanted)))) == 0).limit(40 * wanted).collect() if wanted > 1 else []
    if len(drawn) < 2:
        return marked.select("cid", F.pmod(F.xxhash64("cid", F.lit(seed)), F.lit(wanted)).alias("part"))
    sample = np.array([r["x"] for r in drawn])
    centres = cell_centres(sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-12), wanted)

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"cid": batch["cid"], "cell": (np.array(batch["x"].tolist()) @ centres.T).argmax(axis=1)})

    celled = cut(marked.mapInPandas(home, f"cid {groups.schema['cid'].dataType.simpleString()}, cell long"))
    sizes = celled.groupBy("cell").agg(F.ceil(F.count("*") / TASK_MEMBERS).cast("long").alias("k"))
    return celled.join(F.broadcast(sizes), "cell").select("cid", F.xxhash64("cell", F.pmod(F.xxhash64("cid", F.lit(seed)), F.col("k"))).alias("part"))  # a row a centre


def _moved(labels: DataFrame, moved: DataFrame) -> DataFrame:
    to = moved.select(F.col("old").alias("cluster_id"), "new")
    return cut(labels.join(to, "cluster_id", "left").select("id", F.coalesce("new", "cluster_id").alias("cluster_id")))


def _contracted(groups: DataFrame, nearest, inside, whole, merge, sketch: Column, most: int) -> DataFrame:
    """Average linkage of the groups of large components, until no two are near: ``(id, cluster_id)``.

    Each round deals the groups to parts and lets a task merge what is provably next inside its part (:func:`average_linkage` with the
    nearest outside as limit); two that are nearest to each other and that no part merged merge as well, so every round merges
    something. Merged groups are contracted to one, and the next round draws its parts anew; groups without a near one are
    done, and what is left of a component goes to one task as soon as it has ``most`` groups. ``groups(cid, n, component, ...)``; ``nearest(groups with part)``
    gives ``(cid, link, other, limit)``; ``inside(groups with part and limit)`` and ``whole(groups)`` give ``moved(old, new)``;
    ``merge(groups, moved)`` contracts.
    """
    labels, seed = groups.select(F.col("cid").alias("id"), F.col("cid").alias("cluster_id")), 0
    while True:
        seed += 1
        parts = cut(_parts(groups, sketch, seed))
        near = cut(nearest(groups.join(parts, "cid")))
        if not n_rows(near):
            return labels
        inner = cut(inside(groups.join(parts, "cid").join(near.select("cid", "limit"), "cid")))
        busy = inner.select(F.explode(F.array("old", "new")).alias("cid")).distinct()
        back = near.select(F.col("cid").alias("new"), F.col("other").alias("old"))
        mutual = near.select(F.col("cid").alias("old"), F.col("other").alias("new")).join(back, ["old", "new"]).filter("new < old")
        for end in ("old", "new"):
            mutual = mutual.join(busy.select(F.col("cid").alias(end)), end, "left_anti")
        moved = cut(inner.unionByName(mutual.select("old", "new")))
        labels = _moved(labels, moved)
        groups = cut(merge(groups.join(near.select("cid"), "cid", "left_semi"), moved))
        left = cut(groups.groupBy("component").agg(F.count("*").alias("k")))
        fits = groups.join(left.filter(F.col("k") <= most).select("component"), "component")
        labels = _moved(labels, cut(whole(fits)))
        groups = groups.join(left.filter(F.col("k") > most).select("component"), "component")
        if not n_rows(left.filter(F.col("k") > most)):
            return labels


def hac_average(vecs: DataFrame, threshold: float, mode: str | None = None) -> DataFrame:
    """Average-linkage clusters under cosine distance, merged while the linkage is below ``threshold``:
    ``(id, cluster_id)``.

    For unit vectors the average linkage of two clusters is 1 - dot(sums) / (n m), so a cluster is its sum and size. Only
    clusters joined by a pair of members below the threshold can merge, so the pairs are found once. Average linkage
    is reducible, so merging what is mutually nearest in any order gives what one merge at a time gives
    (Sumengen et al. 2021); ties go to the smaller ids. Components of those pairs are linked apart, each in one task up to
    CHAINED times TASK_MEMBERS (by chains beyond TASK_MEMBERS), else by contraction of parts; all give the same. No list of pairs is made but for ``mode`` ``lsh``. Equal vectors start
    as one. Null and zero vectors stay alone.
    """
    v = cut(unit(vecs))
    same = v.groupBy("v").agg(F.min("id").alias("cid"), F.count("*").alias("n"))
    groups = cut(same.select("cid", "n", F.transform("v", lambda x: x * F.col("n")).alias("s")))
    named = groups.select(F.col("cid").alias("id"), F.col("s").alias("v"))
    pairs = cut(cosine_pairs(named, threshold + 1e-6, mode).select("a", "b")) if mode == "lsh" else cosine_links(named, threshold + 1e-6)

    def merge(g: DataFrame, moved: DataFrame) -> DataFrame:
        ends = moved.select(F.col("old").alias("cid"), "new").unionByName(moved.select(F.col("new").alias("cid"), "new").distinct())
        met = g.join(ends, "cid")
        each = met.select("new", F.posexplode("s").alias("d", "x")).groupBy("new", "d").agg(F.sum("x").alias("x"))
        sums = each.groupBy("new").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda e: e["x"]).alias("s"))  # a vector's components
        sizes = met.groupBy("new").agg(F.sum("n").alias("n"), F.min("component").alias("component"))
        return g.join(ends.select("cid"), "cid", "left_anti").unionByName(sizes.join(sums, "new").withColumnRenamed("new", "cid"))

    def contract(held: DataFrame) -> DataFrame:
        return held.groupBy("part").applyInPandas(one_of_many, f"old {kind}, new {kind}")

    def one_of_many(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cid", ignore_index=True)
        sums, n, limit = np.array(pdf["s"].tolist()), pdf["n"].to_numpy(), pdf["limit"].to_numpy()
        first = chained_linkage(sums, n, threshold) if len(n) > matrix and np.isinf(limit).all() else average_linkage(sums @ sums.T, n, threshold, limit)
        gone, names = np.flatnonzero(first != np.arange(len(first))), pdf["cid"].to_numpy(object)
        return pd.DataFrame({"old": pd.Series(names[gone], dtype=object), "new": pd.Series(names[first[gone]], dtype=object)})

    def one_whole(pdf: pd.DataFrame) -> pd.DataFrame:
        return one_of_many(pdf.assign(limit=np.inf))

    def whole(held: DataFrame) -> DataFrame:
        return held.groupBy("component").applyInPandas(one_whole, f"old {kind}, new {kind}")

    matrix, most = TASK_MEMBERS, CHAINED * TASK_MEMBERS
    small, large = in_parts(groups, pairs, most)
    kind = groups.schema["cid"].dataType.simpleString()
    labels = [whole(groups.join(small, "cid")).select(F.col("old").alias("id"), F.col("new").alias("cluster_id"))]
    if large.limit(1).count():
        labels.append(_contracted(cut(groups.join(large, "cid")), lambda g: nearest_groups(g, threshold), contract, whole, merge, F.col("s"), most))
    labels = _named(labels, groups).select(F.col("id").alias("rep"), "cluster_id")
    reps = v.join(same.select("v", F.col("cid").alias("rep")), "v").select("id", "rep")
    found = reps.join(labels, "rep").select("id", "cluster_id")
    return vecs.select("id").join(found, "id", "left").select("id", F.coalesce("cluster_id", "id").alias("cluster_id"))


def cluster_tfidf(articles: DataFrame, stop_words: list[str], threshold: float = DEFAULT.tfidf_distance) -> DataFrame:
    """Average-linkage clusters of TF-IDF vectors, for runs without vectors: ``(id, cluster_id)``.

    Sums are kept sparse, as terms and weights of a group. Distances reach 1 where no term is shared, so pairs without a
    common term never come below a threshold under 1. Articles without terms stay alone, equal ones start as one. Small components
    of what is near are linked in one task each, large ones by contraction, as in :func:`hac_average`; no list of pairs is made.
    """
    groups, reps = tfidf_groups(cut(tfidf_terms(articles, stop_words)))
    kind = groups.schema["cid"].dataType.simpleString()

    def merge(g: DataFrame, moved: DataFrame) -> DataFrame:
        ends = cut(moved.select(F.col("old").alias("cid"), "new").unionByName(moved.select(F.col("new").alias("cid"), "new").distinct()))
        met = g.join(ends, "cid")
        each = met.select("new", F.explode(F.arrays_zip("t", "w")).alias("e")).groupBy("new", "e.t").agg(F.sum("e.w").alias("w"))
        listed = each.groupBy("new").agg(F.sort_array(F.collect_list(F.struct("t", "w"))).alias("e"))  # ``features`` at most
        sums = listed.select("new", F.transform("e", lambda x: x["t"]).alias("t"), F.transform("e", lambda x: x["w"]).alias("w"))
        sizes = met.groupBy("new").agg(F.sum("n").alias("n"), F.min("component").alias("component"))
        return g.join(ends.select("cid"), "cid", "left_anti").unionByName(sizes.join(sums, "new").withColumnRenamed("new", "cid"))

    @F.pandas_udf("array<double>")
    def sketch(t: pd.Series, w: pd.Series) -> pd.Series:
        """Sums of weights by drawn signs of the terms: near texts have near sketches. They only decide on parts."""
        bits = np.arange(SKETCH, dtype=np.uint64)
        mixed = lambda x: (np.asarray(x, np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        sign = lambda x: 1.0 - 2.0 * ((mixed(x)[:, None] >> (bits + np.uint64(20))) & np.uint64(1)).astype(float)
        return pd.Series([np.asarray(y) @ sign(x) for x, y in zip(t, w, strict=True)])

    def linked(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cid", ignore_index=True)
        row, term, weight = np.repeat(np.arange(len(pdf)), pdf["t"].str.len()), np.concatenate(pdf["t"].tolist()), np.concatenate(pdf["w"].tolist())
        dots, order = np.zeros((len(pdf), len(pdf))), np.argsort(term, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(term[order])) + 1):
            dots[np.ix_(row[at], row[at])] += np.outer(weight[at], weight[at])
        first = average_linkage(dots, pdf["n"].to_numpy(), threshold, pdf["limit"].to_numpy())
        gone, names = np.flatnonzero(first != np.arange(len(first))), pdf["cid"].to_numpy(object)
        return pd.DataFrame({"old": pd.Series(names[gone], dtype=object), "new": pd.Series(names[first[gone]], dtype=object)})

    def one_whole(pdf: pd.DataFrame) -> pd.DataFrame:
        return linked(pdf.assign(limit=np.inf))

    def inside(held: DataFrame) -> DataFrame:
        return held.groupBy("part").applyInPandas(linked, f"old {kind}, new {kind}")

    def whole(held: DataFrame) -> DataFrame:
        return held.groupBy("component").applyInPandas(one_whole, f"old {kind}, new {kind}")

    small, large = in_parts(groups, tfidf_links(groups, threshold), TASK_MEMBERS)
    labels = [whole(groups.join(small, "cid")).select(F.col("old").alias("id"), F.col("new").alias("cluster_id"))]
    if large.limit(1).count():
        labels.append(_contracted(cut(groups.join(large, "cid")), lambda g: tfidf_nearest(g, threshold), inside, whole, merge, sketch("t", "w"), TASK_MEMBERS))
    found = reps.join(_named(labels, groups).withColumnRenamed("id", "cid"), "cid").select("id", "cluster_id")
    return articles.select("id").join(found, "id", "left").select("id", F.coalesce("cluster_id", "id").alias("cluster_id"))


def ordered(members: DataFrame, articles: DataFrame, *columns: str) -> DataFrame:
    """Members with article columns and their place ``ord`` in the article order: newest first, then the smaller id."""
    place = F.struct((-F.coalesce(F.unix_micros("published"), F.lit(-(1 << 62)))).alias("t"), F.col("id").alias("i"))
    return members.join(articles.select("id", place.alias("ord"), *[c for c in columns if c != "id"]), "id")


def first_wins_list(rows: DataFrame, key: str, array: str, limit: int) -> DataFrame:
    """``(key, array)``: the entries of all rows' arrays in the order (ord, place), each once whatever its case."""
    each = rows.select(key, "ord", F.posexplode(array).alias("pos", "e")).withColumn("low", F.lower(F.trim("e"))).filter("low <> ''")
    first = each.groupBy(key, "low").agg(F.min(F.struct("ord", "pos", "e")).alias("f"))
    # the first ``limit`` of each task, then of all, so that no row gathers more
    first = first.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("f"))).filter(F.col("r") <= limit)
    listed = F.transform(F.sort_array(F.collect_list("f")), lambda f: f["e"])
    return first.groupBy(key).agg(F.slice(listed, 1, limit).alias(array))


def merge_fingerprints(rows: DataFrame, key: str) -> DataFrame:
    """A1: one merged fingerprint per ``key`` of rows ``(key, ord, fp)``: ``(key, event_fingerprint)``."""
    parts = rows.select(key, "ord", "fp.entities", "fp.actions", "fp.sources", "fp.time_bucket", F.lit(None).alias("_"))
    base = parts.groupBy(key).agg(F.min("time_bucket").alias("lo"), F.max("time_bucket").alias("hi"))
    sources = parts.select(key, F.explode("sources").alias("s")).filter("s <> ''").groupBy(key).agg(F.array_sort(F.collect_set("s")).alias("sources"))
    none = F.array().cast("array<string>")
    joined = base.join(first_wins_list(parts, key, "entities", 16), key, "left").join(first_wins_list(parts, key, "actions", 10), key, "left").join(sources, key, "left")
    joined = joined.withColumns({c: F.coalesce(c, none) for c in ("entities", "actions", "sources")})
    ident = fingerprint_hash(F.col("entities"), F.col("actions"), [F.col("lo"), F.col("hi")], F.col("sources"), 10, 8)
    made = F.struct(
        ident.alias("hash"), "entities", "actions", F.col("lo").alias("time_bucket"), "sources", F.struct(F.col("lo").alias("start"), F.col("hi").alias("end")).alias("time_window")
    )
    return joined.select(key, made.alias("event_fingerprint"))


def vector_sums(members: DataFrame, vecs: DataFrame) -> DataFrame:
    """``(cluster_id, n, s, squares)``: sums per component and of squared lengths, from partial sums of each task."""
    each = members.join(vecs.select("id", "v"), "id").select("cluster_id", F.posexplode("v").alias("d", "x"))
    dims = each.groupBy("cluster_id", "d").agg(F.sum(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"), F.sum(F.col("x").cast("double") * F.col("x")).alias("q"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda e: e["x"])
    return dims.groupBy("cluster_id").agg(F.max("n").alias("n"), listed.alias("s"), F.sum("q").alias("squares"))


def centroids(members: DataFrame, vecs: DataFrame) -> DataFrame:
    """A2: ``(cluster_id, centroid)``, the mean at length one."""
    mean = F.transform("s", lambda x: x / F.col("n"))
    return vector_sums(members, vecs).select("cluster_id", vec_normalize(mean).alias("centroid"))


def cohesion(members: DataFrame, vecs: DataFrame) -> DataFrame:
    """A3: ``(cluster_id, cohesion)``, the mean inner product of a cluster's pairs; 1 for single members. Linear: the sum
    over pairs is (|sum|^2 - sum of squares) / 2."""
    s = vector_sums(members, vecs)
    pairs = F.col("n") * (F.col("n") - 1)
    return s.select("cluster_id", F.when(F.col("n") < 2, 1.0).otherwise((vec_dot(F.col("s"), F.col("s")) - F.col("squares")) / pairs).alias("cohesion"))


def confidence_of(cohesion_: Column, sources: Column) -> Column:
    """A4's formula."""
    score = 0.4 + 0.4 * clamp01(cohesion_) + 0.2 * F.least(sources / 6.0, F.lit(1.0))
    return F.bround(F.greatest(F.lit(0.3), F.least(F.lit(0.98), score)), 3)


def cluster_confidence(members: DataFrame, articles: DataFrame, vecs: DataFrame | None) -> DataFrame:
    """A4: ``(cluster_id, cohesion, cluster_confidence)``; without vectors the cohesion counts as 1."""
    named = members.join(articles.select("id", "source"), "id").groupBy("cluster_id").agg(F.count_distinct(F.nullif("source", F.lit(""))).alias("sources"))
    held = named.withColumn("cohesion", F.lit(1.0)) if vecs is None else named.join(cohesion(members, vecs), "cluster_id", "left").withColumn("cohesion", F.coalesce("cohesion", F.lit(1.0)))
    return held.select("cluster_id", "cohesion", confidence_of(F.col("cohesion"), F.col("sources")).alias("cluster_confidence"))


def stage_a_pairs(clusters: DataFrame, config: FusionConfig = DEFAULT, mode: str | None = None) -> DataFrame:
    """``(a, b, sim, fp)`` of clusters ``(cluster_id, centroid, event_fingerprint)`` that merge.

    Candidates are lossless: a fingerprint alone merges only where entities have a certain Jaccard similarity, the other rules
    need a similarity of at least ``stage_a_similarity``.
    """
    near = cosine_pairs(clusters.select(F.col("cluster_id").alias("id"), F.col("centroid").alias("v")), 1 - config.stage_a_similarity + 1e-6, mode)
    jaccard = (config.stage_a_fingerprint + 0.18 - 0.45) / 0.55  # what actions and time leave for entities to give
    named = shared_entity_pairs(clusters.select(F.col("cluster_id").alias("id"), F.col("event_fingerprint.entities").alias("entities")), jaccard)
    scored = scored_pairs(near.select("a", "b").unionByName(named).distinct(), clusters)
    strong = config.stage_a_similarity
    rule = (
        ((F.col("sim") >= strong) & (F.col("fp") >= config.stage_a_fingerprint)) | (F.col("sim") >= strong + 0.08) | (F.col("fp") >= config.stage_a_fingerprint + 0.18)
    )
    return scored.filter(rule)


def scored_pairs(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """``sim`` (inner product of centroids, 0 without) and ``fp`` of pairs ``(a, b)``."""
    side = lambda x, i: clusters.select(F.col("cluster_id").alias(x), F.col("centroid").alias(f"c{i}"), F.col("event_fingerprint").alias(f"f{i}"))
    both = pairs.join(side("a", 1), "a").join(side("b", 2), "b")
    return both.select("a", "b", F.coalesce(vec_dot(F.col("c1"), F.col("c2")), F.lit(0.0)).alias("sim"), fingerprint_similarity(F.col("f1"), F.col("f2")).alias("fp"))


def stage_a_merge(members: DataFrame, articles: DataFrame, vecs: DataFrame, config: FusionConfig = DEFAULT) -> DataFrame:
    """Members with the clusters that Stage A joins under one id: ``(cluster_id, id)``."""
    prints = merge_fingerprints(ordered(members, articles, "event_fingerprint").select("cluster_id", "ord", F.col("event_fingerprint").alias("fp")), "cluster_id")
    clusters = cut(prints.join(centroids(members, vecs), "cluster_id", "left"))
    edges = stage_a_pairs(clusters, config).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    labels = connected_components(edges).select(F.col("node").alias("cluster_id"), "component")
    return members.join(labels, "cluster_id", "left").select(F.coalesce("component", "cluster_id").alias("cluster_id"), "id")


def cluster_stats(members: DataFrame) -> DataFrame:
    """Number of clusters, of those with several articles, and the largest size."""
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("n"))
    many = F.when(F.col("n") > 1, F.col("n"))
    return sizes.agg(F.count("*").alias("total"), F.count(many).alias("multi"), F.coalesce(F.max(many), F.lit(0)).alias("max_size"))


def largest_clusters(members: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` largest clusters of several articles."""
    return members.groupBy("cluster_id").agg(F.count("*").alias("size")).filter("size > 1").orderBy(F.desc("size"), "cluster_id").limit(n)
