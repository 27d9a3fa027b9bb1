"""Operators of the fusion engine against small models."""

import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwire.operators import cluster as cl
from loomwire.operators import dedup as dd
from loomwire.operators import feed as fd
from loomwire.operators import graph
from loomwire.operators import ingest as ig
from loomwire.operators import pages as pg
from loomwire.operators import simjoin as sj
from loomwire.operators.graph import connected_components
from loomwire.operators.ranking import rank_in_groups
from loomwire.plans import queries as qs
from loomwire.schemas import STATE
from loomwire.sources.state import State, current_version, empty_state, load_state, save_state

RUN = F.lit


def test_sources(spark):
    rows = [("A Feed", None, "http://a/feed", None), ("B", "crawl", None, ["http://b/"]), ("C", "rss", None, None), ("D", "tape", "http://d", None), (None, None, None, ["http://e/"])]
    good, bad = ig.normalize_sources(spark.createDataFrame(rows, "name string, type string, url string, start_urls array<string>"))
    found = {r["id"]: r for r in good.collect()}
    assert set(found) == {"a-feed", "b", "source"} and found["a-feed"]["max_items"] == 30 and found["source"]["type"] == "crawl"
    assert {r["reason"] for r in bad.collect()} == {"no feed_url", "unknown type"}


ARTICLE = "id string, source_id string, source_host string, published timestamp, has_offset boolean, dedup_key string, canonical_url string, link string, title string, content_hash string"


def articles(spark, n=60, seed=1):
    rng = random.Random(seed)
    words = ["spring", "show", "paris", "milan", "brand", "opens", "store"]
    rows = []
    for i in range(n):
        title = " ".join(rng.choice(words) for _ in range(rng.randint(1, 3)))
        when = dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randint(0, 400))
        rows.append((f"a{i:03d}", rng.choice(["s1", "s2", None]), rng.choice(["h1", "h2"]), when, rng.random() < 0.5, rng.choice(["", f"k{rng.randint(0, 30)}"]), "", "", title, rng.choice(["", f"c{rng.randint(0, 20)}"])))
    return spark.createDataFrame(rows, ARTICLE), rows


def grams(title):
    return {title[i : i + 2] for i in range(len(title) - 1)}


def same(a, b):
    if not (a[1] == b[1] or a[2] == b[2]) or abs((a[3] - b[3]).total_seconds()) > 3 * 86400 or a[4] != b[4]:
        return False
    x, y = grams(a[8]), grams(b[8])
    return bool(a[9] and a[9] == b[9]) or a[8] == b[8] or len(x & y) / len(x | y) > 0.6


def test_dedup_equals_one_scan(spark):
    df, rows = articles(spark)
    kept, keys, dropped = [], set(), {}
    for r in sorted(rows, key=lambda r: (-r[3].timestamp(), r[0])):
        if r[5] and r[5] in keys:
            dropped[r[0]] = "key"
        elif any(same(r, k) for k in kept):
            dropped[r[0]] = "fuzzy"
        else:
            kept.append(r)
            keys |= {r[5]} - {""}
    got, gone = dd.dedup_articles(df)
    assert {r["id"] for r in got.collect()} == {r[0] for r in kept}
    assert {r["id"]: r["reason"] for r in gone.collect()} == dropped
    pairs = {tuple(sorted((a[0], b[0]))) for a, b in itertools.combinations(rows, 2) if same(a, b)}
    assert {tuple(sorted((r["id_hi"], r["id_lo"]))) for r in dd.probable_same_pairs(df).collect()} == pairs


def scanned(rows):
    """The scan newest first over ``(id, hour, title, content_hash, key)`` of one source, by memory of what each value last kept."""
    kept, dropped = [], {}
    for r in sorted(rows, key=lambda r: (-r[1], r[0])):
        hit = [k for k in kept[-400:] if k[1] - r[1] <= 72 and (k[2] == r[2] or k[3] == r[3])]
        if r[4] in {k[4] for k in kept}:
            dropped[r[0]] = "key"
        elif hit:
            dropped[r[0]] = "fuzzy"
        else:
            kept.append(r)
    return {r[0] for r in kept}, dropped


@pytest.mark.parametrize("hours, step, task_rows", [(48 * 24, 24, 100_000), (2 * 365 * 24, 1, 100_000), (60 * 24, 1, 100)])
def test_dedup_ends_on_a_recurring_title(spark, hours, step, task_rows):
    """A daily title, an hourly one over two years, and a component swept in many slices."""
    begin = dt.datetime(2024, 1, 1)
    rows = [(f"a{h:06d}", h, "Daily news in brief" if h % 5 else "Weather report for the coast", f"c{h // 7}" if h % 3 == 0 else f"x{h}", f"k{h // 90}" if h % 11 == 0 else f"u{h}") for h in range(0, hours, step)]
    df = spark.createDataFrame(
        [(i, "s", "s.org", begin + dt.timedelta(hours=h), True, k, "", "", t, c) for i, h, t, c, k in rows],
        ARTICLE,
    )
    kept, dropped = dd.dedup_articles(df, task_rows)
    wanted_kept, wanted_dropped = scanned(rows)
    assert {r["id"] for r in kept.select("id").collect()} == wanted_kept
    assert {r["id"]: r["reason"] for r in dropped.collect()} == wanted_dropped


def test_nearest_earlier_of_what_is_probably_the_same(spark):
    df, rows = articles(spark, 80, 5)
    want: dict = {}
    for a, b in itertools.permutations(rows, 2):
        if (-a[3].timestamp(), a[0]) > (-b[3].timestamp(), b[0]) and abs((a[3] - b[3]).total_seconds()) <= 3 * 86400 and a[4] == b[4]:
            x, y = grams(a[8]), grams(b[8])
            shared = {"hash": a[9] and a[9] == b[9], "title": a[8] == b[8], "similar": len(x & y) / len(x | y) > 0.6}
            for by, same_scope in (("source", a[1] == b[1]), ("host", a[2] == b[2])):
                for kind in (k for k, v in shared.items() if v and same_scope):
                    want.setdefault((a[0], by, kind), []).append((-b[3].timestamp(), b[0]))
    got = {(r["id"], r["scope"], r["kind"]): (r["n_earlier"], r["nearest"]) for r in dd.probable_same_nearest(df).collect()}
    assert got == {k: (len(v), max(v)[1]) for k, v in want.items()} and len(got) > 40
    many = spark.range(10_000).selectExpr("concat('i', lpad(id, 6, '0')) AS id", "'s' AS source_id", "'h' AS source_host", "timestamp_seconds(1704067200 + id) AS published", "true AS has_offset", "'' AS dedup_key", "'' AS canonical_url", "'' AS link", "'The same title' AS title", "'' AS content_hash")
    found = dd.probable_same_nearest(many).filter("scope = 'host' AND kind = 'title'").agg(F.sum("n_earlier").alias("n"), F.count("*").alias("rows")).first()
    assert (found["n"], found["rows"]) == (10_000 * 9_999 // 2, 9_999)


def test_dedup_of_nothing_shared_and_of_nothing(spark):
    df, _ = articles(spark)
    kept, dropped = dd.dedup_articles(df.limit(1))
    assert kept.count() == 1 and dropped.count() == 0
    kept, dropped = dd.dedup_articles(df.limit(0))
    assert kept.count() == 0 and dropped.count() == 0


def slow_hac(x, t):
    groups = [[i] for i in range(len(x))]
    link = lambda a, b: 1 - np.mean([[x[i] @ x[j] for j in b] for i in a])
    while len(groups) > 1:
        d, i, j = min((link(a, b), i, j) for (i, a), (j, b) in itertools.combinations(enumerate(groups), 2))
        if d >= t:
            break
        groups[i] += groups.pop(j)
    return {frozenset(g) for g in groups}


def test_average_linkage(spark, monkeypatch, most=2048):
    monkeypatch.setattr(cl, "TASK_MEMBERS", most)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((5, 8))[rng.integers(0, 5, 24)] + 0.5 * rng.standard_normal((24, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[5] = x[6]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, [0.0] * 8), (98, None)], "id long, v array<double>")
    got: dict = {}
    for r in cl.hac_average(df, 0.4).collect():
        got.setdefault(r["cluster_id"], set()).add(r["id"])
    assert {frozenset(g) for g in got.values()} == slow_hac(x, 0.4) | {frozenset([99]), frozenset([98])}


def test_average_linkage_by_contraction(spark, monkeypatch):
    test_average_linkage(spark, monkeypatch, 3)


def test_merges_within_limits_are_merges_without(spark):
    """Whatever a part merges under its limits is a merge of the whole, for any division into parts."""
    rng = np.random.default_rng(12)
    for _ in range(40):
        x = rng.standard_normal((8, 6))[rng.integers(0, 8, 40)] + 0.5 * rng.standard_normal((40, 6))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        whole = cl.average_linkage(x @ x.T, np.ones(40), 0.4)
        part = rng.integers(0, 3, 40)
        for p in range(3):
            at = np.flatnonzero(part == p)
            limit = (1 - x[at] @ x[part != p].T).min(axis=1)
            first = cl.average_linkage(x[at] @ x[at].T, np.ones(len(at)), 0.4, limit)
            assert (whole[at] == whole[at[first]]).all()


def test_a_chained_component_ends_in_few_rounds(spark, monkeypatch):
    """Vectors along a closed curve, each near the next: one component of many parts, here of ten times a part's size; the parts give
    what one matrix gives on a piece of it."""
    rng, n = np.random.default_rng(6), 4000
    monkeypatch.setattr(cl, "TASK_MEMBERS", 400)
    turns = (np.arange(n) + rng.uniform(-0.4, 0.4, n)) * 2 * np.pi / n
    x = np.stack([f(k * turns) / np.sqrt(3) for k in (1, 7, 19) for f in (np.cos, np.sin)], axis=1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").cache()
    rounds = []
    drawn = cl._parts
    monkeypatch.setattr(cl, "_parts", lambda *a: rounds.append(1) or drawn(*a))
    got = cl.hac_average(df, 0.002).toPandas().sort_values("id")["cluster_id"].to_numpy()
    assert 0 < len(rounds) < 20
    sums = {c: x[got == c] for c in np.unique(got)}
    means = np.array([v.mean(axis=0) for v in sums.values()])
    apart = 1 - means @ means.T
    np.fill_diagonal(apart, 1)
    assert apart.min() >= 0.002 - 1e-9 and len(sums) < n / 4
    monkeypatch.setattr(cl, "TASK_MEMBERS", 100)
    few = df.filter("id < 700").cache()
    chosen = cl.hac_average(few, 0.002).toPandas().sort_values("id")["cluster_id"].to_numpy()
    assert (chosen == cl.average_linkage(x[:700] @ x[:700].T, np.ones(700), 0.002)).all()


def test_large_components_need_no_list_of_pairs(spark, monkeypatch):
    """One direction, of which all pairs are near: links are fewer than rows, and clusters are those of one matrix."""
    def never(*_):
        raise AssertionError("a list of pairs")

    rng, n = np.random.default_rng(17), 150
    x = np.ones(16) + 0.7 * rng.standard_normal((n, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").cache()
    assert sj.cosine_pairs(df, 0.5).count() > 4 * n and sj.cosine_links(df, 0.5).count() < n
    monkeypatch.setattr(cl, "TASK_MEMBERS", 60)
    monkeypatch.setattr(cl, "cosine_pairs", never)
    got = cl.hac_average(df, 0.3).toPandas().sort_values("id")["cluster_id"].to_numpy()
    assert (got == cl.average_linkage(x @ x.T, np.ones(n), 0.3)).all() and 1 < len(set(got)) < n


def test_chains_give_what_a_matrix_gives(spark, monkeypatch):
    """Groups of several sizes; and a component of some parts' size is linked in one task, without any round of contraction."""
    rng = np.random.default_rng(23)
    for k in range(40):
        x = rng.standard_normal((6, 6))[rng.integers(0, 6, 60)] + 0.5 * rng.standard_normal((60, 6))
        n = rng.integers(1, 4, 60) if k % 2 else np.ones(60, int)
        sums = x / np.linalg.norm(x, axis=1, keepdims=True) * n[:, None]
        assert (cl.chained_linkage(sums, n, 0.4) == cl.average_linkage(sums @ sums.T, n, 0.4)).all()

    def never(*_):
        raise AssertionError("a round of contraction")

    x = np.ones(16) + 0.7 * rng.standard_normal((300, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    monkeypatch.setattr(cl, "TASK_MEMBERS", 60)
    monkeypatch.setattr(cl, "_contracted", never)
    got = cl.hac_average(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>"), 0.3).toPandas().sort_values("id")["cluster_id"].to_numpy()
    assert (got == cl.average_linkage(x @ x.T, np.ones(300), 0.3)).all() and 1 < len(set(got)) < 300


def test_nearest_of_rows_on_both_sides():
    link = np.array([[np.inf, 0.2, 0.1], [np.inf, np.inf, 0.3], [np.inf] * 3])
    every, found = np.arange(3), sj.Nearest(np.array(["a", "b", "c"]), np.array([1, 1, 2]))
    found.meet(every, every, link)
    assert found.found().to_numpy().tolist() == [["a", 0.1, "c", 0.1], ["b", 0.2, "a", 0.3], ["c", 0.1, "a", 0.1]]


def test_pair_scores_kept_up_to_date(spark):
    """Five runs in which topics come, change and go: the stored scores are those of a whole computation."""
    from loomwire.operators import topics as tp

    rng, begin = np.random.default_rng(23), dt.datetime(2024, 1, 1)
    kind = "topic_id string, centroid array<double>, event_fingerprint struct<hash: string, entities: array<string>, actions: array<string>, time_bucket: timestamp, sources: array<string>>"
    base = rng.standard_normal((12, 8))

    def made(i):
        v = base[int(rng.integers(0, 12))] + 0.5 * rng.standard_normal(8)
        v = (v / np.linalg.norm(v)).tolist() if rng.random() < 0.9 else None
        return f"t{i}", v, ("h", [f"E{int(j)}" for j in set(rng.integers(0, 25, 3).tolist())], [], begin + dt.timedelta(hours=6 * int(rng.integers(0, 9))), ["s"])

    rows = {i: made(i) for i in range(80)}
    pairs, scored = spark.createDataFrame([], "a string, b string, score double"), spark.createDataFrame([], "topic_id string, print long")
    for turn in range(5):
        topics = spark.createDataFrame(list(rows.values()), kind).cache()
        pairs = tp.updated_pair_scores(topics, pairs, scored).cache()
        got = {(r["a"], r["b"]): round(r["score"], 9) for r in pairs.collect()}
        assert got == {(r["a"], r["b"]): round(r["score"], 9) for r in tp.topic_pair_scores(topics).collect()} and len(got) > 50
        scored = tp.scored_topics(topics).cache()
        for i in rng.choice(list(rows), 6, replace=False).tolist():
            rows[i] = made(i)
        for i in rng.choice(list(rows), 4, replace=False).tolist():
            del rows[i]
        rows |= {100 * (turn + 1) + i: made(100 * (turn + 1) + i) for i in range(5)}


def test_best_topics_of_many(spark):
    """Assignment among 3,000 topics equals a look at every topic."""
    from loomwire.functions.fingerprints import fingerprint_similarity
    from loomwire.functions.times import bucket_score
    from loomwire.functions.vectors import clamp01, vec_dot
    from loomwire.operators import topics as tp

    rng = np.random.default_rng(14)
    base, begin = rng.standard_normal((60, 16)), dt.datetime(2024, 1, 1)

    def row(i, prefix):
        k = int(rng.integers(0, 60))
        v = base[k] + rng.uniform(0.3, 2.0) * rng.standard_normal(16)
        v = (v / np.linalg.norm(v)).tolist() if i % 17 else None
        entities = [f"E{(k + int(j)) % 40}" for j in rng.integers(0, 4, int(rng.integers(0, 4)))]
        return f"{prefix}{i}", begin + dt.timedelta(hours=int(rng.integers(0, 90))), v, ("h", entities, ["opens"][: int(rng.integers(0, 2))], begin + dt.timedelta(hours=6 * int(rng.integers(0, 15))), ["s"])

    kind = "published timestamp, {} array<double>, event_fingerprint struct<hash: string, entities: array<string>, actions: array<string>, time_bucket: timestamp, sources: array<string>>"
    topics = spark.createDataFrame([row(i, "t") for i in range(3000)], "topic_id string, " + kind.format("centroid")).cache()
    news = spark.createDataFrame([row(i, "a") for i in range(150)], "article_key string, " + kind.format("v")).drop("published").cache()
    got = {tuple(r) for r in tp.assign_to_topics(news, topics).select("article_key", "topic_id").collect()}
    both = news.withColumnRenamed("event_fingerprint", "af").crossJoin(topics.withColumnRenamed("event_fingerprint", "tf"))
    score = 0.62 * F.coalesce(clamp01(vec_dot(F.col("centroid"), F.col("v"))), F.lit(0.0)) + 0.28 * fingerprint_similarity(F.col("tf"), F.col("af")) + 0.10 * bucket_score(F.col("tf.time_bucket"), F.col("af.time_bucket"))
    best = both.select("article_key", F.struct((-score).alias("s"), (-F.unix_micros("published")).alias("t"), "topic_id").alias("b")).groupBy("article_key").agg(F.min("b").alias("b"))
    want = {(r["article_key"], r["b"]["topic_id"]) for r in best.collect() if -r["b"]["s"] >= 0.63}
    assert got == want and len(want) > 40


def test_sign_hashing_recall(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 32))
    x = base[rng.integers(0, 40, 400)] + 0.6 * rng.standard_normal((400, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").cache()
    exact = {(r["a"], r["b"]) for r in sj.cosine_pairs(df, 0.34, "exact").collect()}
    near = {(r["a"], r["b"]) for r in sj.cosine_pairs(df, 0.34, "lsh").collect()}
    assert near <= exact and len(near) >= 0.95 * len(exact) > 0


def test_cosine_pairs_default_is_exact_at_any_size(spark):
    rng = np.random.default_rng(21)
    rows = []
    for k in range(150):  # pairs just below the threshold
        x, y = rng.standard_normal(32), rng.standard_normal(32)
        x /= np.linalg.norm(x)
        y -= (y @ x) * x
        y /= np.linalg.norm(y)
        rows += [(2 * k, x.tolist()), (2 * k + 1, (0.67 * x + np.sqrt(1 - 0.67**2) * y).tolist())]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    found = {(r["a"], r["b"]) for r in sj.cosine_pairs(df, 0.34, n=60_000).collect()}  # as if of a large table
    assert {(2 * k, 2 * k + 1) for k in range(150)} <= found
    assert found == {(r["a"], r["b"]) for r in sj.cosine_pairs(df, 0.34, "exact").collect()}


def test_cosine_pairs_meet_by_cells(spark, monkeypatch):
    """Small blocks and a cell of more rows than a block; compared with all pairs, and most pairs are not looked at."""
    monkeypatch.setattr(sj, "BLOCK", 40)
    rng = np.random.default_rng(31)
    x = rng.standard_normal((30, 24))[rng.integers(0, 30, 600)] + 0.25 * rng.standard_normal((600, 24))
    x[:130] = x[0] + 1e-3 * rng.standard_normal((130, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 24)], "id long, v array<double>").cache()
    close = lambda t: {(i, j) for i, j in zip(*np.nonzero(1 - x @ x.T < t), strict=True)}
    for t in (0.1, 0.34, 1.2):
        got = [(r["a"], r["b"]) for r in sj.cosine_pairs(df, t).collect()]
        assert len(got) == len(set(got)) and set(got) == {(i, j) for i, j in close(t) if i < j}
    assert sj.cosine_join_cost(df, 0.1) < 0.2 * 600 * 599 / 2
    ones, others = df.filter("id < 200 OR id >= 900"), df.filter("id >= 150")
    got = [(r["a"], r["b"]) for r in sj.cosine_pairs_between(ones, others, 0.34).collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i, j in close(0.34) if i < 200 and j >= 150}
    assert sj.cosine_pairs(df.limit(0), 0.34).count() == 0 and sj.cosine_pairs(df.filter("id >= 900"), 0.34).count() == 0


def test_a_task_returns_pairs_strip_by_strip(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(sj, "STRIP", 8)
    rows = pd.DataFrame({"id": range(40), "v": [[1.0, 0.0]] * 40, "cell": 0, "i": 0, "j": 0})
    cells = sj.Cells(np.array([[1.0, 0.0]]), np.zeros(1), np.zeros(1, int), np.ones(1, int))
    frames = list(sj._meet(cells, 0.34, False, "pairs")(iter([rows.assign(back=False), rows.assign(back=True)])))
    assert sum(map(len, frames)) == 40 * 39 // 2 and max(map(len, frames)) <= 8 * 40


def test_forest_of_dense_hits_takes_few_rounds():
    """The parts are those of all hits; where everything hits everything, rows are relabelled a few times and not once each."""
    rng = np.random.default_rng(5)
    for share in (0.002, 0.02, 1.0):
        trees, hit = sj.Forest(np.arange(400)), rng.random((200, 200)) < share
        trees.meet(np.arange(200), np.arange(200, 400), hit)
        up = list(range(400))
        for _ in range(400):
            for i, j in zip(*np.nonzero(hit), strict=True):
                up[i] = up[j + 200] = min(up[i], up[j + 200])
            if share == 1.0:
                break
        assert trees.top.tolist() == up or share == 1.0 and set(trees.top) == {0}


def test_rows_are_copied_to_a_bounded_number_of_blocks(spark, monkeypatch):
    """A table of many blocks has larger ones, and the few far rows of a centre widen no cell but their own."""
    monkeypatch.setattr(sj, "BLOCK", 8)
    monkeypatch.setattr(sj, "BLOCKS", 4)
    made, work = [], sj._meet
    monkeypatch.setattr(sj, "_meet", lambda cells, *a: made.append(cells) or work(cells, *a))
    rng = np.random.default_rng(7)
    x = rng.standard_normal((10, 16))[rng.integers(0, 10, 800)] + 0.3 * rng.standard_normal((800, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = {(r["a"], r["b"]) for r in sj.cosine_pairs(df, 0.2).collect()}
    assert got == {(i, j) for i, j in zip(*np.nonzero(1 - x @ x.T < 0.2), strict=True) if i < j}
    assert (made[0].first + made[0].parts).max() < 30 and len(made[0].radius) == 4 * len(made[0].centres)


def test_nearest_centres_in_strips():
    """What a batch needs does not grow with rows times centres (160 MB here)."""
    import tracemalloc

    rng = np.random.default_rng(3)
    x, centres = rng.normal(size=(10_000, 8)), rng.normal(size=(2000, 8))
    x, centres = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (x, centres))
    tracemalloc.start()
    cell, angle = sj.nearest_centres(x, centres)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6
    assert np.allclose(np.cos(angle), np.einsum("ij,ij->i", x, centres[cell])) and np.allclose(np.cos(angle[:50]), (x[:50] @ centres.T).max(axis=1))


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(3, None)]
    up = {i: i for e in edges for i in e if i is not None}
    for _ in up:
        for a, b in edges:
            if b is not None:
                up[a] = up[b] = min(up[a], up[b])
    df = spark.createDataFrame(edges, "src long, dst long")
    nodes = spark.createDataFrame([(n,) for n in [*up, 500]], "node long")
    assert {r["node"]: r["component"] for r in connected_components(df, nodes).collect()} == up | {500: 500}
    assert connected_components(df.limit(0)).count() == 0
    named = spark.createDataFrame([("b", "a"), ("c", "b")], "src string, dst string")
    assert {r["node"]: r["component"] for r in connected_components(named).collect()} == dict.fromkeys("abc", "a")


def test_components_settled(spark, monkeypatch):
    """Edges that are stars already take no round; those of two partitions that meet in a node do."""
    rounds, hook = [], graph._hook
    monkeypatch.setattr(graph, "_hook", lambda edges: rounds.append(1) or hook(edges))
    chain = spark.createDataFrame([(i, i + 1) for i in range(9)], "src long, dst long").coalesce(1)
    assert {r["component"] for r in connected_components(chain).collect()} == {0} and not rounds
    apart = spark.createDataFrame(spark.sparkContext.parallelize([*[(i, i + 1) for i in range(9)], (9, 10), (11, 10)], 2), "src long, dst long")
    assert {(r["node"], r["component"]) for r in connected_components(apart).collect()} == {(n, 0) for n in range(12)} and rounds


def test_ranks(spark):
    df = spark.range(500).selectExpr("if(id < 300, null, id % 3) AS g", "id % 50 AS x")
    got = rank_in_groups(df, ["g"], F.xxhash64("x"), cell_rows=16).collect()
    for g in (None, 0, 1, 2):
        assert sorted(r["rank"] for r in got if r["g"] == g) == list(range(sum(r["g"] == g for r in got)))


PAGE = """<html><head><title>T</title><meta property="og:title" content="OG"><meta property="article:published_time" content="2024-01-02">
<link rel="canonical" href="https://e.org/a/?utm_x=1"></head><body><nav><a href="/n/1">One</a><a href='/about'>no</a><a href="https://other.org/n/9">x</a><a href="/n/1#again">dup</a></nav>
<article><h1>Head</h1><script>var a = "<p>";</script><p>{}<p>second &amp; last<img src="/ads/x.png"><img src="/i.png" class="logo"><img srcset="/s.png 100w, /b.png 600w"></article></body></html>"""


def test_pages(spark):
    html = PAGE.format("A sentence of the article. " * 8)
    rows = [(1, "https://e.org/list", html), (2, "https://e.org/x", None), (3, "https://e.org/y", "<p>" + "plain paragraph of some length " * 6)]
    parts = pg.page_parts(spark.createDataFrame(rows, "page_id long, url string, html string")).cache()
    got = {r["page_id"]: r for r in pg.extract_pages(parts).collect()}
    assert (got[1]["title"], got[1]["published"], got[1]["canonical_url"], got[1]["image"]) == ("OG", "2024-01-02", "https://e.org/a", "https://e.org/b.png")
    assert got[1]["content_text"].startswith("Head A sentence") and "var a" not in got[1]["content_text"] and got[1]["content_text"].endswith("second & last")
    assert got[2]["content_text"] == "" and got[2]["canonical_url"] == "https://e.org/x" and got[3]["content_text"].startswith("plain paragraph")
    rules = spark.createDataFrame([("s", ["e.org"], ["/n/"], ["about"], [], [])], "id string, allowed_domains array<string>, include_patterns array<string>, exclude_patterns array<string>, strip_query_params array<string>, page_hosts array<string>")
    links = pg.discover_links(parts, rules).collect()
    assert [(r["url"], r["title"]) for r in links] == [("https://e.org/n/1", "One")]


RULES = "id string, page_hosts array<string>, title_selectors array<string>, content_selectors array<string>, published_selectors array<string>, image_selectors array<string>, remove_selectors array<string>"


def test_first_matches_of_a_page(spark):
    long = "A sentence that an article holds. " * 5
    html = [
        f"<article>{long}<article>inner card</article></article><article>other card</article>",  # the first article, its inner text once
        '<time>yesterday</time><time datetime="2024-01-02">x</time>',
        f"<aside><article>{long}<aside>by the way</aside><div class='big ads'>buy <nav>go</nav></div><noscript>old</noscript>end</article></aside>",  # cut inside only
        "<body>shown<form>name <b>here</b></form><svg><text>drawn</text></svg><article>short</article></body>",
        f"<main><div role='main'>short</div></main><section role='main'>{long}</section><div class='x entry-content'>{long}other</div>",
        '<link rel="canonical" href="ftp:no"><link rel="Canonical" href="https://h5.org/a?utm_source=q"><meta property="og:url" content="/b">',
        f"<p><article><form><p>{long}</p><h2>too short</h2></form></article></p><p>{long} after it</p>",
        '<span itemprop="datePublished">2024-05-06</span>',
    ]
    pages = spark.createDataFrame([(i, f"https://h{i}.org/p", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    parts = pg.page_parts(pages).cache()
    got = {r["page_id"]: r for r in pg.extract_pages(parts).collect()}
    texts = {r["page_id"]: r["full_text"] for r in pg.page_fulltext(parts).collect()}
    long = long.strip()
    assert got[0]["content_text"] == f"{long} inner card" == texts[0]
    assert got[1]["published"] == "2024-01-02" and got[7]["published"] == "2024-05-06"
    assert got[2]["content_text"] == f"{long} end"
    assert texts[3] == "shown short" and got[4]["content_text"] == f"{long} other"
    assert got[5]["canonical_url"] == "https://h5.org/a"
    assert got[6]["content_text"] == long  # by paragraphs inside the article, the one around it not being one
    # a source's own selectors
    html = f"<h1>Head</h1><div id='t' title='Given'>x</div><div class='story'><p class='by'>author</p>{long}<div class='more'>more</div></div><i data-when='2023'>12 May</i><img src='/first.jpg'><figure><img src='/logo.png'></figure>"
    pages = spark.createDataFrame([(1, "https://own.org/1", html), (2, "https://else.org/1", html)], "page_id long, url string, html string")
    rules = spark.createDataFrame([("a", ["own.org"], ["#none", "#t"], [".story .none", "body .story", "div.story"], ["i[data-when=2023]"], ["figure img"], [".by", "div .more"]), ("b", ["own.org"], ["h1"], None, None, None, None)], RULES)
    own, other = pg.extract_pages(pg.page_parts(pages, rules)).orderBy("page_id").collect()
    assert (own["title"], own["content_text"], own["published"], own["image"]) == ("Given", long, "12 May", "https://own.org/logo.png")
    assert (other["title"], other["content_text"], other["published"], other["image"]) == ("Head", "", "", "https://else.org/first.jpg")


def test_selectors_beyond_the_subset_are_an_error():
    for bad in ("a > b", "p:first-child", "..x", ""):
        with pytest.raises(ValueError, match="not understood"):
            pg.Selectors({"title": [bad]})


def test_deep_pages_take_linear_time():
    import time

    wanted = pg.selectors(tuple((k, tuple(v)) for k, v in pg.SELECTORS.items()))
    for mark in ("<b>x", "<article>x", "<h2 class='ad'>x", "<a href='/x'>x", "<main><i>x", "<p>x<div>"):
        began = time.process_time()
        page = pg.PageParts(wanted)
        page.feed(mark * 8000)
        page.close()
        assert len(page.pieces) == 8000 and time.process_time() - began < 1.5


def test_page_images(spark):
    lazy = '<img src="data:image/gif;base64,R0" data-src="/ads/x.png" data-original="/real.jpg">'
    html = [
        f"<body>{lazy}</body>", '<body><img src="/late.jpg"><main><img src="/main.jpg"></main><article><img src="data:x" data-srcset="/s.png 100w, /b.png 600w"></article></body>',
        '<meta name="twitter:image" content="/t.jpg"><meta property="og:image:secure_url" content="/secure.jpg"><meta property="og:image" content="/ads/no.jpg">',
        '<meta itemprop="image" content="/item.jpg"><body><img src="/other.jpg"></body>', '<video>your browser <img src="/v.jpg" width="50"> is old</video><audio>no sound</audio>text<img src="/logo.png">',
    ]
    parts = pg.page_parts(spark.createDataFrame([(i, "https://e.org/a", h) for i, h in enumerate(html)], "page_id long, url string, html string")).cache()
    got = {r["page_id"]: r["image"] for r in pg.pick_image(parts).collect()}
    assert got == {0: "https://e.org/real.jpg", 1: "https://e.org/b.png", 2: "https://e.org/secure.jpg", 3: "https://e.org/item.jpg"}
    assert {r["page_id"]: r["text"] for r in pg.html_text(parts).collect()}[4] == "text"
    assert pg.page_fulltext(pg.page_parts(spark.createDataFrame([(1, "u", "<body>a b<main>long text</main></body>")], "page_id long, url string, html string"))).first()["full_text"] == "a b long text"
    entries = [
        ("a", "https://e.org/1", ["data:x", "/m.jpg"], [("image/png", "/e.png")], None), ("b", "https://e.org/2", None, [("audio/mp3", "/e.mp3"), ("image/png", "/e.png")], "<img src='/h.jpg'>"),
        ("c", "https://e.org/3", [], None, "<img src='/icon.png'><img src='/h.jpg'>"), ("d", "https://e.org/4", None, None, None),
    ]
    found = pg.pick_entry_image(spark.createDataFrame(entries, "id string, link string, media array<string>, enclosures array<struct<type: string, href: string>>, html string"))
    assert {r["id"]: r["image"] for r in found.collect()} == {"a": "https://e.org/m.jpg", "b": "https://e.org/e.png", "c": "https://e.org/h.jpg"}


def test_tfidf_clusters(spark):
    rng = random.Random(8)
    words = ["red", "blue", "shoe", "coat", "show", "paris", "milan", "store", "opens", "brand", "week", "model"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 4))), "") for i in range(40)] + [(90, "", "")]
    df = spark.createDataFrame(rows, "id long, title string, content_snippet string")
    vec: dict = {}
    for r in sj.tfidf_terms(df, ["the"]).collect():
        vec.setdefault(r["id"], {})[r["term"]] = r["weight"]
    terms = sorted({t for v in vec.values() for t in v})
    ids = sorted(vec)
    x = np.array([[vec[i].get(t, 0.0) for t in terms] for i in ids])
    pairs = {(r["a"], r["b"]) for r in sj.tfidf_pairs(sj.tfidf_terms(df, ["the"]), 0.6).collect()}
    assert pairs == {(ids[i], ids[j]) for i, j in itertools.combinations(range(len(ids)), 2) if 1 - x[i] @ x[j] < 0.6 and set(vec[ids[i]]) & set(vec[ids[j]])}
    want = {frozenset(ids[i] for i in g) for g in slow_hac(x, 0.6)} | {frozenset([90])}
    for most in (2048, 4):
        old, cl.TASK_MEMBERS = cl.TASK_MEMBERS, most
        got: dict = {}
        for r in cl.cluster_tfidf(df, ["the"], 0.6).collect():
            got.setdefault(r["cluster_id"], set()).add(r["id"])
        cl.TASK_MEMBERS = old
        assert {frozenset(g) for g in got.values()} == want


def test_tfidf_links_are_fewer_than_rows(spark, monkeypatch):
    monkeypatch.setattr(sj, "SPARSE_BLOCKS", 1)
    df = spark.createDataFrame([(i, f"red shoe w{i % 40}", "") for i in range(41)] + [(90 + i, "paris", "") for i in range(10)], "id long, title string, content_snippet string")
    weights = sj.tfidf_terms(df, []).cache()
    groups, reps = sj.tfidf_groups(weights)
    assert {(r["id"], r["cid"]) for r in reps.collect()} == {(i, i % 40) for i in range(41)} | {(90 + i, 90) for i in range(10)}
    assert sj.tfidf_pairs(weights, 0.99).count() == 41 * 40 // 2 + 45 and sj.tfidf_links(groups, 0.99).count() == 39


def test_entity_pairs(spark):
    rng = random.Random(9)
    sets = {i: list({rng.choice("abcdefghij") for _ in range(rng.randint(1, 6))}) for i in range(60)}
    df = spark.createDataFrame(list(sets.items()), "id long, entities array<string>")
    alike = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    for least in (0.5, 0.34, 0.8):  # nothing beside the pairs that are alike comes back
        found = [(r["a"], r["b"]) for r in sj.shared_entity_pairs(df, least).collect()]
        assert len(found) == len(set(found)) and set(found) == {(i, j) for i, j in itertools.combinations(sets, 2) if alike(sets[i], sets[j]) >= least}
    for least in (0.0, 0.5636):
        found = {(r["a"], r["b"]) for r in sj.shared_entity_pairs(df, least).collect()}
        want = {(i, j) for i, j in itertools.combinations(sets, 2) if alike(sets[i], sets[j]) > 0 and alike(sets[i], sets[j]) >= least}
        assert want <= found and (least or found == want)


def test_keys_of_one_row_alone_are_not_kept(spark):
    sets = [(i, [f"e{i}", f"f{i}", f"g{i}", f"h{i}"]) for i in range(50)] + [(90, ["x", "y"]), (91, ["x", "y", "z"])]
    rows, keys = sj._entities(spark.createDataFrame(sets, "id long, entities array<string>"), 0.5)
    assert rows.count() == 52 and {r["id"] for r in keys.collect()} == {90, 91}


def test_feed(spark):
    rows = [("1", "a", "", 5, "2024-01-03", ["x"]), ("2", "b", "img", 1, "2024-01-02", ["y", "x"]), ("3", "a", "img", 2, "2024-01-01", ["z"])]
    t = spark.createDataFrame(rows, "id string, category string, image string, article_count int, published string, names array<string>")
    t = t.withColumn("published", F.col("published").cast("timestamp")).withColumn("sources", F.transform("names", lambda n: F.struct(n.alias("name"))))
    ids = lambda df: [r["id"] for r in df.collect()]
    assert ids(fd.sort_topics(t, "oldest")) == ["3", "2", "1"] and ids(fd.sort_topics(t, "most-sources")) == ["1", "3", "2"]
    assert ids(fd.featured(t)) == ["3"] and sorted(ids(fd.grid(t, fd.featured(t)))) == ["1", "2"]
    assert ids(fd.feed_view(t, "all", ["x"])) == ["1", "2"] and ids(fd.feed_view(t, "a")) == ["1", "3"]


def test_state_versions(spark, tmp_path):
    folder = f"file://{tmp_path}/state"
    assert load_state(spark, folder).topics_state.count() == 0 and current_version(spark, folder) is None
    tomb = lambda k: spark.createDataFrame([(k, dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1))], "article_key string, evicted_at timestamp, expired_at timestamp")
    empty = empty_state(spark)
    for version, key in ((5, "a"), (6, "b"), (6, "c")):
        save_state(spark, folder, version, State(empty.topics_state, empty.topic_articles, tomb(key), empty.snapshot, empty.run_meta))
    assert current_version(spark, folder) == 6 and [r["article_key"] for r in load_state(spark, folder).tombstones.collect()] == ["c"]



def test_a_run_writes_the_parts_it_changes(spark, tmp_path):
    folder, empty = f"file://{tmp_path}/parts", empty_state(spark)
    files = lambda: {str(p.relative_to(tmp_path)) for p in (tmp_path / "parts").rglob("*.parquet") if "manifests" not in p.parts}
    topic = lambda i, title, when: {"topic_id": f"t{i}", "title": title, "last_merged_at": when, "sources": [("n", title, "l", "en")], "centroid": [0.5, float(i)]}

    def save(version, titles, when, last=lambda i, when: when):
        rows = [topic(i, t, last(i, when)) for i, t in titles.items()]
        topics = spark.createDataFrame(rows, empty.topics_state.schema)
        keys = spark.createDataFrame([(r["topic_id"], f"k{i}") for i, r in enumerate(rows)], empty.topic_articles.schema)
        written = save_state(spark, folder, version, State(topics, keys, empty.tombstones, empty.snapshot, empty.run_meta))
        got = {r["topic_id"]: (r["title"], r["last_merged_at"]) for r in load_state(spark, folder).topics_state.collect()}
        assert got == {r["topic_id"]: (r["title"], r["last_merged_at"]) for r in rows}
        return written

    titles, day = {i: f"title {i}" for i in range(300)}, lambda n: dt.datetime(2024, 1, n)
    assert save(1, titles, day(1))["topics_state"] > 50
    first = files()
    assert save(2, titles, day(2)) == dict.fromkeys(STATE, 0) and files() == first  # only the common time has changed
    titles[7] = "another"
    assert save(3, titles, day(3))["topics_state"] == 1 and len(files() - first) == 1
    assert save(4, titles, day(4), lambda i, when: day(9) if i == 3 else when)["topics_state"] > 50  # no common time any more
    del titles[11]
    written = save(5, titles, day(4), lambda i, when: day(9) if i == 3 else when)
    assert written["topics_state"] <= 1  # the part of the topic that went, or none if it stood alone there
    save(6, titles, day(6))
    save(7, titles, day(7))
    assert not first & files() or all("topic_articles" in f for f in first & files())  # what only old versions hold is gone


def test_page_marks_without_semicolon_and_paragraphs_in_open_marks(spark):
    text = "words of a paragraph that is long enough, but not for two"
    html = ["<body><article><h1>a &amp;&amp</h1><p>x &amp y &am</p></article></body>", f"<body><article><p><b>short<br><p>{text}</article></body>", f"<body><p><i>{text}<div><p>{text}, one more</div></body>"]
    parts = pg.page_parts(spark.createDataFrame([(i, "https://e.org/a?x=1&copy=2", h) for i, h in enumerate(html)], "page_id long, url string, html string")).cache()
    assert [r["text"] for r in pg.html_text(parts).orderBy("page_id").collect()][0] == "a &&amp x &amp y &am"
    assert [r["full_text"] for r in pg.page_fulltext(parts).orderBy("page_id").collect()][0] == "a &&amp x &amp y &am"
    first, second, third = pg.extract_pages(parts).orderBy("page_id").collect()
    # the paragraph that a mark left open counts once, so the page has too little text
    assert first["title"] == "a &&amp" and second["content_text"] == "" and third["content_text"].count(", one more") == 2


def test_title_pairs_by_blocks(spark, monkeypatch):
    """All pairs, in one block or many, and where bigrams share columns."""
    rng = random.Random(21)
    rows = []
    for i in range(120):
        same = random.Random(i % 30)
        base = "".join(same.choice("abcdefgh") for _ in range(5 + i % 30))
        grams = sorted({base[k : k + 2] for k in range(len(base) - 1)} | {rng.choice("xyz") + rng.choice("xyz") for _ in range(rng.randint(0, 3))})
        rows.append((i % 2, i, grams))
    df = spark.createDataFrame(rows, "scope long, grams long, bigrams array<string>").cache()
    alike = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) > 0.6
    want = {(s, i, j) for (s, i, x), (t, j, y) in itertools.permutations(rows, 2) if s == t and alike(x, y)}
    for titles, columns in ((4096, 4096), (7, 16)):
        monkeypatch.setattr(dd, "TITLES", titles)
        monkeypatch.setattr(dd, "COLUMNS", columns)
        found = [tuple(r) for r in dd.title_pairs(df, 0.6).select("scope", "grams", "other").collect()]
        assert len(found) == len(set(found)) and set(found) == want and len(want) > 50


def test_titles_are_compared_once_for_a_source_and_its_host(spark, monkeypatch):
    """A host of one source alone has no titles compared for it; one of two sources has, and no pair comes twice."""
    compared, pairs = [], dd.title_pairs
    monkeypatch.setattr(dd, "title_pairs", lambda scoped, *a: compared.append({(r["by"], r["scope"]) for r in scoped.select("by", "scope").collect()}) or pairs(scoped, *a))
    rows = [(f"i{n:02}", s, h, dt.datetime(2024, 1, 1 + n), True, "", "", "", "a title of the same kind " + "xyz"[n], c) for n, (s, h, c) in enumerate([("s1", "h1", "c"), ("s1", "h1", "c"), ("s2", "h2", "d")])]
    rows += [("i90", "s3", "h2", dt.datetime(2024, 1, 3), True, "", "", "", "a title of the same kind z", "e"), ("i91", None, "h3", dt.datetime(2024, 1, 3), True, "", "", "", "a title of the same kind q", "")]
    found = [(r["id_hi"], r["id_lo"], r["reason"]) for r in dd.probable_same_pairs(spark.createDataFrame(rows, ARTICLE)).collect()]
    assert sorted(found) == [("i01", "i00", "hash"), ("i02", "i90", "title")]
    assert sorted(by for by, _ in compared[0]) == ["host", "source", "source", "source", "source"]


def test_dedup_faults_compares_with_kept_articles_alone(spark):
    rows = [(f"i{n:03}", "s", "h", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=n), f"k{n % 3}", f"title of number {n % 5} {'abcde'[n % 5] * 9}") for n in range(60)]
    a = spark.createDataFrame(rows, "id string, source_id string, source_host string, published timestamp, dedup_key string, title string")
    a = a.withColumns({"has_offset": F.lit(True), "canonical_url": F.lit(""), "link": F.lit(""), "content_hash": F.lit("")})
    kept, dropped = dd.dedup_articles(a)
    faults = lambda k, d: sorted(r["id_lo"] for r in qs.dedup_faults(a, k, d).collect())
    ids = sorted(r["id"] for r in kept.collect())
    assert ids and faults(kept, dropped) == []
    assert faults(kept.filter(F.col("id") != ids[0]), dropped) != []  # lost, and what it stood for has no kept neighbour
    assert faults(kept.unionByName(a.filter("id = 'i000'")), dropped.filter("id <> 'i000'")) == ["i000"]
    assert faults(kept, dropped.unionByName(kept.limit(1).select("id", F.lit("key").alias("reason")))) != []
