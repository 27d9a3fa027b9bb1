"""Topics: making, refreshing, merging and capping them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwire.config import DEFAULT, DEFAULT_CATEGORY, FusionConfig
from loomwire.functions.fingerprints import ACTION_WEIGHT, ENTITY_WEIGHT, TIME_WEIGHT, fingerprint_similarity
from loomwire.functions.text import category_id, category_name, first_of, full
from loomwire.functions.times import bucket_score
from loomwire.functions.vectors import clamp01, vec_dot, vec_normalize
from loomwire.operators.cluster import centroids, cluster_confidence, merge_fingerprints, ordered
from loomwire.operators.graph import connected_components
from loomwire.operators.simjoin import Bound, bounded_pairs, cosine_pairs, cosine_pairs_between, printed, shared_entity_pairs, shared_entity_pairs_between
from loomwire.session import cut

# What vectors, fingerprints and time weigh when an article looks for its topic.
EMBED, PRINT, RECENCY = 0.62, 0.28, 0.10
# What vectors and fingerprints weigh between two topics.
PAIR_EMBED, PAIR_PRINT = 0.68, 0.32
#: Jaccard similarity of entities by which a pair is found that its vectors do not show; any value gives the same result.
ENTITIES_SHARED = 0.5
#: Weights of a fingerprint's parts.
WEIGHTS = (ENTITY_WEIGHT, ACTION_WEIGHT, TIME_WEIGHT)
INTERNAL = ["topic_id", "centroid", "event_fingerprint", "source_set", "entity_set", "cluster_confidence", "last_merged_at"]


def _empty() -> Column:
    return F.array().cast("array<string>")


def cap_array(c: Column, n: int) -> Column:
    """W9."""
    return F.slice(c, 1, n)


def newest_first(df: DataFrame) -> DataFrame:
    """W1."""
    return df.orderBy(F.desc("published"), "id")


def cap_clusters(clusters: DataFrame, n: int = DEFAULT.max_topics, order: str = "newest") -> DataFrame:
    """The first ``n`` of clusters ``(cluster_id, size, newest)``: newest first, or largest and then oldest first."""
    by = [F.desc("newest"), F.col("cluster_id")] if order == "newest" else [F.desc("size"), F.asc("newest"), F.col("cluster_id")]
    return clusters.orderBy(*by).limit(n)


def cluster_sizes(members: DataFrame, articles: DataFrame) -> DataFrame:
    return members.join(articles.select("id", "published"), "id").groupBy("cluster_id").agg(F.count("*").cast("int").alias("size"), F.max("published").alias("newest"))


def topics_from_clusters(members: DataFrame, articles: DataFrame) -> DataFrame:
    """A5: one topic per cluster, headed by its first article in order; ``cluster_id`` stays beside the topic's id."""
    rows = ordered(members, articles, "title", "article_summary", "content_snippet", "category_hint", "image", "published", "source", "link", "source_lang")
    head = F.min(F.struct("ord", "id", "title", "article_summary", "content_snippet", "category_hint", "image", "published")).alias("h")
    link = F.struct("ord", F.struct(F.col("source").alias("name"), "title", "link", F.col("source_lang").alias("lang")).alias("s"))
    made = rows.groupBy("cluster_id").agg(head, F.sort_array(F.collect_list(link)).alias("links"), F.count("*").cast("int").alias("article_count"))
    category = category_id(first_of(F.col("h.category_hint"), F.lit(DEFAULT_CATEGORY)))
    return made.select(
        "cluster_id", F.col("h.id").cast("string").alias("id"), F.col("h.title").alias("title"),
        F.substring(first_of(F.col("h.article_summary"), F.col("h.content_snippet")), 1, 300).alias("summary"), _empty().alias("key_points"), _empty().alias("tags"),
        category.alias("category"), category_name(category).alias("category_name"), full(F.col("h.image")).alias("image"), F.col("h.published").alias("published"),
        F.transform("links", lambda x: x["s"]).alias("sources"), "article_count",
    )


def names_of(sources: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(sources, lambda s: s["name"]), lambda n: full(n) != "")))


def topic_state(members: DataFrame, articles: DataFrame, vecs: DataFrame | None, run_ts: Column, confidences: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``topics_state`` and ``topic_articles`` of clusters; ``confidences(cluster_id, cluster_confidence)`` come from
    reviews where there are any, else from A4."""
    topics = topics_from_clusters(members, articles)
    prints = merge_fingerprints(ordered(members, articles, "event_fingerprint").select("cluster_id", "ord", F.col("event_fingerprint").alias("fp")), "cluster_id")
    sure = confidences if confidences is not None else cluster_confidence(members, articles, vecs).select("cluster_id", "cluster_confidence")
    state = topics.join(prints, "cluster_id", "left").join(sure, "cluster_id", "left")
    if vecs is None:
        state = state.withColumn("centroid", F.lit(None).cast("array<double>"))
    else:
        state = state.join(centroids(members, vecs), "cluster_id", "left")
    state = state.withColumns(
        {
            "topic_id": F.col("id"),
            "source_set": names_of(F.col("sources")),
            "entity_set": cap_array(F.col("event_fingerprint.entities"), 16),
            "cluster_confidence": F.greatest(F.lit(0.3), F.least(F.lit(0.99), F.coalesce("cluster_confidence", F.lit(0.6)))),
            "last_merged_at": run_ts,
        }
    )
    keys = members.join(articles.select("id", "article_key"), "id").join(topics.select("cluster_id", F.col("id").alias("topic_id")), "cluster_id")
    return state.drop("cluster_id"), keys.select("topic_id", "article_key").filter("article_key <> ''").distinct()


def upsert_sources(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """``(topic_id, sources)`` of source lists ``(topic_id, ord, name, title, link, lang)``: of equal links the last value
    at the first place; rows without link are left out. ``ord`` orders rows inside each side."""
    every = existing.withColumn("side", F.lit(0)).unionByName(incoming.withColumn("side", F.lit(1))).filter(full(F.col("link")) != "")
    place = F.struct("side", "ord")
    one = every.groupBy("topic_id", "link").agg(F.min(place).alias("at"), F.max(F.struct(place.alias("p"), "name", "title", "lang")).alias("v"))
    listed = F.sort_array(F.collect_list(F.struct("at", F.struct("v.name", "v.title", "link", "v.lang").alias("s"))))
    return one.groupBy("topic_id").agg(F.transform(listed, lambda x: x["s"]).alias("sources"))


def exploded_sources(topics: DataFrame) -> DataFrame:
    return topics.select("topic_id", F.posexplode("sources").alias("pos", "s")).select("topic_id", F.struct(F.lit(0).alias("t"), F.col("pos").alias("i")).alias("ord"), "s.name", "s.title", "s.link", "s.lang")


def assign_scores(topics: DataFrame, articles: DataFrame, least: float = DEFAULT.incremental_assign_score) -> DataFrame:
    """``(article_key, topic_id, score)`` of every topic and article that score at least ``least``.

    ``topics``: topic_id, published, centroid, event_fingerprint; ``articles``: article_key, v, event_fingerprint. A pair that reaches ``least``
    has near vectors, or else must make up for them by its entities: below the vectors' bound only a Jaccard similarity of
    ENTITIES_SHARED lets it. So candidates come from a join of vectors and one of rare entities, whatever the number of topics.
    """
    few = topics.select("topic_id", F.col("published").alias("topic_published"), "centroid", F.col("event_fingerprint").alias("tf"))
    mine = articles.select("article_key", "v", F.col("event_fingerprint").alias("af"))
    near_enough = (least - RECENCY - PRINT * (ACTION_WEIGHT + TIME_WEIGHT + ENTITY_WEIGHT * ENTITIES_SHARED)) / EMBED
    double = lambda c: F.col(c).cast("array<double>").alias("v")
    as_text = lambda key: F.col(key).cast("string")
    told = printed(F.col("event_fingerprint"))
    bound = Bound(least, EMBED, PRINT, RECENCY, WEIGHTS, ENTITIES_SHARED)
    by_vector = cosine_pairs_between(articles.select(as_text("article_key").alias("id"), double("v"), *told), topics.select(as_text("topic_id").alias("id"), double("centroid"), *told), 1.0 - near_enough + 1e-6, bound)
    named = lambda df, key: df.select(as_text(key).alias("id"), F.col("event_fingerprint.entities").alias("entities"))
    by_name = shared_entity_pairs_between(named(articles, "article_key"), named(topics, "topic_id"), ENTITIES_SHARED)
    pairs = by_name.unionByName(by_vector.select("a", "b")).distinct()
    met = pairs.join(mine, F.col("a") == as_text("article_key")).join(few, F.col("b") == as_text("topic_id"))
    embed = F.coalesce(clamp01(vec_dot(F.col("centroid"), F.col("v"))), F.lit(0.0))
    recency = bucket_score(F.col("tf.time_bucket"), F.col("af.time_bucket"))
    score = EMBED * embed + PRINT * fingerprint_similarity(F.col("tf"), F.col("af")) + RECENCY * recency
    return met.select("article_key", "topic_id", "topic_published", score.alias("score")).filter(F.col("score") >= least)


def assign_to_topics(articles: DataFrame, topics: DataFrame, config: FusionConfig = DEFAULT) -> DataFrame:
    """``(article_key, topic_id, score)`` of the best topic of each article, if it scores enough; ties go to the newest
    topic, then to the smaller id."""
    best = F.min(F.struct((-F.col("score")).alias("s"), (-F.unix_micros("topic_published")).alias("t"), "topic_id")).alias("b")
    scored = assign_scores(topics, articles, config.incremental_assign_score)
    return scored.groupBy("article_key").agg(best).select("article_key", "b.topic_id", (-F.col("b.s")).alias("score"))


def topic_pair_scores(topics: DataFrame, config: FusionConfig = DEFAULT, mode: str | None = None) -> DataFrame:
    """``(a, b, score)``, a < b, of topics that score at least the boundary; the candidates lose none: pairs that share
    ENTITIES_SHARED of their entities meet by these, and others must have near vectors."""
    named = shared_entity_pairs(topics.select(F.col("topic_id").alias("id"), F.col("event_fingerprint.entities").alias("entities")), ENTITIES_SHARED)
    vectors, far, bound = _pair_vectors(topics), *_pair_bound(config)
    near = (cosine_pairs(vectors.select("id", "v"), far, mode) if mode == "lsh" else bounded_pairs(vectors, far, bound)).select("a", "b")
    return _pair_scores(named.unionByName(near).distinct(), topics, config)


def _pair_vectors(topics: DataFrame) -> DataFrame:
    return topics.select(F.col("topic_id").alias("id"), F.col("centroid").alias("v"), *printed(F.col("event_fingerprint")))


def _pair_bound(config: FusionConfig) -> tuple[float, Bound]:
    """The cosine distance from which on a pair that shares less than ENTITIES_SHARED of its entities stays below the boundary, and the bound of one pair."""
    least = config.cross_merge_boundary
    near_enough = (least - PAIR_PRINT * (ACTION_WEIGHT + TIME_WEIGHT + ENTITY_WEIGHT * ENTITIES_SHARED)) / PAIR_EMBED
    return 1.0 - near_enough + 1e-6, Bound(least, PAIR_EMBED, PAIR_PRINT, 0.0, WEIGHTS, ENTITIES_SHARED)


def _pair_scores(pairs: DataFrame, topics: DataFrame, config: FusionConfig) -> DataFrame:
    side = lambda x, i: topics.select(F.col("topic_id").alias(x), F.col("centroid").alias(f"c{i}"), F.col("event_fingerprint").alias(f"f{i}"))
    met = pairs.join(side("a", 1), "a").join(side("b", 2), "b")
    embed = F.coalesce(clamp01(vec_dot(F.col("c1"), F.col("c2"))), F.lit(0.0))
    score = PAIR_EMBED * embed + PAIR_PRINT * fingerprint_similarity(F.col("f1"), F.col("f2"))
    return met.select("a", "b", score.alias("score")).filter(F.col("score") >= config.cross_merge_boundary)


def scored_topics(topics: DataFrame) -> DataFrame:
    """``(topic_id, print)``: 64 bits that stand for all that a topic's pair scores depend on."""
    return topics.select("topic_id", F.xxhash64("centroid", "event_fingerprint").alias("print"))


def updated_pair_scores(topics: DataFrame, pairs: DataFrame, scored: DataFrame, config: FusionConfig = DEFAULT) -> DataFrame:
    """D11, kept up to date: what :func:`topic_pair_scores` gives for ``topics``, from the ``pairs(a, b, score)`` of the topics as they were when
    ``scored`` (:func:`scored_topics`). Only topics that are new or changed since are compared, with all others."""
    now = cut(scored_topics(topics))
    changed = cut(now.join(scored, ["topic_id", "print"], "left_anti").select("topic_id"))
    same = now.join(changed, "topic_id", "left_anti").select("topic_id")
    end = lambda c: same.select(F.col("topic_id").alias(c))
    kept = pairs.select("a", "b", "score").join(end("a"), "a", "left_semi").join(end("b"), "b", "left_semi")
    mine = topics.join(changed, "topic_id", "left_semi")
    named = lambda df: df.select(F.col("topic_id").alias("id"), F.col("event_fingerprint.entities").alias("entities"))
    met = shared_entity_pairs_between(named(mine), named(topics), ENTITIES_SHARED).unionByName(cosine_pairs_between(_pair_vectors(mine), _pair_vectors(topics), *_pair_bound(config)).select("a", "b"))
    fresh = met.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return kept.unionByName(_pair_scores(fresh, topics, config))


def top_pairs(pairs: DataFrame, n: int = DEFAULT.cross_merge_pairs) -> DataFrame:
    """W4."""
    return pairs.orderBy(F.desc("score"), "a", "b").limit(n)


def pair_queue(pairs: DataFrame, config: FusionConfig = DEFAULT) -> DataFrame:
    """Pairs in the boundary band whose topics strong pairs have not joined, best first, within the budget."""
    strong = pairs.filter(F.col("score") >= config.cross_merge_strong).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    labels = connected_components(strong)
    root = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}_root"))
    band = pairs.filter(F.col("score") < config.cross_merge_strong).join(root("a"), "a", "left").join(root("b"), "b", "left")
    apart = band.filter(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b", "score")
    return apart.orderBy(F.desc("score"), "a", "b").limit(config.cross_merge_low_cost_reviews)


def topic_merge_edges(pairs: DataFrame, verdicts: DataFrame | None = None, config: FusionConfig = DEFAULT) -> DataFrame:
    """``(src, dst)`` of the best pairs that merge: by score, or in the band by verdict. A strict verdict overrules
    a merge of middling confidence."""
    best = top_pairs(pairs, config.cross_merge_pairs)
    strong = best.filter(F.col("score") >= config.cross_merge_strong).select("a", "b")
    if verdicts is not None:
        told = verdicts.select(F.least("topic_a", "topic_b").alias("a"), F.greatest("topic_a", "topic_b").alias("b"), "merge", "confidence", F.coalesce("strict", F.lit(False)).alias("strict"))
        both = told.groupBy("a", "b").agg(F.max(F.when(~F.col("strict"), F.struct("merge", "confidence"))).alias("low"), F.max(F.when(F.col("strict"), F.struct("merge", "confidence"))).alias("high"))
        unsure = F.coalesce(F.col("low.confidence").between(config.stage_b_low, config.stage_b_high), F.lit(False))
        yes = F.coalesce("low.merge", F.lit(False)) & F.when(unsure & F.col("high").isNotNull(), F.coalesce("high.merge", F.lit(False))).otherwise(True)
        strong = strong.unionByName(pair_queue(best, config).join(both, ["a", "b"]).filter(yes).select("a", "b"))
    return strong.select(F.col("a").alias("src"), F.col("b").alias("dst"))


def refresh_topics(topics: DataFrame, topic_articles: DataFrame, assigned: DataFrame, articles: DataFrame, run_ts: Column) -> tuple[DataFrame, DataFrame]:
    """Topics with the articles assigned to them (article_key, topic_id, score) taken in; others stay as they are."""
    mine = assigned.join(articles, "article_key")
    place = F.struct((-F.unix_micros("published")).alias("t"), F.col("article_key").alias("i"))
    rows = mine.withColumn("ord", place)
    keys = topic_articles.unionByName(assigned.select("topic_id", "article_key")).distinct()
    counts = keys.join(assigned.select("topic_id").distinct(), "topic_id", "left_semi").groupBy("topic_id").agg(F.count("*").cast("int").alias("n_keys"))
    image = F.min(F.when(full(F.col("image")) != "", F.struct("ord", "image"))).alias("im")
    news = rows.groupBy("topic_id").agg(F.max("published").alias("new_published"), image, F.avg("score").alias("avg_score"))
    with_vector = rows.filter("v IS NOT NULL")
    dims = with_vector.select("topic_id", F.posexplode("v").alias("d", "x")).groupBy("topic_id", "d").agg(F.sum(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    sums = dims.groupBy("topic_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda e: e["x"]).alias("vs"), F.max("n").alias("vn"))
    touched = topics.join(news.select("topic_id"), "topic_id", "left_semi")
    incoming = rows.select("topic_id", F.col("source").alias("name"), "title", "link", F.col("source_lang").alias("lang"), "ord")
    # places are numbers, so that both sides order alike
    numbered = incoming.withColumn("k", F.row_number().over(Window.partitionBy("topic_id").orderBy("ord"))).select("topic_id", F.struct(F.lit(1).alias("t"), F.col("k").alias("i")).alias("ord"), "name", "title", "link", "lang")
    sources = upsert_sources(exploded_sources(touched), numbered).withColumnRenamed("sources", "new_sources")
    old = touched.select("topic_id", F.struct(F.lit(0).cast("long").alias("t"), F.lit("").alias("i")).alias("ord"), F.struct(*[F.col(f"event_fingerprint.{c}").alias(c) for c in ("hash", "entities", "actions", "time_bucket", "sources")]).alias("fp"))
    fresh = rows.select("topic_id", F.struct((F.lit(1 << 61) + F.col("ord.t")).alias("t"), F.col("ord.i").alias("i")).alias("ord"), F.struct(*[F.col(f"event_fingerprint.{c}").alias(c) for c in ("hash", "entities", "actions", "time_bucket", "sources")]).alias("fp"))
    prints = merge_fingerprints(old.unionByName(fresh), "topic_id").withColumnRenamed("event_fingerprint", "new_fp")
    joined = topics.join(news, "topic_id", "left").join(counts, "topic_id", "left").join(sums, "topic_id", "left").join(sources, "topic_id", "left").join(prints, "topic_id", "left")
    hit = F.col("new_published").isNotNull()
    # a column of its own: inside a lambda the name of the count would mean the new one, selected beside it
    joined = joined.withColumn("_weight", F.greatest(F.col("article_count"), F.lit(1)).cast("double"))
    weight, known = F.col("_weight"), F.col("centroid").isNotNull()
    total = F.when(known, F.zip_with("vs", "centroid", lambda a, b: (a + b * weight) / (weight + F.col("vn")))).otherwise(F.transform("vs", lambda a: a / F.col("vn")))
    once = 0.7 * F.coalesce("cluster_confidence", F.lit(0.6)) + 0.3 * 0.82
    clamp = lambda c: F.greatest(F.lit(0.3), F.least(F.lit(0.99), c))
    new = {
        "article_count": F.greatest("article_count", "n_keys"),
        "sources": F.coalesce("new_sources", "sources"),
        "published": F.greatest("published", "new_published"),
        "image": first_of(F.col("image"), F.col("im.image")),
        "centroid": F.when(F.col("vs").isNull(), F.col("centroid")).otherwise(vec_normalize(total)),
        "event_fingerprint": F.col("new_fp"),
        "source_set": F.array_sort(F.array_union("source_set", "new_fp.sources")),
        "entity_set": cap_array(F.array_sort(F.array_union("entity_set", "new_fp.entities")), 24),
        "cluster_confidence": clamp(0.7 * clamp(once) + 0.3 * F.col("avg_score")),
        "last_merged_at": run_ts,
    }
    return joined.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in topics.columns]), keys


def merge_components(topics: DataFrame, topic_articles: DataFrame, edges: DataFrame, run_ts: Column) -> tuple[DataFrame, DataFrame]:
    """Topics joined along ``edges(src, dst)``; of each component the newest topic is the base. Topics without edge
    stay but for the time of the merge."""
    labels = cut(connected_components(edges).select(F.col("node").alias("topic_id"), F.col("component")))
    grouped = cut(topics.join(labels, "topic_id"))
    alone = topics.join(labels.select("topic_id"), "topic_id", "left_anti").withColumn("last_merged_at", run_ts)
    rank = F.struct((-F.unix_micros("published")).alias("t"), F.col("topic_id").alias("i"))
    rows = grouped.withColumn("ord", rank)
    base = rows.groupBy("component").agg(F.min(F.struct("ord", "topic_id", "id", "title", "summary", "key_points", "tags", "category", "category_name", "image")).alias("b"))
    renamed = topic_articles.join(labels, "topic_id").join(base.select("component", F.col("b.topic_id").alias("base")), "component").select(F.col("base").alias("topic_id"), "article_key").distinct()
    n_keys = renamed.groupBy("topic_id").agg(F.count("*").cast("int").alias("n_keys"))
    weight = F.greatest(F.coalesce("article_count", F.lit(1)), F.lit(1)).cast("double")
    weighed = rows.withColumn("w", weight)
    sums = weighed.groupBy("component").agg(
        F.sum("article_count").cast("int").alias("total"), F.max("published").alias("published"),
        F.min(F.when(full(F.col("image")) != "", F.struct("ord", "image"))).alias("im"),
        (F.sum(F.col("w") * F.coalesce("cluster_confidence", F.lit(0.6))) / F.sum("w")).alias("confidence"),
        F.flatten(F.collect_list("source_set")).alias("names"), F.flatten(F.collect_list("entity_set")).alias("ents"),
    )
    dims = weighed.filter("centroid IS NOT NULL").select("component", "w", F.posexplode("centroid").alias("d", "x")).groupBy("component", "d").agg(F.sum(F.col("x") * F.col("w")).alias("x"), F.sum("w").alias("w"))
    vectors = dims.groupBy("component").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "x", "w"))), lambda e: e["x"] / e["w"]).alias("mean"))
    fps = rows.select("component", "ord", F.struct(*[F.col(f"event_fingerprint.{c}").alias(c) for c in ("hash", "entities", "actions", "time_bucket", "sources")]).alias("fp"))
    prints = merge_fingerprints(fps, "component")
    numbered = rows.select("component", "ord", F.posexplode("sources").alias("pos", "s")).select(F.col("component").alias("topic_id"), F.struct(F.col("ord.t").alias("t"), F.struct(F.col("ord.i").alias("k"), F.col("pos").alias("p")).alias("i")).alias("ord"), "s.name", "s.title", "s.link", "s.lang")
    links = upsert_sources(numbered.limit(0), numbered).withColumnRenamed("topic_id", "component")
    joined = base.join(sums, "component").join(vectors, "component", "left").join(prints, "component").join(links, "component", "left")
    joined = joined.withColumn("topic_id", F.col("b.topic_id")).join(n_keys, "topic_id", "left")
    merged = joined.select(
        "topic_id", F.col("b.id").alias("id"), F.col("b.title").alias("title"), F.col("b.summary").alias("summary"), F.col("b.key_points").alias("key_points"),
        F.col("b.tags").alias("tags"), F.col("b.category").alias("category"), F.col("b.category_name").alias("category_name"),
        first_of(F.col("b.image"), F.col("im.image")).alias("image"), "published", "sources", F.greatest(F.coalesce("n_keys", F.lit(0)), "total").alias("article_count"),
        vec_normalize(F.col("mean")).alias("centroid"), "event_fingerprint", F.greatest(F.lit(0.3), F.least(F.lit(0.99), F.col("confidence"))).alias("cluster_confidence"),
        run_ts.alias("last_merged_at"), F.array_sort(F.array_distinct(F.concat("names", "event_fingerprint.sources"))).alias("source_set"),
        cap_array(F.array_sort(F.array_distinct(F.concat("ents", "event_fingerprint.entities"))), 24).alias("entity_set"),
    )
    kept_keys = topic_articles.join(labels.select("topic_id"), "topic_id", "left_anti").unionByName(renamed)
    return alone.unionByName(merged), kept_keys


def cap_topics(topics: DataFrame, n: int = DEFAULT.max_topics) -> tuple[DataFrame, DataFrame]:
    """The newest ``n`` topics, and those evicted."""
    kept = topics.orderBy(F.desc("published"), "topic_id").limit(n)
    return kept, topics.join(kept.select("topic_id"), "topic_id", "left_anti")


def topics_output(topics: DataFrame) -> DataFrame:
    """Without internal fields, newest first."""
    return newest_first(topics.drop(*INTERNAL))


def dedup_groups(groups: DataFrame) -> DataFrame:
    """Of groups ``(group_id, id, confidence)`` with equal members the one of the highest confidence, then the smaller id:
    ``(group_id, confidence, size)``."""
    sets = groups.groupBy("group_id").agg(F.max("confidence").alias("confidence"), F.array_sort(F.collect_set("id")).alias("members"))
    keyed = sets.select("group_id", "confidence", F.size("members").alias("size"), F.sha2(F.array_join(F.transform("members", lambda m: m.cast("string")), ","), 256).alias("k"))
    top = keyed.groupBy("k").agg(F.max("confidence").alias("c"))
    return keyed.join(top, "k").filter("confidence = c").groupBy("k").agg(F.min("group_id").alias("group_id"), F.max("c").alias("confidence"), F.max("size").alias("size")).drop("k")
