"""Whole runs over articles and state: T1, T3, T5."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwire.config import DEFAULT, FusionConfig
from loomwire.functions.vectors import vec_normalize
from loomwire.operators import state as st
from loomwire.operators import topics as tp
from loomwire.operators.cluster import cluster_tfidf, hac_average, stage_a_merge
from loomwire.operators.ingest import attach_fingerprints
from loomwire.operators.verdicts import apply_editorial
from loomwire.session import cut
from loomwire.sources.state import State


@dataclass
class Verdicts:
    """Answers to review queues; a missing table means that nothing was reviewed."""

    pairs: DataFrame | None = None
    editorial: DataFrame | None = None
    confidences: DataFrame | None = None


def event_clusters(articles: DataFrame, vecs: DataFrame | None, config: FusionConfig = DEFAULT, stop_words: list[str] | None = None) -> DataFrame:
    """``(cluster_id, id)``: average linkage and Stage A on vectors; TF-IDF clusters in a run without vectors."""
    if vecs is None:
        return cluster_tfidf(articles, stop_words or [], config.tfidf_distance).select("cluster_id", "id")
    held = articles.select("id").join(vecs, "id", "left")
    base = cut(hac_average(held, config.stage_a_distance))
    return cut(stage_a_merge(base.select("cluster_id", "id"), articles, vecs, config))


def new_topics(articles: DataFrame, vecs: DataFrame | None, run_ts: Column, config: FusionConfig, verdicts: Verdicts) -> tuple[DataFrame, DataFrame]:
    members = event_clusters(articles, vecs, config)
    kept = tp.cap_clusters(tp.cluster_sizes(members, articles), config.max_topics)
    members = cut(members.join(kept.select("cluster_id"), "cluster_id", "left_semi").select("cluster_id", "id"))
    topics, keys = tp.topic_state(members, articles, vecs, run_ts, verdicts.confidences)
    if verdicts.editorial is not None:
        topics = apply_editorial(topics, verdicts.editorial)
        keys = keys.join(topics.select("topic_id"), "topic_id", "left_semi")
    return cut(topics), cut(keys)


def fuse(topics: DataFrame, keys: DataFrame, run_ts: Column, config: FusionConfig, verdicts: Verdicts, old: State | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Join topics that tell one event. With ``old`` only pairs of topics that are new or changed since are scored. Returns
    topics and keys, and the scores with what they were made from."""
    if old is None or old.topic_pairs is None or old.topic_scored is None:
        pairs = cut(tp.topic_pair_scores(topics, config))
    else:
        pairs = cut(tp.updated_pair_scores(topics, old.topic_pairs, old.topic_scored, config))
    merged, kept = tp.merge_components(topics, keys, tp.topic_merge_edges(pairs, verdicts.pairs, config), run_ts)
    return cut(merged), cut(kept), pairs, cut(tp.scored_topics(topics))


def build_state(topics: DataFrame, keys: DataFrame, tombstones: DataFrame, articles: DataFrame, run_ts: Column, config: FusionConfig, last_full: Column, pairs: DataFrame, scored: DataFrame) -> State:
    """Cap the topics, block what is evicted unless it is active elsewhere, and take the snapshot."""
    kept, evicted = tp.cap_topics(topics, config.max_topics)
    kept = cut(kept)
    live = keys.join(kept.select("topic_id"), "topic_id", "left_semi")
    gone = keys.join(evicted.select("topic_id"), "topic_id", "left_semi").select("article_key")
    blocked = st.upsert_tombstones(st.prune_tombstones(tombstones, run_ts), gone, run_ts, config.tombstone_ttl_days)
    meta = kept.sparkSession.range(1).select(F.lit(2).alias("version"), run_ts.alias("updated_at"), last_full.alias("last_full_rebuild_at"))
    left = lambda c: kept.select(F.col("topic_id").alias(c))
    pairs = pairs.join(left("a"), "a", "left_semi").join(left("b"), "b", "left_semi")
    return State(kept, live, st.drop_active(blocked, live), st.build_snapshot(articles), meta, pairs, scored.join(left("topic_id"), "topic_id", "left_semi"))


def run_full(articles: DataFrame, vecs: DataFrame | None, old: State, run_ts: Column, config: FusionConfig = DEFAULT, verdicts: Verdicts | None = None) -> tuple[State, DataFrame]:
    """Topics from this run's articles alone, but for those that tombstones block; returns the state and statistics.

    ``articles`` are deduplicated, relevant and keyed; ``vecs(id, v)``.
    """
    verdicts = verdicts or Verdicts()
    live = cut(attach_fingerprints(st.drop_blocked(articles, st.prune_tombstones(old.tombstones, run_ts)), run_ts))
    topics, keys = new_topics(live, vecs, run_ts, config, verdicts)
    fused, fused_keys, pairs, scored = fuse(topics, keys, run_ts, config, verdicts)
    state = build_state(fused, fused_keys, old.tombstones, articles, run_ts, config, run_ts, pairs, scored)
    stats = st.run_stats(articles=articles, kept_articles=live, created_topics=topics, fused_topics=fused, kept_topics=state.topics_state)
    return state, stats


def run_incremental(articles: DataFrame, vecs: DataFrame | None, old: State, run_ts: Column, config: FusionConfig = DEFAULT, verdicts: Verdicts | None = None) -> tuple[State, DataFrame]:
    """New articles join topics or make new ones, then topics that tell one event are fused.

    Scores use the state before the run, so the order of articles does not matter. Without vectors no article reaches
    the threshold and all make new topics.
    """
    verdicts = verdicts or Verdicts()
    topics = cut(st.normalize_state(old.topics_state, run_ts))
    tombs = st.prune_tombstones(old.tombstones, run_ts)
    fresh, blocked = st.select_new(articles, tombs, st.active_keys(old.topic_articles), old.snapshot)
    fresh = cut(attach_fingerprints(fresh, run_ts))
    unit = None if vecs is None else vecs.select("id", vec_normalize(F.col("v")).alias("v"))
    withv = fresh.withColumn("v", F.lit(None).cast("array<double>")) if unit is None else fresh.join(unit, "id", "left")
    assigned = cut(tp.assign_to_topics(withv, topics, config))
    refreshed, keys = tp.refresh_topics(topics, old.topic_articles, assigned, withv, run_ts)
    rest = cut(fresh.join(assigned.select("article_key"), "article_key", "left_anti"))
    created, created_keys = new_topics(rest, None if vecs is None else vecs.join(rest.select("id"), "id", "left_semi"), run_ts, config, verdicts)
    every = cut(refreshed.select(*created.columns).unionByName(created))
    fused, fused_keys, pairs, scored = fuse(every, cut(keys.unionByName(created_keys).distinct()), run_ts, config, verdicts, old)
    last_full = F.lit(old.run_meta.agg(F.max("last_full_rebuild_at")).first()[0]).cast("timestamp")
    state = build_state(fused, fused_keys, old.tombstones, articles, run_ts, config, last_full, pairs, scored)
    stats = st.run_stats(new_articles=fresh, blocked_articles=blocked, assigned=assigned, created_topics=created, fused_topics=fused, kept_topics=state.topics_state)
    return state, stats


def run(articles: DataFrame, vecs: DataFrame | None, old: State, run_ts: Column, full: bool = False, **how) -> tuple[State, DataFrame]:
    """A run in the mode that the state allows: without topics or snapshot it is full."""
    if full or not old.topics_state.limit(1).count() or not old.snapshot.limit(1).count():
        return run_full(articles, vecs, old, run_ts, **how)
    return run_incremental(articles, vecs, old, run_ts, **how)
