"""Keys, tombstones, snapshots and measures between runs: F2, F3, J1, J2, X1-X3, T4, T5, A9-A11, A13."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwire.config import DEFAULT
from loomwire.functions.fingerprints import fingerprint_hash
from loomwire.functions.text import extract_actions, extract_entities, first_of, full
from loomwire.functions.times import time_bucket
from loomwire.operators.topics import cap_array, names_of


def drop_blocked(articles: DataFrame, tombstones: DataFrame) -> DataFrame:
    """F2."""
    return articles.join(tombstones.select("article_key"), "article_key", "left_anti")


def prune_tombstones(tombstones: DataFrame, run_ts: Column) -> DataFrame:
    """those with a key that have not expired."""
    return tombstones.filter((full(F.col("article_key")) != "") & (F.col("expired_at") > run_ts))


def union_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    """X1."""
    return a.select("article_key").unionByName(b.select("article_key")).distinct()


def active_keys(topic_articles: DataFrame) -> DataFrame:
    """X2."""
    return topic_articles.select("article_key").filter("article_key <> ''").distinct()


def upsert_tombstones(tombstones: DataFrame, keys: DataFrame, run_ts: Column, ttl_days: int = DEFAULT.tombstone_ttl_days) -> DataFrame:
    """``keys`` are blocked from now on; a key blocked before gets the new times."""
    fresh = keys.select("article_key").filter("article_key <> ''").distinct()
    new = fresh.select("article_key", run_ts.alias("evicted_at"), (run_ts + F.make_interval(days=F.lit(ttl_days))).cast("timestamp").alias("expired_at"))
    return tombstones.join(fresh, "article_key", "left_anti").select("article_key", "evicted_at", "expired_at").unionByName(new)


def drop_active(tombstones: DataFrame, topic_articles: DataFrame) -> DataFrame:
    """J2."""
    return tombstones.join(active_keys(topic_articles), "article_key", "left_anti")


def select_new(articles: DataFrame, tombstones: DataFrame, seen: DataFrame, snapshot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Articles that are neither blocked, nor active, nor in the last snapshot; and those that are blocked."""
    keyed = articles.filter(full(F.col("article_key")) != "")
    blocked = keyed.join(tombstones.select("article_key"), "article_key", "left_semi")
    new = drop_blocked(keyed, tombstones).join(seen.select("article_key"), "article_key", "left_anti").join(snapshot.select("article_key"), "article_key", "left_anti")
    return new, blocked


def build_snapshot(articles: DataFrame) -> DataFrame:
    """A11."""
    return articles.select("article_key", "source", "normalized_url", "title_hash", "published")


def snapshot_sources(articles: DataFrame) -> DataFrame:
    """The sorted sources of a run."""
    return articles.agg(F.array_sort(F.collect_set(F.nullif("source", F.lit("")))).alias("sources"))


def quality_metrics(topics: DataFrame, mode: str) -> DataFrame:
    """One row."""
    names = F.when(F.size("source_set") > 0, F.size("source_set")).otherwise(F.size(names_of(F.col("sources"))))
    sums = topics.agg(
        F.count("*").alias("topics"), F.coalesce(F.sum("article_count"), F.lit(0)).alias("articles"), F.coalesce(F.avg(names), F.lit(0.0)).alias("names"),
        F.count(F.when(F.coalesce("cluster_confidence", F.lit(0.0)) >= DEFAULT.high_confidence, 1)).alias("sure"),
    )
    rate = F.when(F.col("articles") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("articles") - F.col("topics")) / F.col("articles")))).otherwise(0.0)
    share = F.when(F.col("topics") > 0, F.col("sure") / F.col("topics")).otherwise(0.0)
    return sums.select(F.bround(rate, 4).alias("merge_rate"), F.bround("names", 4).alias("avg_sources_per_topic"), F.bround(share, 4).alias("high_confidence_topic_ratio"), F.lit(mode).alias("rebuild_mode"))


def feed_meta(topics: DataFrame, articles: DataFrame) -> DataFrame:
    """A10: one row; the sources are those of this run's kept articles."""
    counts = topics.agg(F.count("*").alias("total_topics"), F.coalesce(F.sum("article_count"), F.lit(0)).cast("long").alias("total_articles"))
    named = snapshot_sources(articles).select(F.size("sources").cast("long").alias("sources_count"), "sources")
    return counts.crossJoin(named)  # one row each


def run_stats(**frames: DataFrame) -> DataFrame:
    """One row with the number of rows of each frame."""
    out = None
    for name, frame in frames.items():
        one = frame.agg(F.count("*").alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out


def normalize_state(topics: DataFrame, run_ts: Column) -> DataFrame:
    """T4: every field of a loaded topic filled in; a missing fingerprint is made from title, summary, time and sources."""
    ident = first_of(F.col("topic_id"), F.col("id"), F.substring(F.md5(F.concat(full(F.col("title")), full(F.col("published").cast("string")))), 1, 12))
    text = F.concat_ws(" ", full(F.col("title")), full(F.col("summary")))
    entities, actions, bucket = extract_entities(text), extract_actions(text), time_bucket(F.col("published"), run_ts)
    names = names_of(F.col("sources"))
    made = F.struct(
        fingerprint_hash(entities, actions, [bucket, bucket], names, 10, 8).alias("hash"), entities.alias("entities"), actions.alias("actions"),
        bucket.alias("time_bucket"), names.alias("sources"), F.struct(bucket.alias("start"), bucket.alias("end")).alias("time_window"),
    )
    none = F.array().cast("array<string>")
    fp = F.when(full(F.col("event_fingerprint.hash")) == "", made).otherwise(F.col("event_fingerprint"))
    t = topics.withColumn("event_fingerprint", fp)
    sets = F.array_sort(F.array_union(F.coalesce("source_set", none), F.coalesce("event_fingerprint.sources", none)))
    confidence = F.greatest(F.lit(0.3), F.least(F.lit(0.99), F.coalesce("cluster_confidence", F.lit(0.6))))
    return t.withColumns(
        {
            "topic_id": ident,
            "id": first_of(F.col("id"), ident),
            "article_count": F.greatest(F.coalesce("article_count", F.lit(1)), F.lit(1)),
            "source_set": F.when(F.size(sets) > 0, sets).otherwise(names),
            "entity_set": cap_array(F.array_sort(F.array_union(F.coalesce("entity_set", none), F.coalesce("event_fingerprint.entities", none))), 24),
            "cluster_confidence": confidence,
            "last_merged_at": F.coalesce("last_merged_at", "published", run_ts),
        }
    )
