"""Review queues and the verdicts that answer them: U1-U8, J3.

Each review is two operators: the queue with all inputs a reviewer needs, and the join that applies a table of verdicts.
Anything may fill the table. Without verdicts everything stays as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwire.config import CATEGORY_IDS, DEFAULT, FusionConfig
from loomwire.functions.text import analysis_text, category_id, category_name, collapse, extractive_summary, first_of, full


def enrich(articles: DataFrame, more: DataFrame, on: str, columns: list[str]) -> DataFrame:
    """``articles`` with ``columns`` of ``more`` where it has a non-empty value."""
    side = more.select(on, *[F.col(c).alias(f"_{c}") for c in columns])
    out = articles.join(side, on, "left")
    return out.select(*[F.coalesce(F.nullif(F.col(f"_{c}"), F.lit("")), F.col(c)).alias(c) if c in columns else F.col(c) for c in articles.columns])


def article_queue(articles: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``(article_key, prompt)`` of articles without a verdict."""
    c = F.col
    prompt = analysis_text(c("title"), c("source"), c("source_lang"), c("source_type"), c("category_hint"), c("published").cast("string"), c("article_summary"), c("content_text"), c("content_snippet"))
    return articles.join(verdicts.select("article_key"), "article_key", "left_anti").select("article_key", prompt.alias("prompt"))


def apply_article_verdicts(articles: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Sensitive overrules keep; an unknown category falls back to the hint; tags are trimmed, at most eight; a score
    that is no number is null. Articles without a verdict stay as they are."""
    told = verdicts.select("article_key", F.struct("*").alias("v"))
    v = lambda c: F.col(f"v.{c}")
    sensitive = F.coalesce(v("is_sensitive"), F.lit(False))
    tags = F.slice(F.filter(F.transform(F.coalesce(v("tags"), F.array().cast("array<string>")), lambda t: F.trim(t)), lambda t: full(t) != ""), 1, 8)
    category = F.when(v("category").isin(*CATEGORY_IDS), v("category")).otherwise(F.col("category_hint"))
    new = {
        "is_sensitive": sensitive,
        "is_relevant": F.coalesce(v("keep"), F.lit(False)) & ~sensitive,
        "relevance_score": F.expr("try_cast(v.relevance_score AS int)"),
        "relevance_reason": F.trim(full(v("reason"))),
        "article_summary": F.trim(full(v("summary"))),
        "article_tags": tags,
        "category_hint": category,
        "category_id": category_id(category),
        "content_type": first_of(v("content_type"), F.col("content_type")),
    }
    out = articles.join(told, "article_key", "left")
    return out.select(*[F.when(F.col("v").isNotNull(), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in articles.columns])


def review_budget(queue: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The first ``n`` of a queue that is filtered already."""
    return queue.orderBy(*order).limit(n)


def group_queue(clusters: DataFrame, config: FusionConfig = DEFAULT) -> DataFrame:
    """Clusters ``(cluster_id, size, cohesion, newest)`` to review at low cost: several articles, and loose or large;
    newest first."""
    loose = (F.col("size") > 1) & ((F.col("cohesion") < 0.9) | (F.col("size") >= 6))
    return review_budget(clusters.filter(loose), config.stage_b_low_cost_reviews, [F.desc("newest"), F.col("cluster_id")])


def second_queue(groups: DataFrame, config: FusionConfig = DEFAULT) -> DataFrame:
    """Reviewed groups of middling confidence for the second, stricter look."""
    middling = (F.col("size") > 1) & F.col("confidence").between(config.stage_b_low, config.stage_b_high)
    return review_budget(groups.filter(middling), config.stage_b_high_quality_reviews, [F.desc("newest"), F.col("cluster_id")])


def apply_group_verdicts(members: DataFrame, verdicts: DataFrame, high: float = 0.98) -> DataFrame:
    """U4: clusters split as the verdicts say: ``(cluster_id, id, confidence)``; confidence is null for clusters not told of.

    ``members(cluster_id, local_index, id)``, ``verdicts(group_id, group_no, local_index, confidence)``. Indices that no member
    has are ignored; a member goes to the first group that lists it; members not listed stand alone at .5.
    """
    clamp = lambda c: F.greatest(F.lit(0.3), F.least(F.lit(high), c))
    told = verdicts.groupBy(F.col("group_id").alias("cluster_id"), "local_index").agg(F.min(F.struct("group_no", "confidence")).alias("g"))
    reviewed = verdicts.select(F.col("group_id").alias("cluster_id")).distinct().withColumn("told", F.lit(True))
    out = members.join(reviewed, "cluster_id", "left").join(told, ["cluster_id", "local_index"], "left")
    name = F.coalesce("g.group_no", -1 - F.col("local_index"))
    first = F.min("id").over(Window.partitionBy("cluster_id", "_name"))
    out = out.withColumn("_name", F.when(F.col("told"), name).otherwise(F.lit(0))).withColumn("_new", F.when(F.col("told"), first).otherwise(F.col("cluster_id")))
    sure = F.when(F.col("told"), F.when(F.col("g").isNull(), F.lit(0.5)).otherwise(clamp(F.coalesce("g.confidence", F.lit(0.6)))))
    return out.select(F.col("_new").alias("cluster_id"), "id", sure.alias("confidence"))


def apply_split_verdicts(members: DataFrame, valid: DataFrame, verdicts: DataFrame) -> DataFrame:
    """U8: like :func:`apply_group_verdicts`, for the clusters that ``valid(group_id, valid)`` calls invalid only."""
    wrong = valid.filter("NOT valid").select("group_id")
    return apply_group_verdicts(members, verdicts.join(wrong, "group_id", "left_semi"))


def apply_editorial(topics: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Title, summary, points, tags and category as edited; topics judged sensitive go."""
    told = verdicts.select("topic_id", F.struct("title", "summary", "key_points", "tags", F.col("category").alias("category_name"), "is_sensitive").alias("v"))
    out = topics.join(told, "topic_id", "left").filter(~F.coalesce("v.is_sensitive", F.lit(False)))
    ident = F.when(F.col("v.category_name").isin(*CATEGORY_IDS), category_id(F.col("v.category_name"))).otherwise(F.col("category"))
    new = {
        "title": first_of(F.col("v.title"), F.col("title")),
        "summary": first_of(F.col("v.summary"), F.col("summary")),
        "key_points": F.coalesce("v.key_points", "key_points"),
        "tags": F.coalesce("v.tags", "tags"),
        "category": ident,
        "category_name": F.when(F.col("v.category_name").isin(*CATEGORY_IDS), category_name(ident)).otherwise(F.col("category_name")),
    }
    return out.select(*[F.when(F.col("v").isNotNull(), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in topics.columns])


def embedding_summaries(articles: DataFrame, told: DataFrame) -> DataFrame:
    """``embedding_summary`` from ``told(article_key, summary)`` - fences removed, collapsed, cut - else the article's own
    leading sentences."""
    clean = F.substring(collapse(F.regexp_replace(full(F.col("_told")), r"```[a-zA-Z]*", " ")), 1, DEFAULT.embed_summary_chars)
    own = extractive_summary(first_of(F.col("full_text"), F.col("content_text"), F.col("content_snippet")))
    out = articles.join(told.select("article_key", F.col("summary").alias("_told")), "article_key", "left")
    return out.withColumn("embedding_summary", first_of(clean, own)).drop("_told")
