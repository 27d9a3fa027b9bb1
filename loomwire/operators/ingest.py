"""Sources and articles: S1-S5, F1, J4."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwire.config import DEFAULT, DEFAULT_CATEGORY, DEFAULT_CONTENT_TYPE
from loomwire.functions.fingerprints import event_fingerprint
from loomwire.functions.text import article_id, article_key, category_id, content_digest, first_of, full, slugify, title_hash
from loomwire.functions.times import has_offset, parse_time, published_raw
from loomwire.functions.urls import normalize_url, url_host


def given(df: DataFrame, name: str, kind: str) -> Column:
    """A column that an input may lack."""
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def normalize_sources(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every optional field of a source filled in; returns sources and rejected ones with the reason.

    A source with start_urls crawls, any other is a feed; feeds need feed_url (or the older url), crawls start_urls.
    """
    starts = F.coalesce(given(df, "start_urls", "array<string>"), F.array().cast("array<string>"))
    kind = first_of(F.lower(F.trim(full(given(df, "type", "string")))), F.when(F.size(starts) > 0, "crawl").otherwise("rss"))
    name = given(df, "name", "string")
    url = first_of(given(df, "feed_url", "string"), given(df, "url", "string"))
    no_list = F.array().cast("array<string>")
    cap = F.coalesce(given(df, "max_items", "int"), given(df, "max_articles", "int"), F.lit(DEFAULT.max_items_per_source))
    out = df.select(
        first_of(given(df, "id", "string"), slugify(name)).alias("id"), first_of(name, F.lit("Source")).alias("name"), kind.alias("type"),
        first_of(given(df, "lang", "string"), F.lit("en")).alias("lang"), first_of(given(df, "category", "string"), F.lit(DEFAULT_CATEGORY)).alias("category"),
        F.coalesce(given(df, "enabled", "boolean"), F.lit(True)).alias("enabled"), F.coalesce(given(df, "priority", "int"), F.lit(100)).alias("priority"),
        cap.alias("max_items"), F.coalesce(given(df, "strip_query_params", "array<string>"), no_list).alias("strip_query_params"), url.alias("feed_url"),
        starts.alias("start_urls"), F.coalesce(given(df, "allowed_domains", "array<string>"), no_list).alias("allowed_domains"),
        F.coalesce(given(df, "include_patterns", "array<string>"), no_list).alias("include_patterns"),
        F.coalesce(given(df, "exclude_patterns", "array<string>"), no_list).alias("exclude_patterns"),
        F.coalesce(given(df, "max_pages", "int"), F.lit(DEFAULT.crawl_pages)).alias("max_pages"),
    )
    reason = (
        F.when(~F.col("type").isin("rss", "crawl"), "unknown type")
        .when((F.col("type") == "rss") & (F.col("feed_url") == ""), "no feed_url")
        .when((F.col("type") == "crawl") & (F.size("start_urls") == 0), "no start_urls")
    )
    marked = out.withColumn("reason", reason)
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL")


def enabled_sources(sources: DataFrame) -> DataFrame:
    """S2."""
    return sources.filter("enabled")


def source_type_counts(sources: DataFrame) -> DataFrame:
    """Enabled sources of each type."""
    return enabled_sources(sources).groupBy("type").agg(F.count("*").alias("n"))


def with_source(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """Feed entries with their source's fields. The dimension is joined without a hint: AQE broadcasts it by size."""
    names = ["name", "type", "lang", "category", "max_items", "strip_query_params"]
    dim = sources.select(F.col("id").alias("source_id"), *[F.col(n).alias(f"source_{n}") for n in names])
    return entries.join(dim, "source_id")


def build_articles(entries: DataFrame, sources: DataFrame, run_ts: Column) -> DataFrame:
    """S3: article records from ``entries`` (source_id, link, title, published, content_text, snippet, image, canonical_url;
    all but the first three may be missing). Entries whose id would be empty are left out."""
    e = with_source(entries, sources)
    strip = F.col("source_strip_query_params")
    text = full(given(entries, "content_text", "string"))
    raw = given(entries, "published", "string")
    # in steps, so that each address is normalised once
    e = e.withColumns({"_link": normalize_url(F.col("link"), strip), "_canonical": normalize_url(given(entries, "canonical_url", "string"), strip)})
    e = e.withColumn("_link", first_of(F.col("_link"), F.trim(full(F.col("link")))))
    e = e.withColumn("_canonical", first_of(F.col("_canonical"), F.col("_link")))
    snippet = first_of(F.substring(text, 1, DEFAULT.snippet_chars), F.substring(full(given(entries, "snippet", "string")), 1, DEFAULT.snippet_chars))
    out = e.select(
        article_id(F.col("_canonical"), F.col("title"), F.col("source_id")).alias("id"), F.trim(full(F.col("title"))).alias("title"),
        F.col("_link").alias("link"), F.col("_canonical").alias("canonical_url"), F.col("source_name").alias("source"), "source_id", "source_type",
        url_host(F.col("_canonical")).alias("source_host"), "source_lang", F.col("source_category").alias("category_hint"),
        category_id(F.col("source_category")).alias("category_id"), full(given(entries, "image", "string")).alias("image"),
        F.coalesce(parse_time(raw), run_ts).alias("published"), published_raw(raw).alias("published_raw"), has_offset(raw).alias("has_offset"),
        text.alias("content_text"), snippet.alias("content_snippet"), F.lit("").alias("article_summary"),
        F.array().cast("array<string>").alias("article_tags"), F.lit(None).cast("int").alias("relevance_score"), F.lit("").alias("relevance_reason"),
        F.lit(DEFAULT_CONTENT_TYPE).alias("content_type"), F.lit(True).alias("is_relevant"), F.lit(False).alias("is_sensitive"),
        content_digest(first_of(text, snippet)).alias("content_hash"), F.col("_canonical").alias("dedup_key"),
        F.lit("").alias("full_text"), F.lit("").alias("embedding_summary"),
    )
    return out.filter("id IS NOT NULL")


def attach_keys(articles: DataFrame) -> DataFrame:
    """title_hash, normalized_url and article_key."""
    url = normalize_url(first_of(F.col("canonical_url"), F.col("link")))
    with_parts = articles.withColumns({"title_hash": title_hash(F.col("title")), "normalized_url": url})
    return with_parts.withColumn("article_key", article_key(F.col("source"), F.col("normalized_url"), F.col("title_hash")))


def attach_fingerprints(articles: DataFrame, run_ts: Column) -> DataFrame:
    """event_fingerprint (C17)."""
    c = F.col
    made = event_fingerprint(c("title"), c("article_summary"), c("embedding_summary"), c("content_snippet"), c("source"), c("published"), run_ts)
    return articles.withColumn("event_fingerprint", made)


def cap_per_source(entries: DataFrame, order: list[Column], cap: Column | int = DEFAULT.max_items_per_source) -> DataFrame:
    """The first ``cap`` entries of each source that have a link and a title."""
    good = entries.filter((F.trim(full(F.col("link"))) != "") & (F.trim(full(F.col("title"))) != ""))
    ranked = good.withColumn("_n", F.row_number().over(Window.partitionBy("source_id").orderBy(*order)))
    return ranked.filter(F.col("_n") <= cap).drop("_n")


def union_sources(*frames: DataFrame) -> DataFrame:
    """Articles of all kinds of sources; a column that one lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def keep_relevant(articles: DataFrame) -> DataFrame:
    """relevant and not sensitive, newest first."""
    kept = articles.filter(F.coalesce(F.col("is_relevant"), F.lit(True)) & ~F.coalesce(F.col("is_sensitive"), F.lit(False)))
    return kept.orderBy(F.desc("published"), "id")
