"""The feed's queries over topics: F4, F5, F6, W6, W7, A14, C25."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwire.functions.text import full
from loomwire.functions.times import display_time


def by_category(topics: DataFrame, category: str) -> DataFrame:
    """``all`` filters nothing."""
    return topics if category == "all" else topics.filter(F.col("category") == category)


def by_sources(topics: DataFrame, names: list[str]) -> DataFrame:
    """topics that any of ``names`` reported; no names filter nothing."""
    return topics.filter(F.exists("sources", lambda s: s["name"].isin(*names))) if names else topics


def sort_keys(mode: str) -> list[Column]:
    """W6. ``most-sources`` sorts by the number of articles, as the feed always did."""
    newest = [F.desc("published"), F.col("id")]
    return {"newest": newest, "oldest": [F.asc("published"), F.col("id")], "most-sources": [F.desc("article_count"), *newest]}[mode]


def sort_topics(topics: DataFrame, mode: str = "newest") -> DataFrame:
    return topics.orderBy(*sort_keys(mode))


def featured(topics: DataFrame, mode: str = "newest") -> DataFrame:
    """The first topic with an image and several articles, else with an image, else the first."""
    image = full(F.col("image")) != ""
    return topics.orderBy(F.when(image & (F.col("article_count") > 1), 0).when(image, 1).otherwise(2), *sort_keys(mode)).limit(1)


def grid(topics: DataFrame, chosen: DataFrame) -> DataFrame:
    """the topics but the featured one."""
    return topics.join(chosen.select("id"), "id", "left_anti")


def source_names(topics: DataFrame, n: int) -> DataFrame:
    """The distinct sources of a topic in the order seen, and the first ``n`` of them."""
    names = F.array_distinct(F.transform("sources", lambda s: s["name"]))
    return topics.select("id", names.alias("names"), F.slice(names, 1, n).alias("shown"))


def feed_view(topics: DataFrame, category: str = "all", sources: list[str] | None = None, mode: str = "newest") -> DataFrame:
    """The feed as a reader asks for it."""
    out = by_sources(by_category(topics, category), sources or [])
    return sort_topics(out, mode).withColumn("shown_at", display_time(F.col("published")))
