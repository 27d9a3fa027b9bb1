"""The engine's inputs made from the test tables, each as a DataFrame and as the same SELECT in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwire.functions.vectors import vec_normalize
from loomwire.operators.ingest import attach_keys, build_articles, normalize_sources

RUN_TS = "2024-01-11 00:00:00"


def run_ts():
    return F.lit(RUN_TS).cast("timestamp")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; times without zone are UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed entries from documents: the first line is the title, times spread over ten days."""
    d = read(spark, sf_dir, "documents")
    minutes = F.pmod(F.col("doc_id") * 7919, F.lit(14400))
    ts = F.timestamp_seconds(F.lit(1704067200) + minutes * 60)
    return d.select(
        "doc_id", F.col("source").alias("source_id"), F.concat(F.lit("https://"), "source", F.lit(".example.com/a/"), F.col("doc_id")).alias("link"),
        F.substring(F.substring_index("text", "\n", 1), 1, 120).alias("title"), F.col("text").alias("content_text"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss").alias("published"), "lang",
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = read(spark, sf_dir, "documents").groupBy("source").agg(F.min("lang").alias("lang"))
    return normalize_sources(raw.select(F.col("source").alias("id"), F.col("source").alias("name"), "lang", F.concat(F.lit("https://"), "source", F.lit(".example.com/feed")).alias("url")))[0]


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed articles; ``doc_id`` is found again at the end of the link."""
    made = attach_keys(build_articles(entries(spark, sf_dir), sources(spark, sf_dir), run_ts()))
    return made.withColumn("doc_id", F.regexp_extract("link", r"/a/(\d+)$", 1).cast("long"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, v)``: near-duplicate vectors, fifty directions with noise."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    base = e.filter("vec_id < 50").select(F.col("vec_id").alias("b"), F.col("embedding").alias("x"))
    both = e.join(base, F.pmod("vec_id", F.lit(50)) == F.col("b"))
    noisy = F.zip_with("x", "embedding", lambda x, y: x.cast("double") + 0.6 * y.cast("double"))
    return both.select(F.col("vec_id").alias("id"), vec_normalize(noisy).alias("v"))


def raw_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), vec_normalize(F.col("embedding")).alias("v"))
