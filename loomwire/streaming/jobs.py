"""Structured Streaming jobs: S9, T3, T6, T7, T8."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomwire.config import DEFAULT
from loomwire.functions.times import BUCKET_SECONDS
from loomwire.plans.runs import run
from loomwire.sources.state import current_version, load_state, save_state


def stream_articles(spark: SparkSession, folder: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A stream over Parquet files that arrive in ``folder``."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def stream_ingest(articles: DataFrame, watermark: str = "3 days") -> DataFrame:
    """Of articles that repeat a key within the watermark the first. Only this stage forgets; assignment to topics drops
    nothing as late, age lowers its score."""
    return articles.withWatermark("published", watermark).dropDuplicatesWithinWatermark(["article_key"])


def stream_bucket_counts(events: DataFrame, keys: list[str], ts: str = "published", watermark: str = "72 hours") -> DataFrame:
    """Rows of each six hours and key."""
    counted = events.withWatermark(ts, watermark).groupBy(F.window(ts, f"{BUCKET_SECONDS} seconds"), *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("bucket"), *keys, "n")


def stream_fusion(articles: DataFrame, vectors: Callable[[DataFrame], DataFrame | None], folder: str, checkpoint: str, run_ts: Callable[[int], Column], **how) -> StreamingQuery:
    """Every micro-batch is a run against the state in ``folder``. A batch that is replayed starts from the version
    before it and writes its own version again, so it counts once."""

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if current_version(spark, folder) == batch_id:
            return
        old = load_state(spark, folder)
        state, _ = run(batch, vectors(batch), old, run_ts(batch_id), **how)
        save_state(spark, folder, batch_id, state)

    return articles.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _remember(key: tuple, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """State of a key: when its block ends (milliseconds). Evictions set it, articles ask for it, and it goes when the
    watermark has passed it; keys that were never evicted have none."""
    nothing = pd.DataFrame({"article_key": pd.Series([], dtype=str), "ts": pd.Series([], dtype="datetime64[ns]"), "blocked": pd.Series([], dtype=bool)})
    if state.hasTimedOut:
        state.remove()
        yield nothing
        return
    before = until = state.get[0] if state.exists else -1
    out = []
    batch = pd.concat(list(rows)).sort_values(["ts", "evicted"], ascending=[True, False])
    for ts, evicted in zip(batch["ts"], batch["evicted"], strict=True):
        now = int(ts.timestamp() * 1000)
        if evicted:
            until = max(until, now + DEFAULT.tombstone_ttl_days * 86_400_000)
        else:
            out.append((key[0], ts, now < until))
    if until > before:
        state.update((until,))
    if state.exists and until > state.getCurrentWatermarkMs():
        state.setTimeoutTimestamp(until)
    elif state.exists:
        state.remove()
    yield pd.DataFrame(out, columns=["article_key", "ts", "blocked"]) if out else nothing


def stream_block(articles: DataFrame, evictions: DataFrame, watermark: str = "3 days") -> DataFrame:
    """``(article_key, ts, blocked)`` for a stream of articles beside a stream of evictions, both ``(article_key, ts)``.

    A key stays blocked for the tombstones' time to live after its eviction; within a batch rows count in time order,
    evictions first. Rows later than ``watermark`` are left out, and state is kept for evicted keys only, until the watermark passes
    the end of their block.
    """
    both = articles.select("article_key", "ts", F.lit(False).alias("evicted")).unionByName(evictions.select("article_key", "ts", F.lit(True).alias("evicted")))
    timed = both.withWatermark("ts", watermark)
    return timed.groupBy("article_key").applyInPandasWithState(_remember, "article_key string, ts timestamp, blocked boolean", "until long", "append", "EventTimeTimeout")
