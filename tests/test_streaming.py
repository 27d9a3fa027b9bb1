"""Streams against batches: S9, T3, T6, T7, T8, and the functions that only whole runs use."""

import datetime as dt

from pyspark.sql import functions as F

from loomwire.operators import cluster as cl
from loomwire.operators import state as st
from loomwire.operators import topics as tp
from loomwire.operators import verdicts as vd
from loomwire.plans.runs import run
from loomwire.session import new_folder
from loomwire.sources import fixtures as fx
from loomwire.sources.state import current_version, empty_state, load_state, save_state, write_feed
from loomwire.streaming import jobs

DAY = dt.timedelta(days=1)
START = dt.datetime(2024, 1, 1)


def in_batches(spark, batches, schema):
    """A folder with one file for each batch, to be read in their order."""
    folder = new_folder(spark, "stream-in")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return folder


def drained(df, name, spark, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", new_folder(spark, "mark")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    return spark.table(name).collect()


def test_ingest_forgets_after_the_watermark(spark):
    kind = "article_key string, published timestamp, n int"
    batches = [[("a", START, 1), ("a", START, 2), ("b", START, 3)], [("a", START + DAY, 4), ("c", START + 20 * DAY, 5)], [("d", START + 21 * DAY, 7)], [("a", START + 22 * DAY, 6)]]
    stream = jobs.stream_articles(spark, in_batches(spark, batches, kind), spark.createDataFrame([], kind).schema, 1)
    rows = drained(jobs.stream_ingest(stream), "ingested", spark)
    assert sorted(r["article_key"] for r in rows) == ["a", "a", "b", "c", "d"] and {r["n"] for r in rows if r["article_key"] == "a"} & {6}


def test_bucket_counts_equal_the_batch(spark):
    kind = "published timestamp, source string"
    rows = [[(START + dt.timedelta(hours=5 * i + 100 * b), "xy"[i % 2]) for i in range(20)] for b in range(3)] + [[(START + 60 * DAY, "end")]]
    stream = jobs.stream_articles(spark, in_batches(spark, rows, kind), spark.createDataFrame([], kind).schema, 1)
    got = {(r["bucket"], r["source"]): r["n"] for r in drained(jobs.stream_bucket_counts(stream, ["source"]), "buckets", spark)}
    want: dict = {}
    for ts, source in sum(rows[:3], []):
        at = dt.datetime.fromtimestamp(ts.replace(tzinfo=dt.UTC).timestamp() // 21600 * 21600, dt.UTC).replace(tzinfo=None)
        want[at, source] = want.get((at, source), 0) + 1
    assert sum(got.values()) == sum(want.values()) == 60 and sorted(got.values()) == sorted(want.values())


def test_blocks_end(spark):
    kind = "article_key string, ts timestamp, evicted boolean"
    batches = [
        [("a", START, True), ("b", START, False), ("a", START + DAY, False)], [("a", START + 29 * DAY, False), ("c", START + 29 * DAY, True)],
        [("a", START + 31 * DAY, False), ("z", START + 80 * DAY, False)], [("a", START + 81 * DAY, False), ("c", START + 81 * DAY, False)],
    ]
    stream = jobs.stream_articles(spark, in_batches(spark, batches, kind), spark.createDataFrame([], kind).schema, 1)
    rows = drained(jobs.stream_block(stream.filter("NOT evicted"), stream.filter("evicted")), "blocks", spark)
    got = {(r["article_key"], (r["ts"] - START).days): r["blocked"] for r in rows}
    assert got == {("b", 0): False, ("a", 1): True, ("a", 29): True, ("a", 31): False, ("z", 80): False, ("a", 81): False, ("c", 81): False}


def articles(spark):
    """Sixteen articles of four events, keyed as the engine keys them."""
    a = fx.articles(spark, "/root/testdata/sf0.001").filter("doc_id < 16").withColumn("id", F.col("doc_id").cast("string"))
    v = spark.createDataFrame([(str(i), [float(i % 4 == k) + 0.01 * i for k in range(4)]) for i in range(14)], "id string, v array<double>")
    return a, v


def test_streamed_runs_equal_batches(spark):
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        streamed_runs_equal_batches(spark)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)


def streamed_runs_equal_batches(spark):
    a, v = articles(spark)
    parts = [a.filter(f"doc_id % 2 = {k}") for k in range(2)]
    source = new_folder(spark, "articles")
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(source)
    streamed, batched = new_folder(spark, "streamed"), new_folder(spark, "batched")
    stream = jobs.stream_articles(spark, source, a.schema, 1)
    query = jobs.stream_fusion(stream, lambda batch: v, streamed, new_folder(spark, "mark"), lambda n: fx.run_ts())
    query.awaitTermination(600)
    assert query.exception() is None and current_version(spark, streamed) == 1
    for n, part in enumerate(parts):
        state, _ = run(part, v, load_state(spark, batched), fx.run_ts())
        save_state(spark, batched, n, state)
    seen = lambda folder: sorted(map(str, load_state(spark, folder).topics_state.select("topic_id", "article_count", "published", "source_set", "entity_set", F.round("cluster_confidence", 6)).collect()))
    keys = lambda folder: sorted(map(tuple, load_state(spark, folder).topic_articles.collect()))
    assert keys(streamed) == keys(batched) and len(keys(streamed)) == 16 and seen(streamed) == seen(batched)


def test_what_runs_use(spark, tmp_path):
    rows = [("1", "x", 3), ("1", "y", 3), ("2", "z", 1)]
    members = spark.createDataFrame([(c, f"{c}{i}", i) for c, _, n in {r[0]: r for r in rows}.values() for i in range(n)], "cluster_id string, id string, local_index int")
    assert [tuple(r) for r in cl.largest_clusters(members).collect()] == [("1", 3)]
    groups = spark.createDataFrame([("a", 2, 0.6, 1), ("b", 2, 0.9, 2), ("c", 1, 0.6, 3), ("d", 9, 0.78, 4)], "cluster_id string, size int, confidence double, newest int")
    assert [r["cluster_id"] for r in vd.second_queue(groups).collect()] == ["d", "a"]
    valid = spark.createDataFrame([("1", False), ("2", True)], "group_id string, valid boolean")
    told = spark.createDataFrame([("1", 0, 0, 0.9), ("1", 1, 1, 0.2), ("2", 0, 0, 0.4)], "group_id string, group_no int, local_index int, confidence double")
    got = {r["id"]: (r["cluster_id"], r["confidence"]) for r in vd.apply_split_verdicts(members, valid, told).collect()}
    assert got == {"10": ("10", 0.9), "11": ("11", 0.3), "12": ("12", 0.5), "20": ("2", None)}
    left = spark.createDataFrame([("k", "", "old"), ("m", "t", "old")], "article_key string, title string, text string")
    more = spark.createDataFrame([("k", "new", "")], "article_key string, title string, text string")
    assert sorted(map(tuple, vd.enrich(left, more, "article_key", ["title", "text"]).collect())) == [("k", "new", "old"), ("m", "t", "old")]
    tombs = spark.createDataFrame([("k", START, START), ("n", START, START)], "article_key string, evicted_at timestamp, expired_at timestamp")
    assert [r["article_key"] for r in st.drop_active(tombs, left.select(F.lit("t").alias("topic_id"), "article_key")).collect()] == ["n"]
    assert st.run_stats(a=left, b=tombs).first().asDict() == {"a": 2, "b": 2}
    write_feed(left, more, f"file://{tmp_path}/feed", 3)
    assert spark.read.json(f"file://{tmp_path}/feed/run_id=3/topics").count() == 2
    assert load_state(spark, f"file://{tmp_path}/none").run_meta.count() == empty_state(spark).run_meta.count() == 0


def test_topic_edges_by_verdict(spark):
    pairs = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.64), ("a", "c", 0.63), ("d", "e", 0.65), ("f", "g", 0.64), ("h", "i", 0.62), ("j", "k", 0.63)], "a string, b string, score double")
    told = spark.createDataFrame(
        [("c", "b", True, 0.9, None), ("d", "e", False, 0.9, None), ("f", "g", True, 0.6, None), ("g", "f", False, 0.9, True), ("h", "i", True, 0.6, None), ("h", "i", True, 0.7, True)],
        "topic_a string, topic_b string, merge boolean, confidence double, strict boolean",
    )
    assert sorted(map(tuple, tp.topic_merge_edges(pairs, told).collect())) == [("a", "b"), ("b", "c"), ("h", "i")]
    assert sorted(map(tuple, tp.topic_merge_edges(pairs).collect())) == [("a", "b")]
