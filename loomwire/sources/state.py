"""The engine's state between runs: S6, S7, T2.

A state is a folder of data files and a table of manifests. The rows of a table are dealt to PARTS parts by their key, and a
manifest, written last and in one file, names for each part the files that hold it. A run that dies leaves the old
state standing, one that is retried under its id writes its version again, and a run writes only the parts that it changes.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwire.schemas import STATE
from loomwire.session import drop_folder

#: Parts of a table, and versions whose files are kept; frames of a state that is older can no longer be read.
PARTS, KEEP = 64, 3
#: What the rows of a table are dealt by.
KEYS = {"topics_state": "topic_id", "topic_articles": "article_key", "tombstones": "article_key", "snapshot": "article_key", "run_meta": "version", "topic_pairs": "a", "topic_scored": "topic_id"}
#: A column that a run often sets alike in all rows; such a value is kept in the manifest, so that it changes no part.
COMMON = {"topics_state": "last_merged_at"}
MANIFEST = "version long, written long, common timestamp, parts array<struct<name: string, part: int, rows: long, digest: string, path: string>>"


@dataclass
class State:
    topics_state: DataFrame
    topic_articles: DataFrame
    tombstones: DataFrame
    snapshot: DataFrame
    run_meta: DataFrame
    #: The scores of pairs of topics and what they were scored from; without them the next run scores all pairs.
    topic_pairs: DataFrame | None = None
    topic_scored: DataFrame | None = None


def exists(spark: SparkSession, path: str) -> bool:
    """Through Spark's file systems, so that any store it reads will do."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def manifests(spark: SparkSession, folder: str, n: int) -> list:
    """The last ``n`` manifests, newest first. Each has at most PARTS entries for each table."""
    if not exists(spark, f"{folder}/manifests"):
        return []
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifests").orderBy(F.desc("written")).limit(n).collect()


def current_version(spark: SparkSession, folder: str) -> int | None:
    return next((m["version"] for m in manifests(spark, folder, 1)), None)


def empty_state(spark: SparkSession) -> State:
    return State(**{name: spark.createDataFrame([], schema) for name, schema in STATE.items()})


def load_state(spark: SparkSession, folder: str) -> State:
    """The current state, or an empty one if there is none yet. A state that cannot be read is an error."""
    last = next(iter(manifests(spark, folder, 1)), None)
    if last is None:
        return empty_state(spark)
    out = {}
    for name, schema in STATE.items():
        paths = [f"{folder}/{p['path']}" for p in last["parts"] if p["name"] == name]
        df = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
        if name in COMMON and last["common"] is not None:
            df = df.withColumn(COMMON[name], F.coalesce(COMMON[name], F.lit(last["common"])))
        out[name] = df
    return State(**out)


def _part(name: str) -> Column:
    return F.pmod(F.xxhash64(KEYS[name]), F.lit(PARTS)).cast("int").alias("part")


def save_state(spark: SparkSession, folder: str, run_id: int, state: State) -> dict[str, int]:
    """Write the parts whose rows are not those of the current version, then the manifest. Returns how many parts of each
    table were written. What only versions before the last KEEP refer to is deleted."""
    before = manifests(spark, folder, KEEP + 2)
    held = {(p["name"], p["part"]): p for p in before[0]["parts"]} if before else {}
    low, high, n, known = state.topics_state.agg(F.min(COMMON["topics_state"]), F.max(COMMON["topics_state"]), F.count("*"), F.count(COMMON["topics_state"])).first()
    common = low if low == high and n == known else None
    rows, sums = {}, None
    for name, schema in STATE.items():
        empty = spark.createDataFrame([], schema)
        df = (empty if (given := getattr(state, name)) is None else given).select(*empty.columns)
        if name in COMMON and common is not None:
            df = df.withColumn(COMMON[name], F.lit(None).cast("timestamp"))
        rows[name] = df
        one = df.select(F.lit(name).alias("name"), _part(name), F.xxhash64(*df.columns).cast("decimal(38,0)").alias("h"))
        sums = one if sums is None else sums.unionByName(one)
    now = sums.groupBy("name", "part").agg(F.count("*").alias("rows"), F.sum("h").cast("string").alias("digest")).collect()  # a row a part
    mark, entries, written = f"run={run_id}-{uuid.uuid4().hex[:8]}", [], {}
    for name in STATE:
        mine = [r for r in now if r["name"] == name]
        same = lambda r: (p := held.get((r["name"], r["part"]))) is not None and (p["rows"], p["digest"]) == (r["rows"], r["digest"])
        changed = [r["part"] for r in mine if not same(r)]
        if changed:
            df = rows[name].withColumn("part", _part(name)).filter(F.col("part").isin(*changed))
            df.repartition("part").write.partitionBy("part").parquet(f"{folder}/{name}/{mark}")
        written[name] = len(changed)
        entries += [(name, r["part"], r["rows"], r["digest"], held[name, r["part"]]["path"] if same(r) else f"{name}/{mark}/part={r['part']}") for r in mine]
    order = before[0]["written"] + 1 if before else 0
    spark.createDataFrame([(run_id, order, common, entries)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{folder}/manifests")
    kept = {p[4] for p in entries} | {p["path"] for m in before[: KEEP - 1] for p in m["parts"]}
    for path in {p["path"] for m in before[KEEP - 1 :] for p in m["parts"]} - kept:
        drop_folder(spark, f"{folder}/{path}")
    return written


def write_feed(topics: DataFrame, meta: DataFrame, folder: str, run_id: int) -> None:
    """Topics and the feed's meta row as JSON lines."""
    topics.write.mode("overwrite").json(f"{folder}/run_id={run_id}/topics")
    meta.write.mode("overwrite").json(f"{folder}/run_id={run_id}/meta")
