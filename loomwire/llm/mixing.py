"""Operator 10, mixing sources to target weights by pivotal dependent rounding.

Every document of a source is wanted ``factor`` = target / size times. The whole part is certain; the fraction is
rounded dependently: two documents meet, words move from one's fraction to the other's until one is integral, in a
direction drawn so that each keeps its expectation. The words of the pair never change, so a source misses its target
by what the last fraction leaves. Buckets of a source settle among themselves, and the one fraction each leaves goes
up a reduction tree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwire.llm.columns import aside, row_key, sized, table, word_count
from loomwire.llm.hashing import mix
from loomwire.session import cut

WEIGHTS, MOST = (5.0, 2.0, 1.0), 3.0
BUCKET_ROWS, FAN_IN, SEED = 2048, 256, 20240229


def targets(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Words wanted of each source: shares of all words by weight, at most ``most`` times what there is; what is cut off
    is shared again by weight until nobody is above."""
    want, left, open_ = [0.0] * len(sizes), float(sum(sizes)), set(range(len(sizes)))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = {i for i in open_ if weights[i] * unit > most * sizes[i]}
        if not over:
            for i in open_:
                want[i] = weights[i] * unit
            break
        for i in sorted(over):
            want[i] = most * sizes[i]
            left -= want[i]
        open_ -= over
    return want


def uniform(a: np.uint64, b: np.uint64) -> float:
    x = mix(np.array([a], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(np.array([b], np.uint64) + np.uint64(SEED)))
    return float(x[0] >> np.uint64(11)) / 2.0**53


def settle(size: np.ndarray, part: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Pivotal rounding of ``part`` (in 0..1), large documents first so that what is left over is small.

    The keys seed the draws. At most one entry of the result is neither 0 nor 1."""
    out = part.astype(float)
    keys = key.view(np.uint64)
    order = np.lexsort((keys, -size))
    held = -1
    with np.errstate(over="ignore"):
        for j in order.tolist():
            if not 0.0 < out[j] < 1.0:
                continue
            if held < 0:
                held = j
                continue
            i, si, sj = held, float(size[held]), float(size[j])
            give, take = min(out[i] * si, (1.0 - out[j]) * sj), min(out[j] * sj, (1.0 - out[i]) * si)
            if uniform(keys[i], keys[j]) * (give + take) < take:
                whole = give == out[i] * si
                out[i], out[j] = (0.0, out[j] + give / sj) if whole else (out[i] - give / si, 1.0)
            else:
                whole = take == out[j] * sj
                out[i], out[j] = (out[i] + take / si, 0.0) if whole else (1.0, out[j] - take / sj)
            held = next((x for x in (i, j) if 1e-12 < out[x] < 1.0 - 1e-12), -1)
            for x in (i, j):
                if x != held:
                    out[x] = round(out[x])
    return out


def _round_group(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.assign(part=settle(pdf["size"].to_numpy(), pdf["part"].to_numpy(), pdf["draw"].to_numpy()))


def numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with ``sid``, their place in code point order of ``_source``, null last: a range for each task, whose counts
    give where the next one starts."""
    order = [F.col("_source").isNull(), F.col("_source")]
    dealt = cut(sources.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before, start = {}, 0
    for r in sorted(dealt.groupBy("_part").agg(F.count("*").alias("n")).collect()):  # a row for each partition
        before[r["_part"]], start = start, start + r["n"]
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    starts = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else F.create_map(F.lit(0), F.lit(0))
    return dealt.withColumn("sid", F.element_at(starts, F.col("_part")) + place).drop("_part")


def source_plan(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``(source, sid, source_size, target, factor, buckets)`` of ``rows(_source, size)``: what :func:`targets` says, for any number
    of sources. A source's part is its weight times a unit that grows from round to round as sources reach their bound;
    the driver sees whole numbers by weight only, so reruns agree."""
    found = numbered(rows.groupBy("_source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("sid", F.lit(len(weights))))
    found = cut(found.withColumn("w", weight))
    unit, bound = 0.0, -1
    while True:
        over = F.col("w") * unit > most * F.col("source_size")
        sums = found.groupBy("w").agg(  # a row for each weight
            F.sum("source_size").alias("size"), F.count("*").alias("n"), F.sum(F.when(over, F.col("source_size")).otherwise(0)).alias("taken"), F.sum(over.cast("long")).alias("over")
        ).orderBy("w").collect()
        if (now := sum(r["over"] for r in sums)) == bound:
            break
        bound, open_ = now, sum(r["w"] * (r["n"] - r["over"]) for r in sums)
        unit = (sum(r["size"] for r in sums) - most * sum(r["taken"] for r in sums)) / open_ if open_ else unit
    target = F.least(F.col("w") * unit, most * F.col("source_size"))
    factor = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0)
    buckets = F.greatest(F.lit(1), F.ceil(F.col("n") / BUCKET_ROWS)).cast("int")
    return found.select(F.col("_source").alias("source"), "sid", "source_size", target.alias("target"), factor.alias("factor"), buckets.alias("buckets"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """One row per row of ``docs``: doc_id, row_key, size (words), source_size, target (its source's), copies, taken.

    Sources in code point order, null last, weigh ``weights`` in turn. Null and blank texts have size 0 and are
    taken 0 times over their whole part; a corpus without words has targets 0. Rows that repeat are rounded one by one.
    Draws depend on the documents and the seed alone, so reruns agree whatever the partitions.
    """
    rows = cut(docs.select("doc_id", row_key().alias("row_key"), F.col("source").alias("_source"), word_count(F.col("text")).alias("size")))
    plan = cut(source_plan(rows, weights, most))
    known = plan.agg(F.count("*").alias("sources"), F.max("buckets").alias("buckets")).first()
    joined = rows.join(sized(plan, known["sources"]), rows["_source"].eqNullSafe(plan["source"]))
    whole = F.floor(F.col("factor") + 1e-9)
    part = F.greatest(F.lit(0.0), F.col("factor") - whole)
    shape = "doc_id long, row_key long, size long, sid int, node long, source_size long, target double, whole long, part double, draw long"
    start = joined.select(
        "doc_id", "row_key", "size", "sid", F.pmod(F.xxhash64(F.lit(3), "row_key"), F.col("buckets").cast("long")).alias("node"), "source_size", "target",
        whole.cast("long").alias("whole"), F.when((F.col("size") > 0) & (part > 1e-9), part).otherwise(0.0).alias("part"), F.xxhash64("row_key", "doc_id").alias("draw"),
    )
    done = cut(start.groupBy("sid", "node").applyInPandas(_round_group, shape))
    is_open = (F.col("part") > 0) & (F.col("part") < 1)
    settled, open_ = [done.filter(~is_open)], done.filter(is_open)
    nodes = known["buckets"] or 1
    while nodes > 1:
        nodes = -(-nodes // FAN_IN)
        up = open_.withColumn("node", F.floor(F.col("node") / FAN_IN).cast("long"))
        done = cut(up.groupBy("sid", "node").applyInPandas(_round_group, shape))
        settled.append(done.filter(~is_open))
        open_ = done.filter(is_open)
    # one fraction a source is left: a last draw
    lot = F.pmod(F.xxhash64(F.lit(SEED), "draw"), F.lit(1 << 53)) / float(1 << 53)
    settled.append(open_.withColumn("part", F.when(lot < F.col("part"), 1.0).otherwise(0.0)))
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    copies = F.col("whole") + F.round("part").cast("long")
    return out.select("doc_id", "row_key", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with every row as often as the mix takes it; documents without words are left out."""
    docs, back = aside(docs, ["row_key", "copies", "n", "copy"])
    counts = cut(mix_sources(docs, **how).groupBy("row_key").agg(F.sum(F.when(F.col("size") > 0, F.col("copies")).otherwise(0)).alias("copies"), F.count("*").alias("n")))
    keyed = docs.withColumn("row_key", row_key())
    out = keyed.join(counts.filter("n = 1 AND copies > 0"), "row_key")
    again = counts.filter("n > 1 AND copies > 0")
    if n := again.count():
        out = out.unionByName(keyed.join(sized(again, n), "row_key").dropDuplicates(["row_key"]))
    return back(out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns))


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of each."""
    return mix_sources(table(spark, sf_dir, "documents")).drop("row_key")
