"""Sharding and mixing against row-by-row models, and the operators' edge cases: empty tables, very long texts, extra columns."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomwire.llm import lines, minhash, mixing, shards, warc
from loomwire.llm.columns import row_key
from loomwire.session import new_folder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, source=lambda i: "s"):
    return spark.createDataFrame([(i, t, "en", source(i), None if t is None else len(t)) for i, t in enumerate(texts)], DOCS)


@pytest.mark.parametrize("slack", [0.0, 0.25])
def test_walk_equals_rows_one_by_one(slack):
    """A key goes to the first shard clockwise that is not full; all keys look one point further at a time."""
    rng = np.random.default_rng(3)
    for _ in range(30):
        n_shards, total = int(rng.integers(1, 9)), int(rng.integers(0, 200))
        owners = [s for _, s in shards.ring_points(n_shards, 4)]
        arcs = sorted(rng.integers(0, len(owners), total).tolist()) if rng.random() < 0.7 else [1] * total
        limits = shards.capacities(total, n_shards, slack)
        sizes = {a: arcs.count(a) for a in set(arcs)}
        waiting, held, hop = [(a, r) for a in sorted(sizes) for r in range(sizes[a])], {s: [] for s in range(n_shards)}, 0
        while waiting:
            still = []
            for arc, rank in waiting:
                s = owners[(arc + hop) % len(owners)]
                if len(held[s]) < limits[s]:
                    held[s].append((arc, rank))
                else:
                    still.append((arc, rank))
            waiting, hop = still, hop + 1
        wanted = {row: (s, slot) for s, rows in held.items() for slot, row in enumerate(rows)}
        got, pieces = {}, shards.walk(sizes, owners, limits)
        for i, (arc, first, s, slot) in enumerate(pieces):
            stop = min([p[1] for p in pieces[i + 1 :] if p[0] == arc], default=sizes[arc])
            got |= {(arc, r): (s, slot + r - first) for r in range(first, stop)}
        assert got == wanted


def test_shards_equal_the_ring_one_key_at_a_time(spark):
    keys = spark.range(700).selectExpr("if(id % 5 = 0, null, id % 90) AS doc_id", "id AS size").cache()
    points = shards.ring_points(shards.SHARDS, shards.VNODES)
    edges, limits = [p for p, _ in points], shards.capacities(700, shards.SHARDS, 0.0)
    waiting = sorted(int(np.searchsorted(edges, r["h"], "right")) % len(points) for r in keys.select(F.xxhash64("doc_id").alias("h")).collect())
    placed, room, hop = [], list(limits), 0
    while waiting:
        still = []
        for arc in waiting:
            s = points[(arc + hop) % len(points)][1]
            if room[s]:
                room[s] -= 1
                placed.append((arc, s))
            else:
                still.append(arc)
        waiting, hop = still, hop + 1
    got = shards.shard(keys, "doc_id").withColumn("arc", shards.arc_of(F.col("doc_id"), points)).select("arc", "shard").collect()
    assert sorted(map(tuple, got)) == sorted(placed)


def plain_round(rows):
    """Pivotal rounding of ``[size, part, draw]`` one pair at a time; returns what is left with a fraction."""
    left = None
    for row in sorted(rows, key=lambda r: (-r[0], r[2] & (1 << 64) - 1)):
        if not 0 < row[1] < 1:
            continue
        if left is None:
            left = row
            continue
        a, b = left, row
        to_b, to_a = min(a[1] * a[0], (1 - b[1]) * b[0]), min(b[1] * b[0], (1 - a[1]) * a[0])
        u = mixing.uniform(*(np.array([a[2], b[2]], np.int64).view(np.uint64)))
        if u * (to_b + to_a) < to_a:
            moved, (giver, taker) = to_b, (a, b)
        else:
            moved, (giver, taker) = to_a, (b, a)
        giver[1], taker[1] = giver[1] - moved / giver[0], taker[1] + moved / taker[0]
        left = None
        for row in (a, b):
            if 1e-12 < row[1] < 1 - 1e-12:
                left = left or row
            else:
                row[1] = round(row[1])
    return left


def test_mixing_equals_a_sequential_tree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 40)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    rng = np.random.default_rng(4)
    texts = [" ".join("w" * int(rng.integers(0, 30))) for _ in range(900)] + [None, "", "long " * 50_000]
    d = docs(spark, texts, source=lambda i: ["a", "b", None, "c"][i % 7 % 4]).cache()
    got = {r["doc_id"]: r for r in mixing.mix_sources(d).collect()}
    facts = {r["doc_id"]: r for r in d.select("doc_id", "source", row_key().alias("k"), F.xxhash64(F.lit(3), row_key()).alias("h"), F.xxhash64(row_key(), "doc_id").alias("draw"), (F.pmod(F.xxhash64(F.lit(mixing.SEED), F.xxhash64(row_key(), "doc_id")), F.lit(1 << 53)) / float(1 << 53)).alias("lot")).collect()}
    for source in ("a", "b", "c", None):
        mine = [i for i, r in facts.items() if r["source"] == source]
        factor = got[mine[0]]["target"] / got[mine[0]]["source_size"]
        buckets = max(1, -(-len(mine) // 40))
        rows = {i: [got[i]["size"], factor - int(factor + 1e-9), facts[i]["draw"], facts[i]["h"] % buckets] for i in mine}
        for r in rows.values():
            r[1] = r[1] if r[0] and r[1] > 1e-9 else 0.0
        nodes, level = max(1, -(-max(len([i for i in facts if facts[i]["source"] == s]) for s in ("a", "b", "c", None)) // 40)), {i: r[3] for i, r in rows.items()}
        live = dict(rows)
        while True:
            held = {}
            for n in set(level.values()):
                left = plain_round([live[i] for i in live if level[i] == n])
                held |= {i: r for i, r in live.items() if r is left}
            live = held
            if nodes == 1:
                break
            nodes, level = -(-nodes // 3), {i: level[i] // 3 for i in live}
        for i, r in live.items():
            r[1] = 1.0 if facts[i]["lot"] < r[1] else 0.0
        assert {i: got[i]["copies"] for i in mine} == {i: int(factor + 1e-9) + round(rows[i][1]) for i in mine}


def test_empty_tables(spark):
    folder = new_folder(spark, "warc-empty")
    index = warc.write_bundles(warc.archive_records(spark.createDataFrame([], "page_id long, url string, html string")), folder)
    assert index.count() == 0 and warc.read_bundles(index, folder).count() == 0
    none = docs(spark, [])
    assert lines.dedup_lines(none).count() == 0 and lines.without_repeated_lines(none).count() == 0
    assert minhash.drop_near_duplicates(none).count() == 0 and mixing.mix_sources(none).count() == 0


def test_very_long_texts(spark):
    """One line of more than a million characters, and a text of as many short lines, beside small ones."""
    word = lambda i: f"w{i * 7919 % 99991}"
    line = " ".join(word(i) for i in range(170_000))
    d = docs(spark, [line, line + "s", "\n".join(word(i) for i in range(20_000)), "small text of some words here", "small text of some words here"])
    kept = {(r["doc_id"], r["line_no"]): r["kept"] for r in lines.dedup_lines(d).filter("doc_id <> 2").collect()}
    assert kept == {(0, 0): True, (1, 0): False, (3, 0): True, (4, 0): False}
    groups = {r["doc_id"]: r["component"] for r in minhash.grouped(d).collect()}
    assert groups[0] == groups[1] and groups[3] == groups[4] and len({groups[0], groups[2], groups[3]}) == 3


def test_pipeline_takes_very_long_texts(spark, tmp_path):
    words = lambda n, k: " ".join(f"v{(i * k) % 9973}x{i % 13}" for i in range(n))
    rows = docs(spark, [words(60_000, 7), words(300, 11), words(300, 13), None, ""], source=lambda i: "ab"[i % 2])
    folder = f"file://{tmp_path}/sf"
    rows.write.parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.run(spark, folder).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("length").alias("m")).collect()
    got = {r["doc_id"]: r for r in out}
    assert set(got) <= {0, 1, 2} and got and all(r["m"] <= 2048 for r in out)
