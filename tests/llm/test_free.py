"""Operators 5 to 10 and the pipeline, against brute force."""

import base64
import hashlib
import itertools
import math
import random
import re
import struct
import zlib

import numpy as np
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from loomwire.llm import lines, minhash, mixing, neighbors, packing, tokens, warc
from loomwire.session import new_folder

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, row_key string"


def docs(spark, texts, source=lambda i: "s", start=0):
    return spark.createDataFrame([(start + i, t, "en", source(i), None if t is None else len(t), "x", "y") for i, t in enumerate(texts)], DOCS)


def shingles(t):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_texts(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(60)]
    out = []
    for _ in range(25):
        base = [word() for _ in range(rng.randint(3, 120))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    out += [" ".join(passage + [word() for _ in range(rng.randint(10, 60))]) for _ in range(30)]
    return out + [None, "", " \n", "One two", "one TWO", out[0].upper(), out[0], "\n".join(out[0].split())]


def components(texts):
    sets = [shingles(t) for t in texts]
    up = list(range(len(texts)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            up[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(texts))], [len(s) for s in sets]


@pytest.mark.parametrize("crowd", [64, 2])
def test_minhash(spark, monkeypatch, crowd):
    monkeypatch.setattr(minhash, "CROWD", crowd)
    texts = near_texts()
    want, sizes = components(texts)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs(spark, texts)).collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert all(got[i]["kept"] == (want[i] == i) for i in got)


def test_minhash_group_without_a_centre(spark):
    """Many copies of one text, most of them near some others only, and sizes down to three quarters."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(120)]
    texts = []
    for _ in range(220):
        copy = list(base)
        for _ in range(rng.randint(1, 9)):
            copy[rng.randrange(len(copy))] = word()
        texts.append(" ".join(copy[: rng.randint(85, 120)]))
    want, _ = components(texts)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs(spark, texts)).collect()}
    assert len(set(want)) > 3 and [got[i] for i in range(len(texts))] == want


def test_minhash_edges(spark):
    d = docs(spark, ["a b c d e f g"] * 3 + [None, ""])
    d = d.unionByName(d).unionByName(d.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    kept = minhash.drop_near_duplicates(d)
    assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 3, 4]
    assert minhash.near_duplicates(d.limit(0)).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        k, o = rng.randrange(len(s)), rng.random()
        if o < 0.34:
            s[k] = rng.choice("abé")
        elif o < 0.67:
            s.insert(k, rng.choice("abé"))
        else:
            del s[k]
    return "".join(s)


def test_edit_distance():
    rng = random.Random(2)
    a = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 80))) for _ in range(800)]
    b = [edited(rng, x, rng.randint(0, 4)) if len(x) > 5 else "" for x in a]
    for tau in (1, 2, 3):
        assert lines.within(a, b, tau).tolist() == [distance(x, y) <= tau for x, y in zip(a, b, strict=True)]


def test_line_links(spark):
    rng = random.Random(3)
    bases = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(20, 60))) for _ in range(30)]
    found = [edited(rng, x, rng.randint(0, 3)) for x in bases for _ in range(4)] + bases
    texts = ["\n".join(found[i : i + 5]) for i in range(0, len(found), 5)] + [None, "", "\n\n", "short\nshort"]
    d = docs(spark, texts)
    rows = lines.dedup_lines(d.unionByName(d.limit(1))).collect()
    assert len(rows) == sum(len(t.split("\n")) for t in [*texts, texts[0]] if t is not None)
    line_of = {(i, k): s for i, t in enumerate(texts) if t is not None for k, s in enumerate(t.split("\n"))}
    long = sorted({s for s in line_of.values() if len(s) >= lines.MIN_CHARS})
    near = {s: {t for t in long if t != s and distance(s, t) <= lines.TAU} for s in long}
    classes: dict = {}
    for r in rows:
        s = line_of[r["doc_id"], r["line_no"]]
        assert r["n_links"] == len(near.get(s, ())), s
        classes.setdefault(r["class_id"], set()).add(s)
    for s in long:
        group, todo = {s}, [s]
        while todo:
            todo += (more := near[todo.pop()] - group)
            group |= more
        assert next(c for c in classes.values() if s in c) == group
    first: dict = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["line_no"])):
        if r["n_chars"] >= lines.MIN_CHARS:
            assert r["kept"] == (first.setdefault(r["class_id"], (r["doc_id"], r["line_no"])) == (r["doc_id"], r["line_no"]))
        else:
            assert r["kept"]


def test_short_line_links(spark):
    rng = random.Random(13)
    bases = ["".join(rng.choice("abcdé文") for _ in range(k)) for k in range(1, 27) for _ in range(3)]
    found = [edited(rng, x, rng.randint(0, min(3, len(x) - 1))) for x in bases for _ in range(3)] + bases + ["Les.", "}", "  ", ""] * 2
    d = docs(spark, [s for s in found if s or rng.random() < 0.5])
    rows = lines.dedup_lines(d).collect()
    text = {r["doc_id"]: r["text"] for r in d.collect()}
    every = sorted({s for s in text.values() if s.strip()})
    near = {s: {t for t in every if t != s and distance(s, t) <= min(2, min(len(s), len(t)) // 8)} for s in every}
    assert any(near[s] for s in every if len(s) < 16) and any(near[s] for s in every if 16 <= len(s) < 24)
    first: dict = {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        s = text[r["doc_id"]]
        assert r["n_links"] == len(near.get(s, ())), s
        assert r["kept"] == (not s.strip() or first.setdefault(r["class_id"], r["doc_id"]) == r["doc_id"]), s
    class_of = {text[r["doc_id"]]: r["class_id"] for r in rows}
    for s in every:
        group, todo = {s}, [s]
        while todo:
            todo += (more := near[todo.pop()] - group)
            group |= more
        assert {t for t in every if class_of[t] == class_of[s]} == group


def test_lines_removed(spark):
    passage = "this line is found in many of the documents, whole"
    texts = [f"own words {i} " * 12 + f"\n{passage}" for i in range(4)] + [passage, None]
    got = {r["doc_id"]: r["text"] for r in lines.without_repeated_lines(docs(spark, texts)).collect()}
    assert got[0] == texts[0] and got[1] == texts[1].split("\n")[0] and got[4] == passage and got[5] is None


def test_lines_removed_whatever_their_share(spark):
    rng = random.Random(12)
    line = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(12))
    shared = [line() for _ in range(4)]
    own = [line() for _ in range(12)]
    texts = ["\n".join([own[i], shared[i]]) for i in range(4)]
    texts.append("\n".join([*shared, "few words here of its own"]))  # 4: assembled from many, near none
    texts.append("\n".join(shared[:2]))  # 5: nothing of its own
    texts.append("\n".join([own[4], shared[0], *own[5:9]]))  # 6: loses a line
    texts.append(texts[6])  # 7: a copy of 6, cut alike
    texts.append("\n".join([*own[4:9], own[9]]))  # 8: near 6 or not, no line of 6 is left twice at the end
    texts.append("\n".join([own[10], own[11], own[10]]))  # 9: repeats itself
    d = docs(spark, texts)
    now = lines.without_repeated_lines(d.unionByName(d.limit(2)))
    rows = now.collect()
    got = {r["doc_id"]: r["text"] for r in rows}
    assert len(rows) == len(texts) + 2 and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert [got[i] for i in range(4)] == texts[:4]
    assert got[4] == "few words here of its own" and got[5] == shared[0]
    assert got[6] == got[7] == "\n".join(own[4:9]) and got[9] == "\n".join(own[10:12])
    left = [r["text"] for r in minhash.drop_near_duplicates(now).collect()]
    found = [s for t in left for s in t.split("\n") if t != shared[0]]
    assert len(found) == len(set(found)) and set(found) == {*shared, *own, "few words here of its own"}


def test_neighbors(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 16)) * rng.uniform(0.5, 2, (600, 1))
    x[300:420] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(600, None), (601, [0.0] * 16), (602, [float("nan")] * 16), (603, [None] * 16), (604, [1.0] * 3), (605, [float("inf")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbors.search(df.withColumn("rank", F.lit("x")), F.col("vec_id") % 20 == 0).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
    hits = total = 0
    for q in range(0, 600, 20):
        s = np.array([math.fsum(a * b for a, b in zip(x[q], v, strict=True)) for v in x])
        best = sorted((i for i in range(600) if i != q), key=lambda i: (-round(s[i], 9), i))[:20]
        mine = sorted(by[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21)) and all(abs(r["score"] - s[r["vec_id"]]) < 1e-9 for r in mine)
        assert [(-r["score"], r["vec_id"]) for r in mine] == sorted((-r["score"], r["vec_id"]) for r in mine)
        hits += len(set(best) & {r["vec_id"] for r in mine})
        total += 20
    assert hits / total >= 0.9 and set(by) == set(range(0, 600, 20))
    assert neighbors.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_neighbors_ties(spark, monkeypatch):
    """More vectors tie with the last place than a block gives out: the least ids win, whatever their hashes."""
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 64)
    monkeypatch.setattr(neighbors, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(9)
    x = rng.standard_normal((300, 8))
    x[:, 0] = 0
    x *= (math.sqrt(0.75) / np.linalg.norm(x, axis=1))[:, None]
    x[:, 0] = 0.5
    rows = [(0, [1.0] + [0.0] * 7)] + [(i + 1, v.tolist()) for i, v in enumerate(x)] + [(i + 1000, v.tolist()) for i, v in enumerate(x[:40])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbors.search(df, F.col("vec_id") == 0, wanted=1.0).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == list(range(1, 21)) and {r["score"] for r in got} == {0.5}


def test_probe_order():
    rng = np.random.default_rng(3)
    for k in (1, 2, 3):
        inside = rng.random(k)
        cost = lambda p: sum((s - f) ** 2 if s > 0 else (f - s - 1) ** 2 if s < 0 else 0 for s, f in zip(p, inside, strict=True))  # noqa: B023, E731
        want = sorted(map(cost, itertools.product(range(-4, 5), repeat=k)))[:50]
        got = neighbors.probe_order(inside, 50).tolist()
        assert [cost(p) for p in got] == pytest.approx(want[: len(got)]) and len({tuple(p) for p in got}) == len(got) == min(50, 9**k)


def test_neighbors_keep_recall_at_the_cap_of_probes(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "MOST_PROBES", 150, raising=False)
    rng = np.random.default_rng(14)
    x = rng.standard_normal((400, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cid long, v array<double>")
    norm = float(np.linalg.norm(x, axis=1).max()) * (1 + 1e-9)
    k, probes = neighbors.fit(df, 16, norm, 1 << 20, 20, 0.97)  # K = 7 for so many rows
    hits = total = 0
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    slots = [neighbors.slots(x, norm, k, t, neighbors.WIDTH) for t in range(neighbors.TABLES)]
    for q in range(0, 400, 8):
        best, seen = np.argsort(-s[q])[:20], set()
        for low, inside in slots:
            steps = {tuple(p) for p in neighbors.probe_order(inside[q], probes).tolist()}
            seen |= {i for i in best.tolist() if tuple((low[i] - low[q]).tolist()) in steps}
        hits, total = hits + len(seen), total + 20
    assert probes <= 150 and hits / total >= 0.93


def test_tokens_equal_the_library():
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(tokens.default_path())
    mine = tokens.encoder(tokens.default_path())
    rng = random.Random(5)
    texts = ["", "a", "Hello  world\n\n x's I'll 12_3 ** é ß² x 日本 \t\t <|endoftext|> don't", "é" * 50]
    texts += ["".join(rng.choice(" \n\tab'sé_12.,$ÄÀ²½中") for _ in range(200)) for _ in range(60)]
    texts += ["hello <|endoftext|> x", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", "<|endoftext", "é <|endoftext|>\n", "".join(map(chr, range(700)))]
    for t in texts:
        ids = tool.encode(t, add_special_tokens=False).ids
        assert mine.encode(t) == struct.pack(f"<{len(ids)}I", *ids)


def test_packing(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["alpha", "bez", "c", "Ünder", "<|endoftext|>"]) for _ in range(rng.choice([1, 5, 50, 300, 900, 2500, 9000]))) for _ in range(150)] + [None, ""]
    d = docs(spark, texts)
    got = packing.pack_documents(d.unionByName(d.limit(3))).collect()
    from tokenizers import Tokenizer

    library, known = Tokenizer.from_file(tokens.default_path()), {}
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        known[i] = struct.pack(f"<{len(ids)}I", *ids)
    held: dict = {}
    for r in got:
        ids = known[r["doc_id"]]
        assert zlib.crc32(ids[4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"] and 1 <= r["length"] <= 2048
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in held.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 2048
    total = sum(r["length"] for r in got)
    assert total == sum(len(known[i]) // 4 for i in [*range(len(texts)), 0, 1, 2])
    bins: list[int] = []
    for length in sorted((r["length"] for r in got), reverse=True):  # best fit decreasing, piece by piece
        fits = [i for i, used in enumerate(bins) if used + length <= 2048]
        if fits:
            bins[max(fits, key=bins.__getitem__)] += length
        else:
            bins.append(length)
    assert math.ceil(total / 2048) <= len(held) <= len(bins) * 1.01 + 1
    assert all(r["length"] == 2048 for r in got if r["piece"] > 0)
    assert packing.pack_documents(d.limit(0)).count() == 0


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 500)
    html = ["<p>é\r\n\r\n</p>" * 30, None, "", "same", "same", "x" * 3000, "same"]
    rows = [(i, f"http://h/{i}\n", h) for i, h in enumerate(html)] + [(3, "http://again", "same"), (None, None, "x" * 3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("copy", F.lit("x"))
    folder = new_folder(spark, "warc-test")
    index = warc.write_bundles(warc.archive_records(pages), folder)
    back = warc.read_bundles(index, folder).collect()
    assert len(back) == len(rows)
    for r in back:
        data = (next(h for p, _, h in rows if p == r["page_id"]) or "").encode()
        assert r["payload_bytes"] == len(data) and r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert bytes(r["payload"] or b"") == (data if r["record_type"] == "response" else b"")
    kinds = sorted((r["page_id"] if r["page_id"] is not None else 99, r["copy"], r["record_type"], r["refers_to"]) for r in back)
    assert kinds == [
        (0, 0, "response", None), (1, 0, "response", None), (2, 0, "revisit", 1), (3, 0, "response", None), (3, 1, "revisit", 3), (4, 0, "revisit", 3),
        (5, 0, "response", None), (6, 0, "revisit", 3), (99, 0, "revisit", 5),
    ]
    one = index.filter("page_id = 5")
    assert warc.read_bundles(one, folder).first()["payload_bytes"] == 3000
    fs, root = pafs.FileSystem.from_uri(folder)
    for name in {r["bundle"] for r in index.collect()}:
        frames = warc.seek_table(fs, f"{root}/{name}")
        assert {f[0] for f in frames} == {r["frame_start"] for r in index.filter(F.col("bundle") == name).collect()}


def test_mixing(spark):
    rng = random.Random(7)
    names = ["a", "b", "c", "d", None]
    texts = [" ".join("w" for _ in range(rng.randint(0, 60))) for _ in range(3000)] + [None]
    d = docs(spark, texts, source=lambda i: names[min(4, int(rng.random() ** 2 * 5))])
    d = d.unionByName(d.limit(20))
    got = mixing.mix_sources(d).collect()
    again = mixing.mix_sources(d.repartition(7)).collect()
    assert len(got) == 3021 and sorted(map(str, got)) == sorted(map(str, again))
    taken: dict = {}
    for r in got:
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        one = r["target"], r["source_size"]
        taken[one] = taken.get(one, 0) + r["taken"]
    assert sum(t for t, _ in taken) == pytest.approx(sum(s for _, s in taken)) and len(taken) == 5
    assert all(abs(n - t) <= 60 and t <= 3 * s + 1e-6 for (t, s), n in taken.items())
    made = mixing.mixed_documents(d)
    assert made.columns == d.columns and made.select(F.sum(F.size(F.split("text", " ")))).first()[0] == sum(taken.values())
    assert mixing.mix_sources(d.limit(0)).count() == 0


def test_targets():
    assert mixing.targets([10, 10, 10], [5, 2, 1]) == pytest.approx([18.75, 7.5, 3.75])
    assert mixing.targets([1, 100, 100], [5, 2, 1]) == pytest.approx([3, 132, 66])
    assert mixing.targets([], []) == [] and mixing.targets([0, 0], [5, 2]) == [0, 0]


def test_source_plan(spark):
    rng = random.Random(17)
    names = [f"s{k:03d}" for k in range(150)] + ["Z", "é", "", "文"]
    rows = [(n, rng.choice([0, 1, 5, 40, 900])) for n in names for _ in range(3)] + [(None, 7)]
    got = mixing.source_plan(spark.createDataFrame(rows, "_source string, size long")).collect()
    order = sorted(names, key=lambda n: n.encode()) + [None]
    sizes = [sum(x for m, x in rows if m == n) for n in order]
    want = mixing.targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(order))])
    by = {r["source"]: r for r in got}
    assert [by[n]["sid"] for n in order] == list(range(len(order))) and [by[n]["source_size"] for n in order] == sizes
    assert [by[n]["target"] for n in order] == pytest.approx(want)
    assert mixing.source_plan(spark.createDataFrame([], "_source string, size long")).count() == 0


def test_pivotal_keeps_expectation():
    size = np.array([3, 5, 7, 11, 2, 9], float)
    mean = np.zeros(6)
    for k in range(4000):
        keys = np.array([hash((k, i)) for i in range(6)], np.int64)
        out = mixing.settle(size, np.full(6, 0.4), keys)
        assert abs((out * size).sum() - 0.4 * size.sum()) < 1e-6 and sum(0 < x < 1 for x in out) <= 1
        mean += out
    assert np.abs(mean / 4000 - 0.4).max() < 0.04


def test_pipeline(spark, tmp_path):
    """Whole stages over copies, repeated rows, nulls, and columns that clash with the operators' own."""
    import corpus_pipeline

    rng = random.Random(8)
    own = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(40))
    texts = [own() for _ in range(60)]
    texts += [texts[0]] * 5 + [texts[1] + " end", "too short", None, ""]
    d = docs(spark, texts, source=lambda i: "ab"[i % 2]).withColumns({"copies": F.lit("c"), "_d": F.lit("d"), "_KIND": F.lit("k"), "gone": F.lit("g")})
    d = d.unionByName(d.filter("doc_id IN (2, 3)"))
    d.write.parquet(f"{tmp_path}/documents.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == d.columns
        rows = now.collect()
        assert {(r["node"], r["row_key"], r["copies"], r["_d"], r["_KIND"], r["gone"]) for r in rows} == {("x", "y", "c", "d", "k", "g")}
        seen.append(sorted(r["doc_id"] for r in rows))
    assert seen[0] == sorted([*range(66), 2, 3]) and seen[1] == seen[0] and seen[2] == list(range(60))
    assert set(seen[3]) <= set(range(60))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in packed) == seen[3]


def test_pipeline_on_nothing(spark, tmp_path):
    import corpus_pipeline

    docs(spark, []).drop("node", "row_key").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_packing_keeps_columns(spark):
    items = spark.createDataFrame([(i, 1 + i * 37 % 2048, "a", 7) for i in range(300)], "rank long, length long, _kind string, _c int")
    got = packing.pack(items)
    assert got.columns == [*items.columns, "sequence_id", "offset"]
    assert sorted(map(tuple, got.select(*items.columns).collect())) == sorted(map(tuple, items.collect()))


def test_signatures_compile_to_machine_code(spark, capsys):
    docs = spark.createDataFrame([(1, "a line of some length\nanother line\nshort one")], "doc_id long, text string")
    lines.signatures(lines.long_lines(docs)).explain("codegen")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000  # the JVM only interprets longer methods
