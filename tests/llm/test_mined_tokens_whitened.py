"""Operators 11, 12 and 13 against plain computations, with their edge cases."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomwire.llm import negatives, token_files, tokens, whitening
from loomwire.session import drop_folder, new_folder

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, Key string, x string"


def plain_negatives(rows, every=50):
    """The contract, row by row; ``rows``: (vec_id, embedding, label)."""
    kept = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        kept.append((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * float(np.float32(c))) for c in v)))
    kept = sorted(set(kept))
    out = []
    for i, label, x in kept:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), j, other) for j, other, y in kept if j != i and len(x) == len(y))
        for p, positive, other in [s for s in scored if s[2] == label][:5]:
            inside = [s for s in scored if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p]
            out += [(i, positive, r + 1, n, -p, -s) for r, (s, n, _) in enumerate(inside[:3])]
    return sorted(out)


def mined(df):
    return sorted(tuple(r) for r in negatives.mine(df).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 5, 7), (33, 64, 65), (70, 3, 90), (64, 64, 64), (5, 0, 4)])
def test_strassen_is_exact_with_any_sides(shape):
    rng = np.random.default_rng(sum(shape))
    a, b = rng.integers(-(1 << 27), 1 << 27, (shape[0], shape[1])), rng.integers(-(1 << 27), 1 << 27, (shape[2], shape[1]))
    wanted = [[sum(int(p) * int(q) for p, q in zip(x, y, strict=True)) for y in b] for x in a]
    assert negatives.strassen(a, b, leaf=2).tolist() == wanted


def test_scores_that_do_not_fit_are_an_error():
    with pytest.raises(OverflowError):
        negatives.scores(np.array([[1 << 33]]), np.array([[1 << 33]]))


def test_negatives_with_ties_copies_nulls_and_lengths(spark, monkeypatch):
    for name, value in (("ANCHORS", 4), ("CANDIDATES", 16), ("AT_ONCE", 3), ("LEAF", 2)):
        monkeypatch.setattr(negatives, name, value)
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.integers(0, 3, 6) / 4.0], int(rng.integers(0, 3))) for i in range(300)]
    rows += [(i, [0.25] * 6, 1) for i in range(300, 420)]  # one vector that a third of all rows share
    rows += [(450, [0.5] * 6, None), (500, None, 1), (550, [0.5, None, 0.5, 0.5, 0.5, 0.5], 1), (600, [0.5, float("nan")] * 3, 1), (650, [float("inf")] * 6, 1), (None, [0.5] * 6, 1)]
    rows += [(700, [0.5, 0.5], 1), (701, [0.5, 0.5], 1), (702, [0.5, 0.4], 2), (50, rows[50][1], rows[50][2]), (750, [], 1), (751, [], 2), (752, [], 1)]
    assert mined(spark.createDataFrame([(*r, "k", "x") for r in rows], VECTORS)) == plain_negatives(rows)


def test_negatives_of_an_empty_table(spark):
    assert mined(spark.createDataFrame([], VECTORS)) == []


def test_word_encoder_gives_the_librarys_ids():
    fast, library = tokens.word_encoder(tokens.word_path()), Tokenizer.from_file(tokens.word_path())
    letters = [chr(c) for c in range(0x250)]
    texts = [t for c in letters for t in (c, f"a{c}B{c}{c} 1{c}'s{c}", f"x_{c}12 {c.upper()}")]
    texts += ["", "It's  we've\n\tDON'T 12.5", "naïve café ǅ", "日本語 text", "áb", "<|endoftext|> end", "word " * 3000, "w" * 5000, "\x85a\xa0b c"]
    for text in texts:
        assert np.frombuffer(fast.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text[:40])


def plain_tokens(rows):
    library, at, out = Tokenizer.from_file(tokens.word_path()), 0, []
    for doc_id, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def written(df, monkeypatch=None):
    folder = new_folder(df.sparkSession, "tokens-test")
    files = token_files.write_tokens(df, folder)
    return folder, files, token_files.read_tokens(files, folder, docs_a_task=7)


def test_tokens_of_many_files_in_order(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    folder, files, read = written(docs)
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    assert sorted(map(tuple, read.collect())) == plain_tokens(rows)
    # one document by its offset, and files that know their dictionary
    fs, root = pafs.FileSystem.from_uri(folder)
    dictionary, first = token_files.load_dictionary(fs, root), files.orderBy("file").first()["file"]
    reader = token_files.TokenReader(fs, root, first, dictionary)
    place = len(reader.entries) // 2
    text = dict(rows)[int(reader.entries["doc_id"][place])]
    assert reader.ids_of(place).tolist() == [*Tokenizer.from_file(tokens.word_path()).encode(text, add_special_tokens=False).ids, 2]
    assert len(dictionary.held.as_bytes()) <= token_files.DICTIONARY_BYTES
    with pytest.raises(ValueError, match="another dictionary"):
        token_files.TokenReader(fs, root, first, token_files.Dictionary(b"something else"))
    drop_folder(spark, folder)


def test_tokens_with_nulls_repeats_and_long_texts(spark):
    rows = [(3, "three"), (1, None), (2, ""), (5, "a <|endoftext|> b"), (4, "long word " * 200_000), (9, "same"), (9, "same"), (None, "no id")]
    folder, _, read = written(spark.createDataFrame([(*r, "f", 1) for r in rows], "doc_id long, text string, file string, start int"))
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert sorted(map(tuple, read.collect()), key=lambda r: r[1]) == plain_tokens(rows)
    drop_folder(spark, folder)


def test_tokens_of_an_empty_table(spark):
    folder, _, read = written(spark.createDataFrame([], "doc_id long, text string"))
    assert read.collect() == []
    drop_folder(spark, folder)


@pytest.mark.parametrize("dims", [1, 2, 3, 7, 40])
def test_leading_eigenpairs(dims):
    x = np.random.default_rng(dims).standard_normal((50, dims))
    v = x.T @ x / 50
    values, axes = whitening.leading(v, 4)
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:4], rtol=1e-13, atol=1e-14)
    assert np.abs(v @ axes.T - axes.T * values).max() < 1e-12 and np.abs(axes @ axes.T - np.eye(len(axes))).max() < 1e-13


@pytest.mark.parametrize("matrix", [np.zeros((5, 5)), np.eye(6), np.diag([3.0, 3, 3, 3 - 1e-9, 1]), np.ones((4, 4)), np.kron(np.eye(3), np.array([[2.0, 1], [1, 2]]))])
def test_eigenpairs_of_clusters_are_apart(matrix):
    values, axes = whitening.leading(matrix, 4)
    assert np.abs(matrix @ axes.T - axes.T * values).max() < 1e-12 and np.abs(axes @ axes.T - np.eye(len(axes))).max() < 1e-12


def plain_whitening(x):
    listed = np.unique(x, axis=0)
    n, s = len(listed), listed.sum(axis=0)
    v = np.cov(listed.T.astype(float), bias=True).reshape(x.shape[1], -1)
    e, a = np.linalg.eigh(v)
    e, a = e[::-1][:4], a.T[::-1][:4]
    return n, [sum((n * int(c) - int(t)) ** 2 for c, t in zip(r, s, strict=True)) for r in x], (x - s / n) @ a.T / np.sqrt(e), e / np.trace(v)


def test_whitening_of_a_table(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    vectors = vectors.unionByName(vectors.filter("vec_id < 40").withColumn("vec_id", F.col("vec_id") + 100_000))  # copies count once in the fit
    got = whitening.whiten(vectors).toPandas().sort_values(["vec_id", "component"])
    rows = vectors.orderBy("vec_id").collect()
    n, deviation, whitened, explained = plain_whitening(np.floor(256 * np.array([r["embedding"] for r in rows])).astype(int))
    assert set(got["n"]) == {n} and got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-9
    assert got["deviation"].tolist() == np.repeat(np.array(deviation), 4).tolist() == [int(d) for d in got["deviation_exact"]]
    assert np.allclose(np.abs(got["whitened"].to_numpy().reshape(-1, 4)), np.abs(whitened), atol=1e-9)
    assert np.allclose(got["explained"].to_numpy().reshape(-1, 4), explained, rtol=1e-10)


def test_whitening_with_nulls_lengths_and_too_few_vectors(spark):
    rows = [(1, [0.5, 0.25, 0.0], "a"), (2, [0.5, 0.25, 0.0], "a"), (3, [0.25, 0.5, 0.0], None), (4, [1.0, 2.0], "b"), (5, None, "c"), (6, [None, 1.0], "c"), (7, [float("nan")] * 3, "c"), (8, [], "c"), (None, [0.5, 0.25, 0.0], "a")]
    got = whitening.whiten(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, x string, dims int")).toPandas()
    three = got[got["vec_id"].isin([1, 2, 3]) | got["vec_id"].isna()]
    assert len(got) == 4 * 3 + 2 and set(three["n"]) == {2} and set(three["component"]) == {1, 2, 3}
    first = three[three["component"] == 1]
    assert np.allclose(np.abs(first["whitened"].to_numpy()), 1) and three[three["component"] > 1]["whitened"].isna().all()
    one = got[got["vec_id"] == 4]
    assert one["whitened"].isna().all() and one["explained"].isna().all() and set(one["deviation"]) == {0}
    assert whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_a_deviation_beyond_a_long_is_null_but_known(spark):
    vectors = spark.createDataFrame([(i, [float(i) * 1e7]) for i in range(12)], "vec_id long, embedding array<double>")
    got = whitening.whiten(vectors).toPandas()
    x = [int(256 * i * 1e7) for i in range(12)]
    assert {int(d) for d in got["deviation_exact"]} == {(12 * v - sum(x)) ** 2 for v in x}
    assert got["deviation"].isna().any()
