"""Operator 13, whitening of embeddings onto their leading components.

Counts, sums and the centred covariance are aggregates over the distinct integer vectors. The covariance of each vector
length, a table of its squared length, is decomposed in one task: Householder reflections bring it to three diagonals,
counting sign changes (Sturm) halves the interval of each leading eigenvalue, and inverse iteration finds the
components, kept apart inside clusters of near eigenvalues. The few components are broadcast to project all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwire.llm.columns import sized, table
from loomwire.session import Workspace, stored

COMPONENTS = 4
#: Steps of inverse iteration; each gains many digits, so a few are ample.
STEPS = 6
#: Eigenvalues nearer than this share of the largest one form a cluster, and smaller ones than RANK of the largest count as zero.
CLUSTER, RANK = 1e-3, 1e-12
SEED = 13
MODEL = "dims int, trace double, parts array<struct<component: int, axis: array<double>, value: double>>"


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(diagonal, off, q)`` with q' matrix q of these diagonals: one Householder reflection for each column."""
    a, n = np.array(matrix, dtype=float), len(matrix)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k]
        length = np.linalg.norm(x)
        if not np.any(x[1:]) or length == 0:
            continue
        v = x.copy()
        v[0] += np.copysign(length, x[0])
        v /= np.linalg.norm(v)
        a[k + 1 :, k:] -= 2.0 * np.outer(v, v @ a[k + 1 :, k:])
        a[:, k + 1 :] -= 2.0 * np.outer(a[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2.0 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def above(diagonal: np.ndarray, off: np.ndarray, x: float) -> int:
    """How many eigenvalues are larger than ``x``: the positive terms of the Sturm sequence's quotients."""
    scale = max(np.abs(diagonal).max(), np.abs(off).max() if len(off) else 0.0)
    least, count, d = max(np.finfo(float).tiny, np.finfo(float).eps * scale * 1e-8), 0, 1.0
    squares = np.r_[0.0, off * off]
    for a, b in zip((diagonal - x).tolist(), squares.tolist(), strict=True):
        d = a - b / d
        if abs(d) < least:
            d = -least
        count += d > 0
    return count


def eigenvalue(diagonal: np.ndarray, off: np.ndarray, k: int) -> float:
    """The ``k``-th largest eigenvalue (from 0): its interval is halved until no number lies between its ends."""
    reach = np.abs(np.r_[0.0, off]) + np.abs(np.r_[off, 0.0])
    low, high = float((diagonal - reach).min()), float((diagonal + reach).max())
    while True:
        middle = low + (high - low) / 2
        if middle in (low, high):
            return middle
        if above(diagonal, off, middle) > k:
            low = middle
        else:
            high = middle


def solve(diagonal: np.ndarray, off: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x with (three diagonals) x = b by elimination with row exchange; a vanishing pivot is made tiny, as inverse iteration wants."""
    n = len(diagonal)
    tiny = max(np.finfo(float).eps * max(np.abs(diagonal).max(), np.abs(off).max() if n > 1 else 0.0), 1e-290)
    main, up, up2, x = diagonal.astype(float).tolist(), [*off.tolist(), 0.0], [0.0] * n, b.astype(float).tolist()
    for i in range(n - 1):
        under = float(off[i])
        if abs(under) > abs(main[i]):  # the lower row leads
            rest = main[i] / under
            main[i], up[i], main[i + 1], up2[i], up[i + 1] = under, main[i + 1], up[i] - rest * main[i + 1], up[i + 1], -rest * up[i + 1]
            x[i], x[i + 1] = x[i + 1], x[i] - rest * x[i + 1]
        else:
            main[i] = main[i] if abs(main[i]) > tiny else tiny
            rest = under / main[i]
            main[i + 1] -= rest * up[i]
            x[i + 1] -= rest * x[i]
    main[-1] = main[-1] if abs(main[-1]) > tiny else tiny
    for i in range(n - 1, -1, -1):
        x[i] -= (up[i] * x[i + 1] if i + 1 < n else 0.0) + (up2[i] * x[i + 2] if i + 2 < n else 0.0)
        x[i] /= main[i]
        if abs(x[i]) > 1e100:  # keep the scale; only the direction matters
            x = [v * 1e-100 for v in x]
    x = np.array(x)
    return x / np.abs(x).max()


def leading(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues of a symmetric matrix, falling, and unit eigenvectors as rows; the largest entry of each
    is positive."""
    diagonal, off, q = tridiagonal(matrix)
    count = min(count, len(diagonal))
    values = np.array([eigenvalue(diagonal, off, k) for k in range(count)])
    rng, vectors = np.random.Generator(np.random.PCG64(SEED)), []
    near = CLUSTER * max(abs(values[0]), np.finfo(float).tiny) if count else 0.0
    for k in range(count):
        cluster = [j for j in range(k) if abs(values[j] - values[k]) <= near]
        x = rng.standard_normal(len(diagonal))
        for _ in range(STEPS):
            for _ in range(2):  # twice is enough
                for j in cluster:
                    x = x - (x @ vectors[j]) * vectors[j]
            x = solve(diagonal - values[k], off, x / np.linalg.norm(x))
            x = x / np.linalg.norm(x)
        for _ in range(2):
            for j in cluster:
                x = x - (x @ vectors[j]) * vectors[j]
            x = x / np.linalg.norm(x)
        vectors.append(x)
    axes = np.array([q @ x for x in vectors]).reshape(count, len(diagonal))
    signs = np.sign(axes[np.arange(count), np.abs(axes).argmax(axis=1)]) if count else np.ones(0)
    return values, axes * signs[:, None]


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """``(vec_id, x)``, x = floor(256 v) as longs, of rows whose vector is not null, not empty and has finite components only."""
    v = F.col("embedding")
    whole = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & (F.size(v) > 0)
    return vectors.filter(F.coalesce(whole, F.lit(False))).select("vec_id", F.transform(v, lambda c: F.floor(c.cast("double") * 256)).alias("x"))


def _decompose(count: int):
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        dims = int(pdf["dims"].iat[0])
        v = np.zeros((dims, dims))
        v[pdf["i"], pdf["j"]] = v[pdf["j"], pdf["i"]] = pdf["c"]
        values, axes = leading(v, count)
        trace = float(np.trace(v))
        parts = [{"component": k + 1, "axis": a.tolist(), "value": float(e) if e > RANK * trace else 0.0} for k, (e, a) in enumerate(zip(values, axes, strict=True))]
        return pd.DataFrame({"dims": [dims], "trace": [trace], "parts": [parts]})

    return one


def _products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each length the sums of products of centred entries: one matrix a task, given out as its upper half."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for dims, rows in batch.groupby("dims"):
            x = np.array(rows["x"].tolist(), dtype=float) - np.array(rows["mean"].iat[0])
            sums[dims] = sums.get(dims, 0.0) + x.T @ x
    for dims, m in sums.items():
        i, j = np.triu_indices(dims)
        yield pd.DataFrame({"dims": np.full(len(i), dims), "i": i, "j": j, "c": m[i, j]})


def fit(x: DataFrame, space: Workspace, count: int = COMPONENTS) -> DataFrame:
    """The model of the distinct vectors ``x``, one row for each length: ``dims, n, sums, mean, trace, parts`` (each component with
    its axis and eigenvalue) and ``identity_error``."""
    listed = space.store(x.select("x").distinct().withColumn("dims", F.size("x")), "distinct")
    sums = listed.select("dims", F.posexplode("x").alias("d", "e")).groupBy("dims", "d").agg(F.sum("e").alias("s"), F.count("*").alias("n"))
    basis = sums.groupBy("dims").agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("d", "s"))), lambda e: e["s"]).alias("sums"))
    basis = space.store(basis.withColumn("mean", F.transform("sums", lambda s: s.cast("double") / F.col("n"))), "basis")
    centred = listed.join(sized(basis.select("dims", "mean"), basis.count()), "dims")
    products = centred.mapInPandas(_products, "dims int, i int, j int, c double").groupBy("dims", "i", "j").agg(F.sum("c").alias("c"))
    cov = products.join(basis.select("dims", "n"), "dims").withColumn("c", F.col("c") / F.col("n"))
    model = space.store(basis.join(cov.groupBy("dims").applyInPandas(_decompose(count), MODEL), "dims"), "components")
    return space.store(model.join(identity_errors(listed, model), "dims", "left"), "model")


def projected(x: DataFrame, model: DataFrame) -> DataFrame:
    """``x`` (dims, x) with its row of the model and ``whitened``, a number for each component, null where that has no variance."""
    dot = lambda axis: F.aggregate(F.zip_with(F.zip_with("x", "mean", lambda e, m: e.cast("double") - m), axis, lambda e, w: e * w), F.lit(0.0), lambda s, p: s + p)
    whitened = F.transform("parts", lambda p: F.when(p["value"] > 0, dot(p["axis"]) / F.sqrt(p["value"])))
    return x.join(sized(model, model.count()), "dims").withColumn("whitened", whitened)


def identity_errors(listed: DataFrame, model: DataFrame) -> DataFrame:
    """``(dims, identity_error)``: the largest difference between the whitened list's covariance and the identity."""
    whitened = projected(listed, model).select("dims", "whitened")
    means = whitened.select("dims", F.posexplode("whitened").alias("i", "w")).filter("w IS NOT NULL").groupBy("dims", "i").agg(F.avg("w").alias("m"))
    means = means.groupBy("dims").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda e: e["m"]).alias("ms"))  # those with variance come first
    held = whitened.join(sized(means, means.count()), "dims").select("dims", F.transform(F.sequence(F.lit(1), F.size("ms")), lambda i: F.element_at("whitened", i) - F.element_at("ms", i)).alias("ws"))
    one = held.select("dims", "ws", F.posexplode("ws").alias("i", "a"))
    cov = one.select("dims", "i", "a", F.posexplode("ws").alias("j", "b")).filter("i <= j").groupBy("dims", "i", "j").agg(F.avg(F.col("a") * F.col("b")).alias("c"))
    return cov.groupBy("dims").agg(F.max(F.abs(F.col("c") - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))).alias("identity_error"))


def whiten(vectors: DataFrame, count: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact`` of ``vectors`` (vec_id, embedding).

    Rows whose vector is null, empty, or holds a null or non-finite entry are left out; other columns are not looked at, a
    null vec_id stays null, repeated rows come out as often as they are. Vectors of different lengths have a fit each. A
    component without variance (all vectors equal, fewer distinct vectors than components) has a null ``whitened`` and
    is not part of ``identity_error``; ``explained`` is null where nothing varies. ``deviation`` is null where a long cannot
    hold it; ``deviation_exact`` holds it then too. An entry beyond a long is an error. An empty table gives no rows.
    """
    space = Workspace(vectors.sparkSession, "whitening")
    x = space.store(integer_vectors(vectors).withColumn("dims", F.size("x")), "rows")
    model = fit(x, space, count)
    # the sum over (n x - S)^2 from three whole numbers: n^2 x.x - 2 n x.S + S.S
    whole = lambda c: c.cast("decimal(19,0)")
    exact = lambda c: c.cast("decimal(38,0)")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: exact(whole(p) * whole(q))), exact(F.lit(0)), lambda s, p: exact(s + p))
    n, xx, xs = whole(F.col("n")), dot("x", "x"), dot("x", "sums")
    deviation = exact(exact(exact(n * n) * xx) - exact(exact(2 * n) * xs) + F.col("squares"))
    each = projected(x, model.withColumn("squares", dot("sums", "sums"))).withColumn("deviation_exact", deviation)
    each = each.select("vec_id", "n", "trace", "identity_error", "deviation_exact", F.posexplode("parts").alias("at", "part"), "whitened")
    rows = each.select(
        "vec_id", "part.component", "n", "deviation_exact", F.get("whitened", "at").alias("whitened"), F.when(F.col("trace") > 0, F.col("part.value") / F.col("trace")).alias("explained"), "identity_error"
    )
    out = stored(rows.withColumn("deviation", F.col("deviation_exact").try_cast("long")), "whitened")
    space.close()
    return out


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    """All embeddings on their four leading components."""
    return whiten(table(spark, sf_dir, "embeddings"))
