"""Operator 11, hard negatives: for an anchor and each of its positives the best rows of other labels within a window.

Rows are dealt to tiles of anchors and tiles of candidates by a hash, whatever their label, so no label makes a task
large. A task multiplies two tiles with Strassen's recursion over 64-bit integers and keeps a few rows for each anchor:
first the best of its own label, merged over all tiles; then, with the positives' scores known, the best within
each positive's window, merged in the same way.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwire.llm.columns import table
from loomwire.session import Workspace, stored

POSITIVES, NEGATIVES = 5, 3
#: Anchors and candidates of a tile, anchors whose scores are looked through at once, and the side from which on tiles are halved.
ANCHORS, CANDIDATES, AT_ONCE, LEAF = 1024, 4096, 256, 32
NONE = np.iinfo(np.int64).min


def _even(x: np.ndarray) -> np.ndarray:
    return np.pad(x, ((0, x.shape[0] % 2), (0, x.shape[1] % 2)))


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of ``a`` with ``b`` transposed, both int64 with rows of one length.

    Sides are filled with zeros to an even length and halved, seven products taking the place of eight, until one is at most
    ``leaf``. Sums and products wrap at 64 bits, which is a ring, so whatever happens between, an entry that fits is exact.
    """
    rows, columns = len(a), len(b)
    if min(rows, columns, a.shape[1]) <= leaf:
        return a @ b.T
    a, b = _even(a), _even(b)
    r, c, k = len(a) // 2, len(b) // 2, a.shape[1] // 2
    a11, a12, a21, a22 = a[:r, :k], a[:r, k:], a[r:, :k], a[r:, k:]
    b11, b21, b12, b22 = b[:c, :k], b[:c, k:], b[c:, :k], b[c:, k:]  # quarters of the transposed matrix, each lying
    out = np.zeros((2 * r, 2 * c), np.int64)
    ul, ur, ll, lr = out[:r, :c], out[:r, c:], out[r:, :c], out[r:, c:]
    for x, y, plus, minus in (
        (a11 + a22, b11 + b22, (ul, lr), ()),
        (a21 + a22, b11, (ll,), (lr,)),
        (a11, b12 - b22, (ur, lr), ()),
        (a22, b21 - b11, (ul, ll), ()),
        (a11 + a12, b22, (ur,), (ul,)),
        (a21 - a11, b11 + b12, (lr,), ()),
        (a12 - a22, b21 + b22, (ul,), ()),
    ):
        product = strassen(x, y, leaf)
        for part in plus:
            part += product
        for part in minus:
            part -= product
    return out[:rows, :columns]


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows; an error where one might not fit 64 bits."""
    most = lambda x: max((abs(int(x.min())), abs(int(x.max())))) if x.size else 0
    if most(a) * most(b) * a.shape[1] >= 1 << 63:
        raise OverflowError("inner products of these vectors do not fit a 64-bit integer")
    return strassen(a, b)


def best_columns(s: np.ndarray, n: int) -> np.ndarray:
    """Columns of the ``n`` largest entries of each row, largest first, of equal ones the first; -1 where only NONE is left.
    ``s`` is used up."""
    out, every = np.full((len(s), n), -1), np.arange(len(s))
    for k in range(min(n, s.shape[1])):
        at = s.argmax(axis=1)
        out[:, k] = np.where(s[every, at] == NONE, -1, at)
        s[every, at] = NONE
    return out


def integer_rows(vectors: DataFrame) -> DataFrame:
    """``(vec_id, label, x, key)`` of the rows that take part, x = floor(256 v); rows equal in all of it count once, and
    ``key`` tells apart rows of one id."""
    v = F.col("embedding")
    whole = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    good = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(whole, F.lit(False)))
    rows = good.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform(v, lambda c: F.floor(c.cast("double") * 256)).alias("x"))
    return rows.distinct().withColumn("key", F.xxhash64("vec_id", "label", "x"))


def _groups(left: pd.DataFrame, right: pd.DataFrame, columns: list[str]):
    """``(rows of left, rows of right)`` of each value of ``columns`` that both have, as places."""
    mine, theirs = left.groupby(columns, sort=True).indices, right.groupby(columns, sort=True).indices
    for value in mine:
        if value in theirs:
            yield mine[value], np.sort(theirs[value])


def _matrix(rows: pd.DataFrame, at: np.ndarray) -> np.ndarray:
    return np.array([rows["x"].iat[i] for i in at], dtype=np.int64).reshape(len(at), -1)


def _ordered(candidates: pd.DataFrame) -> pd.DataFrame:
    return candidates.sort_values(["vec_id", "key"], ignore_index=True)


def _best_positives(anchors: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
    out, candidates = [], _ordered(candidates)
    ids = candidates["vec_id"].to_numpy()
    for mine, theirs in _groups(anchors, candidates, ["label", "width"]):
        x = _matrix(candidates, theirs)
        for low in range(0, len(mine), AT_ONCE):
            some = mine[low : low + AT_ONCE]
            s = scores(_matrix(anchors, some), x)
            s[anchors["vec_id"].to_numpy()[some][:, None] == ids[theirs][None, :]] = NONE
            held = s.copy()
            best = best_columns(s, POSITIVES)
            row, place = np.nonzero(best >= 0)
            at = best[row, place]
            out.append(pd.DataFrame({"anchor_id": anchors["vec_id"].to_numpy()[some][row], "anchor_key": anchors["key"].to_numpy()[some][row], "positive_id": ids[theirs][at], "positive_key": candidates["key"].to_numpy()[theirs][at], "positive_score": held[row, at]}))
    return pd.concat(out) if out else pd.DataFrame({c: pd.Series([], dtype="int64") for c in ("anchor_id", "anchor_key", "positive_id", "positive_key", "positive_score")})


def _best_negatives(anchors: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
    out, candidates = [], _ordered(candidates)
    ids, labels = candidates["vec_id"].to_numpy(), candidates["label"].to_numpy()
    for mine, theirs in _groups(anchors, candidates, ["width"]):
        x = _matrix(candidates, theirs)
        for low in range(0, len(mine), AT_ONCE):
            some = mine[low : low + AT_ONCE]
            s = scores(_matrix(anchors, some), x)
            own = anchors.iloc[some]
            s[(own["label"].to_numpy()[:, None] == labels[theirs][None, :]) | (own["vec_id"].to_numpy()[:, None] == ids[theirs][None, :])] = NONE
            windows = [[int(p) for p in bounds] for bounds in own["bounds"]]
            for j in range(max(map(len, windows))):
                rows = np.flatnonzero([len(w) > j for w in windows])
                bound = [windows[i][j] for i in rows]
                least, most = np.array([-(-p // 2) for p in bound])[:, None], np.array([19 * p // 20 for p in bound])[:, None]
                mine_only = s[rows]
                held = np.where((mine_only >= least) & (mine_only <= most), mine_only, NONE)
                best = best_columns(held, NEGATIVES)
                row, place = np.nonzero(best >= 0)
                at = best[row, place]
                out.append(pd.DataFrame({"anchor_id": own["vec_id"].to_numpy()[rows][row], "anchor_key": own["key"].to_numpy()[rows][row], "positive_score": np.array(bound, np.int64)[row], "negative_id": ids[theirs][at], "negative_key": candidates["key"].to_numpy()[theirs][at], "negative_score": mine_only[row, at]}))
    return pd.concat(out) if out else pd.DataFrame({c: pd.Series([], dtype="int64") for c in ("anchor_id", "anchor_key", "positive_score", "negative_id", "negative_key", "negative_score")})


def _first(rows: DataFrame, by: list[str], score: str, row: str, n: int) -> DataFrame:
    """The ``n`` best rows of each ``by``. Spark cuts each task's rows to ``n`` before the shuffle, so a group is at most
    ``n`` rows for each task that found some."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), f"{row}_id", f"{row}_key")
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def mine(vectors: DataFrame, is_anchor=None) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of ``vectors`` (vec_id, embedding,
    label), the anchors being the rows that satisfy ``is_anchor`` (default: ids divisible by 50).

    Rows with a null id, label or vector, or a null or non-finite component, take no part; other columns are not looked at.
    Rows equal in id, label and integer vector count once; of an id with several of these each is an anchor and a candidate by
    itself, but no row meets one of its own id. Only vectors of one length meet. Ties go to the smaller id. A score that
    does not fit 64 bits is an error. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    space = Workspace(spark, "negatives")
    rows = space.store(integer_rows(vectors).withColumn("width", F.size("x")), "rows")
    chosen = rows.filter(F.col("vec_id") % 50 == 0 if is_anchor is None else is_anchor)
    tiles = lambda df, most: max(1, -(-df.count() // most))
    left, right = tiles(chosen, ANCHORS), tiles(rows, CANDIDATES)
    tile = lambda n: F.pmod(F.col("key"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    there = rows.withColumn("right", tile(right)).withColumn("left", each(left))
    here = lambda df: df.withColumn("left", tile(left)).withColumn("right", each(right))
    met = lambda df, found, kind: here(df).groupBy("left", "right").cogroup(there.groupBy("left", "right")).applyInPandas(found, kind)
    positive = met(chosen, _best_positives, "anchor_id long, anchor_key long, positive_id long, positive_key long, positive_score long")
    positive = space.store(_first(positive, ["anchor_id", "anchor_key"], "positive_score", "positive", POSITIVES).drop("place", "positive_key"), "positives")
    bounds = positive.groupBy("anchor_key", F.col("anchor_id").alias("vec_id")).agg(F.collect_set("positive_score").alias("bounds")).withColumnRenamed("anchor_key", "key")  # at most POSITIVES
    asked = space.store(chosen.join(bounds, ["vec_id", "key"]), "asked")
    negative = met(asked, _best_negatives, "anchor_id long, anchor_key long, positive_score long, negative_id long, negative_key long, negative_score long")
    negative = _first(negative, ["anchor_id", "anchor_key", "positive_score"], "negative_score", "negative", NEGATIVES)
    found = positive.join(negative, ["anchor_id", "anchor_key", "positive_score"])
    out = stored(found.select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"), "hard-negatives")
    space.close()
    return out


def op11_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every vector whose id is divisible by 50, among all others."""
    return mine(table(spark, sf_dir, "embeddings"))


OP11_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, s.vec_id)::INT AS rank,
  s.vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
