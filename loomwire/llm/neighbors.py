"""Operator 5, approximate nearest neighbours: multiprobe p-stable hashing for largest inner products.

Vectors are lengthened by one component so that all have the largest norm; nearest by distance is then largest by inner
product. A table hashes a vector to ``K`` numbers floor((a.x + b) / w). A query visits the buckets of each table in the
order of estimated success: perturbation sets of its numbers by the sum of squared distances to the crossed borders
(Lv et al. 2007). How many buckets are visited is fitted on a bounded sample of queries, so that the wanted
share of their true neighbours is met. Candidates of all tables are merged and ranked by exact inner products.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwire.llm.columns import table
from loomwire.llm.hashing import mix
from loomwire.session import Workspace, cut, stored

NEAREST, TABLES, WIDTH = 20, 2, 1.2
#: Queries and vectors on which the number of probes is fitted, and the recall wanted on them.
SAMPLE_QUERIES, WANTED_RECALL = 64, 0.97
#: Buckets of a table that a query visits at most; where they do not suffice, K falls until they do.
MOST_PROBES = 20_000
#: Vectors that a cell of buckets holds on average, queries that a task gets with it, and those that meet it at once.
BLOCK_ROWS, QUERY_BLOCK, QUERY_ROWS = 4096, 8192, 512
SEED = 11


def functions(dims: int, k: int, table_no: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Directions (standard normal, so 2-stable) and offsets of one table, for vectors of ``dims`` components plus one."""
    rng = np.random.Generator(np.random.PCG64([SEED, dims, table_no]))
    a = rng.standard_normal((64, dims + 1))[:k]
    return a, rng.random(64)[:k] * width


def lengthened(x: np.ndarray, norm: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(0.0, norm * norm - (x * x).sum(axis=1, keepdims=True)))])


def slots(x: np.ndarray, norm: float, k: int, table_no: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers and, for each, how far into its slot (0..1) every vector lies. Widths are parts of ``norm``."""
    a, b = functions(x.shape[1], k, table_no, width)
    at = (lengthened(x, norm) / norm @ a.T + b) / width
    low = np.floor(at)
    return low.astype(np.int64), at - low


def bucket_codes(low: np.ndarray) -> np.ndarray:
    """One number for each row of bucket numbers; 6 bits a function are ample within the sphere and more just fold."""
    code = np.zeros(low.shape[0], np.int64)
    for j in range(low.shape[1]):
        code = code * 64 + (low[:, j] & 63)
    return code


def probe_order(inside: np.ndarray, limit: int, reach: int = 4) -> np.ndarray:
    """The first ``limit`` steps away from a vector's own bucket, by estimated success: one row of K numbers each.

    Step s of a function crosses s borders (up positive); its cost is the squared way to the last one, and a set of steps
    costs their sum. The sets are built function by function; one whose beginning is not among the ``limit`` cheapest
    beginnings cannot be among the cheapest sets.
    """
    step = np.arange(-reach, reach + 1)
    cost, sets = np.zeros(1), np.zeros((1, 0), np.int64)
    for f in inside:
        way = np.where(step > 0, step - f, np.where(step < 0, f - step - 1, 0.0)) ** 2
        cost = (cost[:, None] + way).ravel()
        best = np.argpartition(cost, limit - 1)[:limit] if len(cost) > limit else np.arange(len(cost))
        cost = cost[best]
        sets = np.hstack([sets[best // len(step)], step[best % len(step), None]])
    return sets[np.argsort(cost, kind="stable")]


def exact_scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of one vector with many, components added in order, so equal vectors get equal scores."""
    s = np.zeros(len(v))
    for d in range(v.shape[1]):
        s += q[d] * v[:, d]
    return s


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector takes part: not null, no null or non-finite component, not zero."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return vectors.select("vec_id", F.transform(v, lambda x: x.cast("double")).alias("v")).filter(v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(some, F.lit(False)) & F.col("vec_id").isNotNull())


def classes(rows: DataFrame, keep: int) -> DataFrame:
    """Equal vectors as one: ``cid``, ``v``, and the ``keep`` smallest ids, found in two steps so that no task has to
    see all copies of a vector. The rest of the ids is not lost: a query never needs more than ``keep`` of one vector."""
    keyed = rows.select("vec_id", "v", F.xxhash64("v").alias("cid"))
    salted = keyed.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    few = salted.select("cid", "salt", "vec_id").distinct().withColumn("r", F.row_number().over(Window.partitionBy("cid", "salt").orderBy("vec_id"))).filter(F.col("r") <= keep)
    ids = few.groupBy("cid").agg(F.slice(F.sort_array(F.collect_list("vec_id")), 1, keep).alias("ids"))  # at most 64 * keep ids
    one = keyed.select("cid", "vec_id", "v").join(ids, "cid").filter(F.col("vec_id") == F.col("ids")[0]).dropDuplicates(["cid"])
    return one.select("cid", "v", "ids")


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` largest entries of each row, in no order."""
    return np.argpartition(-scores, min(k, scores.shape[1]) - 1, axis=1)[:, :k] if scores.shape[1] > k else np.tile(np.arange(scores.shape[1]), (len(scores), 1))


def _brute(queries: np.ndarray, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: list[list] = [[] for _ in queries]
        for batch in batches:
            x = np.array(batch["v"].tolist())
            if not len(x):
                continue
            s = queries @ x.T
            for i, cols in enumerate(_top(s, k)):
                best[i] = heapq.nlargest(k, best[i] + [(s[i, c], batch["cid"].iat[c], x[c]) for c in cols], key=lambda t: t[0])
        rows = [(i, float(s), int(c), v.tolist()) for i, b in enumerate(best) for s, c, v in b]
        yield pd.DataFrame(rows, columns=["q", "score", "cid", "v"])

    return run


def fit(data: DataFrame, dims: int, norm: float, n: int, nearest: int, wanted: float) -> tuple[int, int]:
    """``(K, probes per table)`` such that a sample's true neighbours are found.

    K grows with the logarithm of the table, but falls again while MOST_PROBES buckets a table do not meet the wanted recall
    on the sample; buckets then hold more, and none of the recall is given up. The sample - SAMPLE_QUERIES vectors of least hash, whatever the size of the
    table - is compared with all rows in one pass; only its neighbours come to the driver.
    """
    k = max(2, round(np.log2(max(2, n) / 64) / 2))
    picked = data.orderBy(F.xxhash64("cid", F.lit(SEED))).limit(SAMPLE_QUERIES).select("cid", "v").collect()
    queries = np.array([r["v"] for r in picked])
    near = data.select("cid", "v").mapInPandas(_brute(queries, nearest + 1), "q int, score double, cid long, v array<double>")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "cid")
    near = near.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= nearest + 1).collect()
    own = {i: r["cid"] for i, r in enumerate(picked)}
    near = [r for r in near if r["cid"] != own[r["q"]]]
    if not near:
        return k, 1
    of, vectors = np.array([r["q"] for r in near]), np.array([r["v"] for r in near])
    while True:
        limit = min(9**k, MOST_PROBES)
        reach = np.full(len(near), 1 << 40)
        for t in range(TABLES):
            home, inside = slots(queries, norm, k, t, WIDTH)
            found, _ = slots(vectors, norm, k, t, WIDTH)
            for q in range(len(queries)):
                order = probe_order(inside[q], limit)
                for i in np.flatnonzero(of == q):
                    at = np.flatnonzero((order == found[i] - home[q]).all(axis=1))
                    reach[i] = min(reach[i], at[0] + 1 if len(at) else 1 << 40)
        need = np.sort(reach)[min(len(reach) - 1, int(np.ceil(wanted * len(reach))) - 1)]
        if need <= limit or k == 1:
            return k, int(min(need, limit))
        k -= 1


def search(vectors: DataFrame, is_query, nearest: int = NEAREST, wanted: float = WANTED_RECALL) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``vectors`` (vec_id, embedding) that satisfies the condition
    ``is_query``, the ``nearest`` found among all other rows by inner product, ties to the smaller id.

    Vectors that are null, zero, or hold null or non-finite components take no part; a null vec_id neither. A query meets
    candidates of its own length only. Rows that repeat an id with one vector count once. Equal vectors are searched as
    one and told apart at the end, so a vector that a third of all rows share costs what one costs.
    """
    spark = vectors.sparkSession
    space = Workspace(spark, "neighbors")
    rows = usable(vectors)
    keep = nearest + 1
    data = space.store(classes(rows, keep), "vectors")
    lengths = data.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("square")).collect()
    asked = cut(rows.filter(is_query).select(F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("cid")).distinct())
    wanted_cids = asked.select("cid").distinct()
    out = None
    for row in lengths:  # one entry for each length of vectors
        part = _search_one(data.filter(F.size("v") == row["dims"]), wanted_cids, row["dims"], float(np.sqrt(row["square"])) * (1 + 1e-9), row["n"], keep, wanted, space)
        out = part if out is None else out.unionByName(part)
    if out is None:
        space.close()
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = out.join(data.select(F.col("cid").alias("near"), "ids"), "near").join(asked, "cid")
    each = found.select("query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # at most keep * keep rows
    found = each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= nearest)
    found = stored(found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "nearest")
    space.close()
    return found


def _search_one(data: DataFrame, wanted_cids: DataFrame, dims: int, norm: float, n: int, keep: int, wanted: float, space: Workspace) -> DataFrame:
    """``cid, near, score``: the ``keep`` nearest classes of every wanted one, itself included, ties to the least id.

    Buckets are dealt to cells of about a block by their number; a cell above that, and the queries that visit it, are dealt
    in parts. A query first meets the first eighth of its buckets, where each cell gives a few scores: the ``keep``-th of
    these bounds what is wanted. Then it meets all its buckets, and only what reaches the bound is given out, so the
    rows of a query do not grow with the cells that it visits.
    """
    k, probes = fit(data, dims, norm, n, keep - 1, wanted)
    cells = max(1, -(-n // BLOCK_ROWS))
    few = min(keep, 3 + -(-2 * keep // (TABLES * min(cells, probes))))
    first = max(1, probes // 8)
    slack = 1e-9 * norm * norm  # products by matrix and by exact_scores differ in rounding
    cell_of = lambda code: (mix(code.view(np.uint64)) % np.uint64(cells)).astype(np.int64)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.array(batch["v"].tolist())
            for t in range(TABLES):
                code = bucket_codes(slots(x, norm, k, t, WIDTH)[0])
                yield pd.DataFrame({"tab": t, "cell": cell_of(code), "bucket": code, "cid": batch["cid"], "least": batch["least"], "v": batch["v"]})

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.array(batch["v"].tolist())
            for t in range(TABLES):
                home, inside = slots(x, norm, k, t, WIDTH)
                for low in range(0, len(x), 64):
                    rows = []
                    for i in range(low, min(low + 64, len(x))):
                        codes = bucket_codes(home[i] + probe_order(inside[i], probes))
                        at = cell_of(codes)
                        by_cell = np.argsort(at, kind="stable")  # inside a cell buckets stay in order
                        starts = np.flatnonzero(np.r_[True, np.diff(at[by_cell]) != 0])
                        for own in np.split(by_cell, starts[1:]):
                            rows.append((t, int(at[own[0]]), batch["cid"].iat[i], batch["v"].iat[i], codes[own], int((own < first).sum())))
                    yield pd.DataFrame(rows, columns=["tab", "cell", "cid", "v", "buckets", "near"])

    placed = space.store(data.select("cid", F.col("ids")[0].alias("least"), "v").mapInPandas(place, "tab int, cell long, bucket long, cid long, least long, v array<double>"), f"placed-{dims}")
    queries = data.join(wanted_cids, "cid", "left_semi").select("cid", "v")
    visits = space.store(queries.mapInPandas(visit, "tab int, cell long, cid long, v array<double>, buckets array<long>, near int"), f"visits-{dims}")
    share = lambda df, most, name: df.groupBy("tab", "cell").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / most)).cast("long").alias(name))
    plan = cut(share(placed, 2 * BLOCK_ROWS, "parts").join(share(visits, QUERY_BLOCK, "shares"), ["tab", "cell"]))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    here = placed.join(plan, ["tab", "cell"]).withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts"))).withColumn("share", each("shares")).drop("parts", "shares")
    there = visits.join(plan, ["tab", "cell"]).withColumn("share", F.pmod(F.xxhash64("cid"), F.col("shares"))).withColumn("part", each("parts")).drop("parts", "shares")
    together = ("tab", "cell", "part", "share")

    def scores(left: pd.DataFrame, right: pd.DataFrame, near_only: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For blocks of queries: their places in ``right``, vectors, and products with all of ``left``, -inf in buckets not visited."""
        x, bucket = np.array(left["v"].tolist()), left["bucket"].to_numpy()
        order = np.argsort(bucket, kind="stable")
        names, starts = np.unique(bucket[order], return_index=True)
        spans = {b: order[s:e] for b, s, e in zip(names.tolist(), starts.tolist(), [*starts[1:].tolist(), len(bucket)], strict=True)}
        for low in range(0, len(right), QUERY_ROWS):
            some = right.iloc[low : low + QUERY_ROWS]
            q = np.array(some["v"].tolist())
            s = np.full((len(q), len(x)), -np.inf)
            visitors: dict[int, list[int]] = {}
            for i, (buckets, near) in enumerate(zip(some["buckets"], some["near"], strict=True)):
                for b in (buckets[:near] if near_only else buckets).tolist():
                    if b in spans:
                        visitors.setdefault(b, []).append(i)
            for b, who in visitors.items():
                s[np.ix_(who, spans[b])] = q[who] @ x[spans[b]].T
            yield np.arange(low, low + len(q)), q, s

    def glance(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            near, cids = left["cid"].to_numpy(), right["cid"].to_numpy()
            for at, _, s in scores(left, right, True):
                cols = _top(s, few)
                got = np.take_along_axis(s, cols, axis=1)
                hit = np.isfinite(got)
                out.append(pd.DataFrame({"cid": np.repeat(cids[at], cols.shape[1])[hit.ravel()], "near": near[cols][hit], "score": got[hit]}))
        return pd.concat(out) if out else pd.DataFrame({"cid": [], "near": [], "score": []})

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            x, near, least, cids = np.array(left["v"].tolist()), left["cid"].to_numpy(), left["least"].to_numpy(), right["cid"].to_numpy()
            bounds = right["bound"].fillna(-np.inf).to_numpy()
            for at, q, s in scores(left, right, False):
                for i, row in zip(at, s, strict=True):
                    cols = np.flatnonzero((row >= bounds[i]) & (row > -np.inf))
                    if len(cols) > keep:
                        cols = cols[row[cols] >= np.partition(row[cols], -keep)[-keep] - 2 * slack]
                    exact = exact_scores(q[i - at[0]], x[cols])
                    best = np.lexsort((least[cols], -exact))[:keep]
                    out.append(pd.DataFrame({"cid": cids[i], "near": near[cols][best], "least": least[cols][best], "score": exact[best]}))
        return pd.concat(out) if out else pd.DataFrame({"cid": [], "near": [], "least": [], "score": []})

    glanced = here.groupBy(*together).cogroup(there.filter("near > 0").groupBy(*together)).applyInPandas(glance, "cid long, near long, score double")
    ranked = glanced.groupBy("cid", "near").agg(F.max("score").alias("score")).withColumn("r", F.row_number().over(Window.partitionBy("cid").orderBy(F.desc("score"))))
    bound = cut(ranked.filter(F.col("r") <= keep).filter(F.col("r") == keep).select("cid", (F.col("score") - 2 * slack).alias("bound")))
    met = here.groupBy(*together).cogroup(there.join(bound, "cid", "left").groupBy(*together)).applyInPandas(meet, "cid long, near long, least long, score double")
    merged = met.groupBy("cid", "near").agg(F.max("score").alias("score"), F.min("least").alias("least"))
    best = Window.partitionBy("cid").orderBy(F.desc("score"), "least")
    return merged.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= keep).select("cid", "near", "score")


def op5_neighbors(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20, among all others."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
