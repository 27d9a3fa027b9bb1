"""Connected components over an edge table (G1)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwire.session import cut, tidy


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Replace a partition's edges by one star per component: at most one edge for each node."""
    up: dict = {}

    def top(x):
        root = x
        while up[root] != root:
            root = up[root]
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    for batch in batches:
        for a, b in zip(batch["src"].tolist(), batch["dst"].tolist(), strict=True):
            up.setdefault(a, a)
            up.setdefault(b, b)
            ra, rb = top(a), top(b)
            if ra != rb:
                up[max(ra, rb)] = min(ra, rb)
    pairs = [(n, top(n)) for n in up]
    pairs = [(n, r) for n, r in pairs if n != r]
    # as objects: texts in pandas' own string type may come in chunks, which Arrow conversion refuses
    yield pd.DataFrame({c: pd.Series([p[i] for p in pairs], dtype=object) for i, c in enumerate(("src", "dst"))})


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: every ``src`` has one edge, and no ``dst`` is a ``src``. As ``dst`` is less than ``src`` throughout, such a
    star's centre is its least node, and another round would change nothing."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("up")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("up")))).alias("e"))
    by_node = ends.groupBy("e.node").agg(F.sum("e.up").alias("ups"), F.min("e.up").alias("least"))
    with tidy(edges.sparkSession):
        return not by_node.filter("ups > 1 OR (ups = 1 AND least = 0)").limit(1).count()


def _hook(edges: DataFrame) -> DataFrame:
    """Large star, then small star: every node moves to the least neighbour it can see."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
    large = both.join(least, "src").filter("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).filter("src <> dst").distinct()
    down = cut(large.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")))  # read three times below
    low = down.groupBy("src").agg(F.min("dst").alias("m"))
    joined = down.join(low, "src")
    small = joined.select(F.col("dst").alias("src"), F.col("m").alias("dst")).unionByName(low.select("src", F.col("m").alias("dst")))
    return small.filter("src <> dst").distinct()


def connected_components(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """Label every node by the least node it is connected with: ``(node, component)``.

    ``edges`` has ``src`` and ``dst`` of one orderable type; rows with a null end and loops are ignored.
    ``vertices(node)`` adds nodes without edges, which label themselves; without it only nodes that have an
    edge are returned. Each partition first shrinks to a spanning forest, then alternating large-star and
    small-star rounds (Kiveris et al. 2014) run until the edges are stars, which they must become, for every move is to a smaller node; each round is checkpointed, so a
    lost executor costs one round. The hub of a star is joined through an aggregate, never gathered in one
    task, and AQE may split it. No edges give no rows (or the vertices alone).
    """
    kind = edges.schema["src"].dataType
    clean = edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
    forest = cut(clean.mapInPandas(_forest, f"src {kind.simpleString()}, dst {kind.simpleString()}"))
    while not _settled(forest):
        forest = cut(_hook(forest))
    labels = forest.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    labels = labels.unionByName(forest.select(F.col("dst").alias("node")).distinct().withColumn("component", F.col("node")))
    if vertices is None:
        return labels
    return vertices.select("node").filter("node IS NOT NULL").distinct().join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
