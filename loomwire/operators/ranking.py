"""Exact ranks inside groups of any size, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwire.session import cut


#: Names that columns of ``df`` may not have.
RESERVED = ("_g0", "_g1", "_spread", "_cells", "_cell", "_c", "_before", "_place")


def rank_in_groups(df: DataFrame, group: list[str], spread: F.Column, rank: str = "rank", cell_rows: int = 4096, order: list[F.Column] | None = None) -> DataFrame:
    """Add ``rank`` (long, gapless from 0) inside each ``group``.

    Rows of a group are dealt to cells of about ``cell_rows`` rows by the hash column ``spread``; the rank is
    the cell's offset plus the place in the cell by ``order`` (default: ``spread``). The order of cells is by
    number, so the rank is an arbitrary but repeatable one. ``df`` should be cheap to read twice (checkpointed).
    Null group values form a group like any other. Columns named in RESERVED are used inside.
    """
    keys = [f"_g{i}" for i in range(len(group))]
    sizes = df.groupBy(*[F.col(g).alias(k) for g, k in zip(group, keys, strict=True)]).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / cell_rows)).cast("int").alias("_cells"))
    same = lambda a, b: [a[g].eqNullSafe(b[k]) for g, k in zip(group, keys, strict=True)]
    dealt = cut(df.withColumn("_spread", spread).join(sizes, same(df, sizes)).drop(*keys).withColumn("_cell", F.pmod(F.col("_spread"), F.col("_cells").cast("long"))).drop("_cells"))
    counts = dealt.groupBy(*group, "_cell").agg(F.count("*").alias("_n"))
    before = counts.select(
        *[F.col(g).alias(k) for g, k in zip(group, keys, strict=True)],
        F.col("_cell").alias("_c"),
        (F.sum("_n").over(Window.partitionBy(*group).orderBy("_cell")) - F.col("_n")).alias("_before"),
    )
    placed = dealt.withColumn("_place", F.row_number().over(Window.partitionBy(*group, "_cell").orderBy(*(order or [F.col("_spread")]))))
    on = same(placed, before) + [placed["_cell"] == before["_c"]]
    return placed.join(before, on).withColumn(rank, F.col("_before") + F.col("_place") - 1).drop("_spread", "_cell", "_c", "_before", "_place", *keys)
