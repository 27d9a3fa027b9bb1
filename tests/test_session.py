"""What the session's helpers leave behind."""

import time

from pyspark.sql import functions as F

from loomwire.session import cut, n_rows


def shuffle_files(spark) -> set[str]:
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {p for p in found.split("\n") if "/shuffle_" in p}


def test_checkpoints_and_counts_leave_no_shuffle_files(spark):
    rows = spark.range(0, 1000, 1, 4)
    made = rows.groupBy((F.col("id") % 10).alias("k")).agg(F.count("*").alias("n")).join(rows.withColumnRenamed("id", "k").hint("shuffle_hash"), "k")
    before = shuffle_files(spark)
    kept = cut(made)
    assert n_rows(kept) == 10 and {r["n"] for r in kept.collect()} == {100}
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:  # files go after the query, not with it
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
