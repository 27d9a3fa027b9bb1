"""Session settings and the two ways in which the library cuts lineage.

Everything that outlives one job goes to the folder named by ``spark.checkpoint.dir``, which every
executor shares. Only where that setting is absent and the master is local (tests, a laptop) a private folder is chosen.
"""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)
CHECKPOINT_KEY = "spark.checkpoint.dir"
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(app: str = "loomwire", cores: int = 8, memory: str = "8g", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package where it lies, beside whatever the session has on its path."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as a URI; a fresh temporary one only if the session names none and runs locally."""
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='spark-loomwire-')}")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within, Spark deletes a query's shuffle files when the query ends, not when the driver next collects garbage.

    For queries whose result is kept (written, checkpointed or a number), so that nobody asks for those files again. Spark reads the
    setting when it plans a query: a frame that was made before needs a new plan, or its files stay."""
    before = spark.conf.get(CLEANUP_KEY, None)
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP_KEY)
        else:
            spark.conf.set(CLEANUP_KEY, before)


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and keep it as a reliable checkpoint: for narrow rows (keys, labels, counts)."""
    shared_dir(df.sparkSession)
    with tidy(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def n_rows(df: DataFrame) -> int:
    """Count the rows of a kept table; nothing of the count stays on disk."""
    with tidy(df.sparkSession):
        return df.count()


def new_folder(spark: SparkSession, label: str) -> str:
    """The URI of a folder nobody else uses, inside the shared one."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _written(df: DataFrame, path: str) -> DataFrame:
    with tidy(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Compute ``df`` once into a Parquet table of the shared folder and read it back: for wide rows,
    or where a later job reads a few columns only. For tables that only the caller's own steps read, see :class:`Workspace`."""
    return _written(df, new_folder(df.sparkSession, label))


def drop_folder(spark: SparkSession, uri: str) -> None:
    """Delete a folder made by :func:`new_folder` once nothing reads it any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Workspace:
    """A folder in the shared one for the tables between an operator's steps; they go one by one or all at the end."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, new_folder(spark, label)

    def store(self, df: DataFrame, name: str) -> DataFrame:
        return _written(df, f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            drop_folder(self.spark, f"{self.root}/{name}")

    def close(self) -> None:
        """Drop all tables, and let Spark's cleaner find the checkpoints and broadcasts that no step holds any more: it
        goes by the driver's garbage collector, which may not run for long while the driver is idle."""
        drop_folder(self.spark, self.root)
        gc.collect()
        self.spark._jvm.System.gc()
