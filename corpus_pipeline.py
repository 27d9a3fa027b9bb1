"""A training-data pipeline over ``documents``: five stages, each an operator applied to all its predecessor kept.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of ``documents``.
:func:`run` writes each stage's rows as Parquet into the shared folder and reads them back as the next one's input, so
a lost executor costs part of one stage; what came before that is dropped then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomwire.llm import lines, minhash, mixing, packing, quality
from loomwire.session import Workspace, prepare


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that the rules reject go, and so do boilerplate lines of those that stay."""
    return quality.filter_documents(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: lines that repeat an earlier one go; near copies by operator 6 are left to the next stage."""
    return lines.without_repeated_lines(docs)


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: one document of each near-duplicate group stays."""
    return minhash.drop_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents are dropped or repeated until sources have their target weights."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: token pieces with their sequence and offset."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("minhash near-dedup", duplicate_stage),
    ("mixing to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: Components, seeded draws and token ids are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, space, last = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet"), Workspace(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        docs = space.store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if last:
            space.drop(last)
        last = name.replace(" ", "-")
    return STAGES[-1][1](spark, docs, sf_dir)
