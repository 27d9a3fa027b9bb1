"""Column helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that part words: space and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` mentions it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{SPACE}+|{SPACE}+$", "")
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, rf"{SPACE}+"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fingerprint(text: Column) -> Column:
    """64 bits that stand for a text beside its document's id; null stays null."""
    return F.when(text.isNotNull(), F.xxhash64(text))


def aside(df: DataFrame, used: Iterable[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with the columns that bear a name an operator uses inside renamed, and what gives them their names back."""
    used, taken = {u.lower() for u in used}, {c.lower() for c in df.columns}
    names: dict[str, str] = {}
    for c in df.columns:
        if c.lower() in used:
            other = f"{c}_given"
            while other.lower() in taken | used:
                other += "_"
            taken.add(other.lower())
            names[c] = other
    return df.withColumnsRenamed(names), lambda out: out.withColumnsRenamed({v: k for k, v in names.items()})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def count_at_most(xs: Column, value: Column) -> Column:
    """How many entries of the sorted array ``xs`` are at most ``value``, found by halving (31 steps do for any array)."""

    def halve(state: Column, _: Column) -> Column:
        middle = F.floor((state["lo"] + state["hi"]) / 2).cast("int")
        open_ = state["lo"] < state["hi"]
        fits = F.get(state["xs"], middle) <= state["v"]
        return F.struct(
            F.when(open_ & fits, middle + 1).otherwise(state["lo"]).alias("lo"),
            F.when(open_ & ~fits, middle).otherwise(state["hi"]).alias("hi"),
            state["xs"].alias("xs"),
            state["v"].alias("v"),
        )

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(xs) + 1)).cast("int"))
    start = F.struct(F.lit(0).alias("lo"), F.size(xs).alias("hi"), xs.alias("xs"), value.alias("v"))
    return F.aggregate(steps, start, halve)["lo"]


#: Ids (8 bytes each) up to which the smaller side of a join is broadcast; beyond, both sides are shuffled.
BROADCAST_IDS = 200_000


def sized(ids: DataFrame, n: int) -> DataFrame:
    """``ids`` marked for broadcast if its ``n`` rows, counted before, are few enough."""
    return F.broadcast(ids) if n <= BROADCAST_IDS else ids


def row_key() -> Column:
    """Stands for a document in joins: equal for rows that repeat both doc_id and text."""
    return F.xxhash64("doc_id", "text")
