"""Operator 7, line dedup: a segment-partition edit join of lines.

Lines within an edit distance of ``TAU`` share a segment: a line of length L is split into TAU + 1 even segments, and a
longer line that is close holds one of them, shifted by what the edits before and after it allow. So every line
publishes its segments under (L, number, text) and probes with its own substrings for the lengths and shifts that are
possible; lines that meet are checked by a banded bit-parallel edit distance. Every ``CHARS_PER_EDIT`` characters of the
shorter line allow one edit: shorter lines have fewer segments, and the shortest are compared by equality alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwire.llm import minhash
from loomwire.llm.columns import WORD, aside, row_key, sized, table
from loomwire.operators.graph import connected_components
from loomwire.session import Workspace, cut, n_rows, stored

TAU = 2
#: Lines from this length take part if they hold a word.
MIN_CHARS = 1
#: Characters of the shorter of two lines for each edit that they may differ in, up to TAU.
CHARS_PER_EDIT = 8


def segment(length: Column, number: Column, tau: Column) -> tuple[Column, Column]:
    """Start (from 0) and length of a segment of the even partition of a line: the last ones are one longer."""
    parts = tau + 1
    longer = length % parts
    small = ((length - longer) / parts).cast("int")
    first_long = parts - longer
    return small * number + F.greatest(F.lit(0), number - first_long), small + (number >= first_long).cast("int")


def probes(tau: int) -> list[tuple[int, int, int]]:
    """``(how much shorter the other line is, segment, shift)`` for all places where a segment of it may be found, but
    for those that are the line's own segments."""
    out = []
    for gap in range(tau + 1):
        for number in range(tau + 1):
            low, high = max(-number, gap - (tau - number)), min(number, gap + (tau - number))
            out += [(gap, number, shift) for shift in range(low, high + 1) if gap or shift]
    return out


def line_id(line: Column) -> Column:
    """63 bits of the line's text; the lowest bit is free."""
    return F.xxhash64(line).bitwiseAND(F.lit(-2))


def entries(tau: int) -> Column:
    """The segments (``probe`` 0, of the line's own length) and probes (1) of a line that may differ from another in ``tau`` edits, as a
    constant: each a struct of ``tau``, ``gap``, ``number``, ``shift`` and ``probe``."""
    one = lambda gap, number, shift, probe: F.struct(*[F.lit(x).alias(c) for c, x in zip(("tau", "gap", "number", "shift", "probe"), (tau, gap, number, shift, probe), strict=True)])
    return F.array(*[one(0, number, 0, 0) for number in range(tau + 1)], *[one(gap, number, shift, 1) for gap, number, shift in probes(tau)])


def signatures(lines: DataFrame, tau: int = TAU) -> DataFrame:
    """``(key, id)`` of all segments (lowest bit of ``id`` 0) and all probes (1) of ``lines(id, line, n_chars)``.

    A pair whose shorter line has ``CHARS_PER_EDIT`` t characters and fewer than those of t + 1 meets in the join for t
    edits; the longer one may be up to t characters longer, and then it only probes there. What a line is looked up by comes from short
    constants, one row each, so the expression for a key is small enough to be compiled to machine code.
    """
    n, none = F.col("n_chars").cast("int"), F.array().cast("array<struct<tau:int,gap:int,number:int,shift:int,probe:int>>")
    least = lambda t: F.lit(CHARS_PER_EDIT * t)
    # a line of up to t characters above the most of t edits belongs to t (as the longer one) and to t + 1
    sets = F.when(n < least(1), none)
    for t in range(1, tau + 1):
        if t > 1:
            sets = sets.when(n < least(t) + t - 1, F.concat(entries(t - 1), entries(t)))
        sets = sets.when(n < least(t + 1), entries(t)) if t < tau else sets.otherwise(entries(t))
    asked = lines.select("id", "line", n.alias("n"), F.explode(sets).alias("e")).select("id", "line", "n", "e.*")
    n = F.col("n") - F.col("gap")
    start, size = segment(n, F.col("number"), F.col("tau"))
    start = start + F.col("shift")
    shorter = (F.col("tau") == tau) | (n < (F.col("tau") + 1) * CHARS_PER_EDIT)
    made = asked.filter(shorter & (start >= 0) & (start + size <= F.col("n")))
    return made.select(F.xxhash64(F.substring("line", start + 1, size), n, "number", "tau").alias("key"), (F.col("id") + F.col("probe")).alias("id"))


def within(a: list[str], b: list[str], tau: int = TAU) -> np.ndarray:
    """For pairs of texts: is their edit distance at most ``tau``? All pairs advance together, a column a step.

    A word holds a band of 2 tau + 1 cells of the current column; the distance is followed along the diagonal that
    ends in the last cell (Hyyro 2003). Cells above the first row count as matches on falling values.
    """
    pairs = []
    for x, y in zip(a, b, strict=True):
        u, v = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32), np.frombuffer(y.encode("utf-32-le", "surrogatepass"), np.uint32)
        least = min(len(u), len(v))
        if abs(len(u) - len(v)) > tau:
            pairs.append(None)
            continue
        same = np.flatnonzero(u[:least] != v[:least])
        head = int(same[0]) if len(same) else least
        u, v = u[head:], v[head:]
        least = min(len(u), len(v))
        back = np.flatnonzero(u[::-1][:least] != v[::-1][:least])
        tail = int(back[0]) if len(back) else least
        pairs.append((u[: len(u) - tail], v[: len(v) - tail]))
    out = np.zeros(len(pairs), bool)
    order = sorted((i for i, p in enumerate(pairs) if p is not None), key=lambda i: len(pairs[i][1]))
    for at in range(0, len(order), 1024):
        some = order[at : at + 1024]
        out[some] = _band([pairs[i][0] for i in some], [pairs[i][1] for i in some], tau)
    return out


def _band(us: list[np.ndarray], vs: list[np.ndarray], tau: int) -> np.ndarray:
    count, width = len(us), 2 * tau + 1
    m, n = np.array([len(u) for u in us]), np.array([len(v) for v in vs])
    columns = int(n.max(initial=0))
    rows = np.full((columns + width, count), 0xFFFFFFFF, np.uint32)  # row i of the text is at i + tau - 1
    cols = np.full((columns, count), 0xFFFFFFFE, np.uint32)
    for i, (u, v) in enumerate(zip(us, vs, strict=True)):
        rows[tau : tau + len(u), i] = u[: columns + width - tau]
        cols[: len(v), i] = v
    one = np.uint64(1)
    full = np.uint64((1 << width) - 1)
    vp = np.full(count, np.uint64(((1 << width) - 1) & ~((1 << tau) - 1)))
    vn = np.full(count, np.uint64((1 << tau) - 1))
    gap = m - n
    end = (gap + tau).astype(np.uint64)
    score = np.abs(gap)
    for j in range(1, columns + 1):
        live = n >= j
        match = np.zeros(count, np.uint64)
        for k in range(width):
            hit = rows[j - 1 + k] == cols[j - 1]
            if j - tau + k <= 0:
                hit = np.ones(count, bool)
            match |= hit.astype(np.uint64) << np.uint64(k)
        d0 = ((((match & vp) + vp) ^ vp) | match | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        vp = (hn | ~((d0 >> one) | hp)) & full
        vn = hp & (d0 >> one)
        step = (d0 >> end) & one
        score = score + (live & (j + gap > 0) & (step == 0))
        if j % 32 == 0 and not (live & (score <= tau)).any():
            break
    return score <= tau


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        a, b = batch["text_a"].tolist(), batch["text_b"].tolist()
        may = np.array([min(TAU, min(len(x), len(y)) // CHARS_PER_EDIT) for x, y in zip(a, b, strict=True)], int)
        good = np.zeros(len(batch), bool)
        for tau in range(1, TAU + 1):
            some = np.flatnonzero(may == tau)
            good[some] = within([a[i] for i in some], [b[i] for i in some], tau)
        yield batch.loc[good, ["src", "dst"]]


def letters(line: Column) -> Column:
    """How often each letter from a to z occurs. An edit changes these counts by two in all at most."""
    return F.transform(F.array(*[F.lit(chr(c)) for c in range(97, 123)]), lambda x: F.length(line) - F.length(F.replace(line, x, F.lit(""))))


def occurrences(docs: DataFrame) -> DataFrame:
    """Every line of every document: doc_id, row_key, line_no (from 0), id, n_chars, n_words. Null texts have no lines."""
    lines = docs.select("doc_id", row_key().alias("row_key"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    words = F.regexp_count("line", F.lit(WORD)).cast("int")
    return lines.select("doc_id", "row_key", "line_no", line_id(F.col("line")).alias("id"), F.length("line").alias("n_chars"), words.alias("n_words"))


def long_lines(docs: DataFrame) -> DataFrame:
    lines = docs.select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.select(line_id(F.col("line")).alias("id"), "line", F.length("line").alias("n_chars")).filter((F.col("n_chars") >= CHARS_PER_EDIT) & F.col("line").rlike(WORD))


def line_links(docs: DataFrame) -> DataFrame:
    """``(src, dst)``, src < dst: ids of different lines within one edit for every CHARS_PER_EDIT characters of the
    shorter one, TAU at most.

    Keys are dealt out once; those under which two different lines meet, one at least with a segment, are found by an
    aggregate, and only their rows are joined. Copies of a line collapse before the join. Texts are fetched
    for lines that meet only; of those, pairs whose letters differ in more than 2 TAU places cannot be close and are not
    made.
    """
    spark, space = docs.sparkSession, Workspace(docs.sparkSession, "line-links")
    sigs = signatures(long_lines(docs)).repartition("key")
    text_of = lambda c: F.shiftright(c, 1)
    both = sigs.groupBy("key").agg(F.min(text_of("id")).alias("lo"), F.max(text_of("id")).alias("hi"), F.min(F.col("id").bitwiseAND(F.lit(1))).alias("kind"))
    shared = both.filter("lo < hi AND kind = 0").select("key")
    met = space.store(sigs.join(shared.hint("shuffle_hash"), "key").distinct(), "met")
    plain = F.col("id").bitwiseAND(F.lit(-2))
    ids = cut(met.select(plain.alias("id")).distinct())
    n = n_rows(ids)
    if not n:
        space.close()
        return spark.createDataFrame([], "src long, dst long")
    texts = space.store(long_lines(docs).select("id", "line").join(sized(ids, n), "id").dropDuplicates(["id"]).withColumn("letters", letters(F.col("line"))), "lines")
    marked = met.select("key", plain.alias("id"), (F.col("id") % 2 != 0).alias("probe")).join(texts.select("id", "letters"), "id")
    held = marked.filter("NOT probe").select("key", F.col("id").alias("one"), F.col("letters").alias("x"))
    asked = marked.select("key", F.col("id").alias("other"), F.col("letters").alias("y"))
    apart = F.aggregate(F.zip_with("x", "y", lambda x, y: F.abs(x - y)), F.lit(0), lambda t, d: t + d)
    met_once = held.join(asked, (held["key"] == asked["key"]) & (F.col("one") != F.col("other")) & (apart <= 2 * TAU))
    pairs = cut(met_once.select(F.least("one", "other").alias("src"), F.greatest("one", "other").alias("dst")).distinct())
    a = texts.select(F.col("id").alias("src"), F.col("line").alias("text_a"))
    b = texts.select(F.col("id").alias("dst"), F.col("line").alias("text_b"))
    links = cut(pairs.join(a, "src").join(b, "dst").select("src", "dst", "text_a", "text_b").mapInPandas(_verify, "src long, dst long"))
    space.close()
    return links


def taking_part() -> Column:
    return (F.col("n_words") > 0) & (F.col("n_chars") >= MIN_CHARS)


def dedup_lines(docs: DataFrame, space: Workspace | None = None) -> DataFrame:
    """One row per line of ``docs``: doc_id, row_key, line_no, n_chars, n_words, line_id, class_id, n_links, kept.

    ``class_id`` is the least line_id among lines joined by links; ``n_links`` counts the different lines within the
    allowed edits (copies of one text are one line). Of a class the first line by doc_id (null first) and line_no is kept.
    Lines without a word are a class by equality and all kept. Rows that repeat a document keep the same lines. Null
    and empty tables give no rows; an empty text has one empty line.
    """
    seen = (space.store if space else stored)(occurrences(docs), "occurrences")
    links = line_links(docs)
    degrees = links.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))
    named = cut(connected_components(links).select(F.col("node").alias("id"), F.col("component").alias("class_id")).join(degrees, "id", "left"))
    placed = seen.join(sized(named, n_rows(named)), "id", "left").withColumns(
        {"class_id": F.coalesce("class_id", "id"), "n_links": F.coalesce("n_links", F.lit(0)).cast("long")}
    )
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "line_no")
    first = placed.filter(taking_part()).groupBy("class_id").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").select("class_id", "first")
    out = placed.join(first, "class_id", "left")
    kept = F.col("first").isNull() | ~taking_part() | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("line_no") == F.col("first.line_no")))
    return out.select("doc_id", "row_key", "line_no", "n_chars", "n_words", F.col("id").alias("line_id"), "class_id", "n_links", kept.alias("kept"))


def owners(held: DataFrame, rank: Column) -> DataFrame:
    """``(class_id, owner)`` of the classes that stand in more than one place: the first place of the least ``rank``."""
    place = F.struct(rank.alias("rank"), F.col("doc_id").isNotNull().alias("known"), "doc_id", "line_no", "group")
    out = cut(held.groupBy("class_id").agg(F.min(place).alias("owner"), F.count("*").alias("n")).filter("n > 1").select("class_id", "owner"))
    return sized(out, n_rows(out))


def without_lines(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` with row_key, less the lines numbered in ``gone(row_key, gone)``. Of a document without a word left the
    first line with a word stays."""
    out = docs.withColumn("row_key", row_key()).join(gone, "row_key", "left")
    every = F.split("text", "\n")
    left = F.array_join(F.filter(every, lambda _, i: ~F.array_contains("gone", i)), "\n")
    first = F.get(F.filter(every, lambda x: x.rlike(WORD)), F.lit(0))
    text = F.when(F.col("gone").isNull(), F.col("text")).when(left.rlike(WORD), left).otherwise(F.coalesce(first, F.col("text")))
    out = out.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("gone").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select("row_key", *[c for c in docs.columns if c != "row_key"])


def repeated_lines(docs: DataFrame) -> DataFrame:
    """``(row_key, gone)``: the numbers of the lines that :func:`without_repeated_lines` takes from a document."""
    space = Workspace(docs.sparkSession, "repeated-lines")
    groups = minhash.grouped(docs).filter("component IS NOT NULL").select("row_key", F.col("component").alias("group"), (~minhash.stays()).alias("goes")).distinct()
    groups = space.store(groups, "groups")
    several = groups.groupBy("group").agg(F.count("*").alias("n")).filter("n > 1").select("group")
    copies = cut(groups.join(several, "group"))
    marks = sized(copies, n_rows(copies))
    held = dedup_lines(docs, space).filter(taking_part()).select("row_key", "doc_id", "line_no", "class_id").distinct().join(marks, "row_key", "left")
    held = space.store(held.withColumns({"group": F.coalesce("group", "row_key"), "goes": F.coalesce("goes", F.lit(False))}), "held")
    space.drop("occurrences", "groups")

    # near copies are cut alike: what an earlier group holds goes, and what the document itself held before
    met = held.join(owners(held, F.col("goes")), "class_id").withColumn("own", F.col("group") == F.col("owner.group"))
    places = met.groupBy("row_key", "class_id", "own").agg(F.sort_array(F.collect_set("line_no")).alias("at"))
    lost = F.when(F.col("own"), F.slice("at", F.lit(2), F.size("at") - 1)).otherwise(F.col("at"))
    gone = places.select("row_key", lost.alias("at")).filter(F.size("at") > 0).groupBy("row_key").agg(F.flatten(F.collect_list("at")).alias("gone"))
    gone = stored(gone, "gone")

    # a copy that its cut group no longer covers is a document of its own
    touched = cut(copies.join(gone.select("row_key"), "row_key", "left_semi").select("group").distinct())
    members = cut(copies.join(sized(touched, n_rows(touched)), "group"))
    n = n_rows(members)
    if not n:
        space.close()
        return gone
    keyed = docs.withColumn("row_key", row_key()).join(sized(members.select("row_key"), n), "row_key", "left_semi").select("row_key", "doc_id", "text")
    now = space.store(without_lines(keyed.drop("row_key"), gone).withColumnRenamed("row_key", "was"), "cut-copies")
    # most are near the group's head as they were; only the groups of the others are looked at as a whole
    texts = now.select(F.col("was").alias("node"), "text").dropDuplicates(["node"])
    pairs = members.filter("goes").select("group", F.col("row_key").alias("dst")).join(members.filter("NOT goes").groupBy("group").agg(F.min("row_key").alias("src")), "group").select("src", "dst")
    close = minhash.confirm(pairs, texts)
    open_ = cut(members.filter("goes").join(close.select(F.col("dst").alias("row_key")), "row_key", "left_anti").select("group").distinct())
    if not (n := n_rows(open_)):
        space.close()
        return gone
    members = cut(members.join(sized(open_, n), "group"))
    now = now.join(sized(members.select(F.col("row_key").alias("was")), n_rows(members)), "was", "left_semi")
    again = minhash.grouped(now.select("doc_id", "text")).select("row_key", F.coalesce("component", "row_key").alias("component")).distinct()
    there = cut(now.select("was", row_key().alias("row_key")).join(again, "row_key").select(F.col("was").alias("row_key"), "component").distinct().join(members, "row_key"))
    heads = cut(there.filter("NOT goes").select("group", "component").distinct())
    apart = cut(there.filter("goes").join(sized(heads, n_rows(heads)), ["group", "component"], "left_anti").select("row_key").distinct())
    n = n_rows(apart)
    if not n:
        space.close()
        return gone
    alone = held.join(sized(apart.withColumn("alone", F.lit(1)), n), "row_key", "left")
    rank = F.when(~F.col("goes"), 0).when(F.col("alone") == 1, 1).otherwise(2)
    kept = F.col("doc_id").eqNullSafe(F.col("owner.doc_id")) & (F.col("line_no") == F.col("owner.line_no"))
    theirs = alone.filter("alone = 1").join(owners(alone, rank), "class_id").filter(~kept).groupBy("row_key").agg(F.collect_set("line_no").alias("gone"))
    gone = stored(gone.join(sized(apart, n), "row_key", "left_anti").unionByName(theirs), "gone")
    space.close()
    return gone


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without the lines that stand in an earlier document or earlier in their own; ``n_chars`` follows the text.

    Near copies by operator 6's own test are left to it: of such a group the documents are cut alike, by lines of other
    groups, so they stay copies of the one that is kept. Those that are no longer near that one after the cut lose
    every repeated line. First comes the first document that the next stage keeps. A document of which no word would be left
    keeps its first line with a word, so no row is lost here.
    """
    docs, back = aside(docs, ["row_key", "gone"])
    return back(without_lines(docs, repeated_lines(docs)).select(*docs.columns))


def op7_lines(spark, sf_dir: str) -> DataFrame:
    """All lines of all documents with their classes of near-equal lines."""
    return dedup_lines(table(spark, sf_dir, "documents")).drop("row_key")
