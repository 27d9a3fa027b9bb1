"""Operator 4, quality rules: line frequency across the documents of a host, beside rules on single texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwire.llm.columns import SPACE, aside, fingerprint, let, table, words
from loomwire.session import stored

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: A line is boilerplate of its host when more documents hold it than this, times the logarithm to base 10 of the host's documents.
LINE_DOCS = 20
#: A document is depleted when fewer words than MIN_WORDS, or less than this share of them, are left.
LEFT_SHARE = 0.1


def repeated_words(w: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of ``window`` words found twice or more in the array ``w``."""
    windows = F.when(
        F.size(w) >= window,
        F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)])),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(placed, lambda s: let(_twice(s), _cover))

    def _twice(s: Column) -> Column:
        at = lambda i: F.get(s, i)["h"]
        last = F.size(s) - 1
        found = F.filter(
            F.sequence(F.lit(0), last),
            lambda i: ((i > 0) & (at(i) == F.when(i > 0, at(i - 1)))) | ((i < last) & (at(i) == F.when(i < last, at(i + 1)))),
        )
        return F.sort_array(F.transform(found, lambda i: F.get(s, i)["i"]))

    def _cover(p: Column) -> Column:
        last = F.size(p) - 1
        gaps = F.transform(F.sequence(F.lit(0), last), lambda j: F.when(j < last, F.least(F.lit(window), F.get(p, j + 1) - F.get(p, j))).otherwise(window))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))

    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))


def normal_line(line: Column) -> Column:
    """Lower case, every run of other than letters, marks and digits one space, digits alike."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"[^\p{L}\p{M}\p{Nd}]+", " "), r"\p{Nd}", "0"))


def profile(docs: DataFrame, host: str) -> DataFrame:
    """One narrow row per document: its key, base figures, and ``lines`` (hash with the host, words in it).

    A null text counts as empty; a null host is a host. ``lines`` holds the normalised lines in order, with the words
    of each; lines without a letter or digit are left out.
    """
    text = F.coalesce("text", F.lit(""))
    is_word = lambda s: s.rlike(r"[^\x20\x09-\x0D]")
    lines = F.filter(F.split(text, "\n"), is_word)
    hashed = F.transform(
        lines, lambda s: F.struct(normal_line(s).alias("t"), F.regexp_count(s, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("w"))
    )
    kept = F.transform(F.filter(hashed, lambda x: x["t"] != ""), lambda x: F.struct(F.xxhash64(F.col(host), x["t"]).alias("h"), x["w"].alias("w")))
    w = words(F.col("text"))
    bare = F.translate(text, " \t\n\x0b\f\r", "")
    return docs.select(
        "doc_id",
        fingerprint(F.col("text")).alias("text_hash"),
        F.col(host).alias("host"),
        let(w, lambda x: F.struct(F.size(x).cast("long").alias("n_words"), repeated_words(x).alias("n_repeat_words"))).alias("_w"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        kept.alias("lines"),
    ).select("doc_id", "text_hash", "host", "_w.*", "word_chars", "n_symbols", "n_dup_lines", "lines")


def boilerplate(profiles: DataFrame, line_docs: int = LINE_DOCS) -> DataFrame:
    """Hashes of the lines (with host) that too many documents of a host hold: ``h``, ``n_docs``.

    Every row is a document and counts once for a line, copies too. The limit grows with the logarithm of the host's
    documents only, from ``line_docs`` for ten of them on. Counts are summed in each task before the shuffle.
    """
    lines = profiles.select("host", F.explode(F.array_distinct("lines.h")).alias("h"))
    counted = lines.groupBy("h", "host").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") > line_docs)
    hosts = profiles.groupBy(F.col("host").alias("of")).agg((line_docs * F.greatest(F.lit(1.0), F.log10(F.count("*").cast("double")))).alias("most"))
    return counted.join(hosts, F.col("host").eqNullSafe(F.col("of"))).filter(F.col("n_docs") > F.col("most")).select("h", "n_docs")


def judge(profiles: DataFrame, removed: DataFrame, min_words: int = MIN_WORDS, left_share: float = LEFT_SHARE) -> DataFrame:
    """The base rules and the method's verdict for each profile; ``removed`` lists the boilerplate lines."""
    lost = (
        profiles.select("doc_id", "text_hash", F.posexplode("lines").alias("i", "l"))
        .select("doc_id", "text_hash", "i", "l.h", "l.w")
        .join(removed.select("h"), "h")
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set(F.struct("i", "h", "w")).alias("gone"))  # rows that repeat give the same entries
        .select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t"), F.array_distinct(F.transform("gone", lambda x: x["h"])).alias("removed_lines"), F.aggregate("gone", F.lit(0).cast("long"), lambda a, x: a + x["w"]).alias("removed_words"))
    )
    both = profiles.drop("lines").join(lost, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("text_hash").eqNullSafe(F.col("_t")), "left").drop("_d", "_t")
    gone = F.coalesce("removed_words", F.lit(0).cast("long"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    left = F.col("n_words") - gone
    depleted = (gone > 0) & ((left < min_words) | (left < left_share * F.col("n_words")))
    return both.withColumns({"removed_words": gone, "base_failed": failed, "kept": ~failed & ~depleted})


def quality_rules(docs: DataFrame, host: str = "source", **limits) -> DataFrame:
    """One row per document: base figures, ``removed_lines`` (hashes, null if none), ``removed_words``,
    ``base_failed`` and ``kept``.

    Null and empty texts have no words and fail the base rules. Rows that repeat a doc_id with another text are
    documents of their own; exact repetitions of a row get the same verdict each. An empty table gives none.
    The profile is written once to the shared folder; after that only narrow rows are shuffled: the counts are
    aggregated before the shuffle, so a line or host that fills a third of the corpus stays cheap.
    """
    profiles = stored(profile(docs, host), "quality")
    count = {k: limits.pop(k) for k in ("line_docs",) if k in limits}
    return judge(profiles, boilerplate(profiles, **count), **limits)


def clean_lines(text: Column, host: Column, gone: Column) -> Column:
    """The text without the lines whose hash is in ``gone``."""
    keep = F.filter(F.split(text, "\n"), lambda s: ~F.array_contains(gone, F.xxhash64(host, normal_line(s))))
    return F.when(gone.isNull(), text).otherwise(F.array_join(keep, "\n"))


def filter_documents(docs: DataFrame, host: str = "source", **limits) -> DataFrame:
    """The documents that pass, without their boilerplate lines; the columns stay, ``n_chars`` follows the text."""
    docs, back = aside(docs, ["_d", "_t", "removed_lines"])
    verdict = quality_rules(docs, host, **limits).filter("kept").select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t"), "removed_lines").distinct()
    on = docs["doc_id"].eqNullSafe(F.col("_d")) & fingerprint(docs["text"]).eqNullSafe(F.col("_t"))
    out = docs.join(verdict, on).withColumn("text", clean_lines(F.col("text"), F.col(host), F.col("removed_lines")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("removed_lines").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return back(out.select(*docs.columns))


def op4_quality(spark, sf_dir: str) -> DataFrame:
    """The contract's figures for every document, with the verdict of the line frequencies."""
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words", "base_failed", "kept"
    )


OP4_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
win AS (
  SELECT rid, i, array_to_string(w[i:i+4], ' ') AS g FROM w, unnest(range(1, len(w) - 3)) AS t(i)),
dup AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
cover AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM dup) GROUP BY rid),
lines AS (
  SELECT rid, source, l FROM (SELECT rid, source, unnest(string_split(text, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dl AS (SELECT rid, count(*) - count(DISTINCT l) AS n FROM lines GROUP BY rid),
norm AS (
  SELECT rid, source,
    trim(regexp_replace(regexp_replace(lower(l), '[^\p{L}\p{M}\p{Nd}]+', ' ', 'g'), '\p{Nd}', '0', 'g'), ' ') AS t,
    len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS nw
  FROM lines),
hosts AS (SELECT source, count(*) AS k FROM d GROUP BY source),
boiler AS (
  SELECT n.source, n.t FROM norm n JOIN hosts h ON n.source IS NOT DISTINCT FROM h.source WHERE n.t <> ''
  GROUP BY n.source, n.t HAVING count(DISTINCT rid) > 20 * greatest(1, log10(any_value(h.k)))),
lost AS (
  SELECT rid, sum(nw) AS n FROM norm n JOIN boiler b ON n.source IS NOT DISTINCT FROM b.source AND n.t = b.t GROUP BY rid),
f AS (
  SELECT d.doc_id, len(w.w)::BIGINT AS n_words, coalesce(length(translate(d.text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')), 0)::BIGINT AS word_chars,
    (length(d.text) - length(translate(d.text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    coalesce(dl.n, 0)::BIGINT AS n_dup_lines, coalesce(cover.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS removed_words
  FROM d JOIN w USING (rid) LEFT JOIN cover USING (rid) LEFT JOIN dl USING (rid) LEFT JOIN lost USING (rid))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
  AND NOT (removed_words > 0 AND (n_words - removed_words < 10 OR n_words - removed_words < 0.1 * n_words)) AS kept
FROM f
"""
