"""Operator 1, licence scans: digests of canonical texts, joined with the digests of known licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwire.llm.columns import fingerprint, let, table
from loomwire.llm.license_texts import KNOWN, KNOWN_DIGESTS, SAME_SPELLING

_MARK = r"(?:copyright|\(c\)|©)"
COPYRIGHT_LINE = rf"(?m)^[^\p{{L}}\p{{N}}\n(©]*{_MARK}[ \t]*{_MARK}?[ \t]*(?:[0-9]{{4}}|\[|<|by )[^\n]*$"
RIGHTS_LINE = r"(?m)^[ \t]*all rights reserved\.?[ \t]*$"
#: What stands before the first letter, number or bracket of a line, such as the mark of a comment.
LEADER = r"^[^\p{L}\p{N}(]+"
#: The number of a clause, wherever it stands between spaces.
CLAUSE = r"\s\(?[0-9]{1,2}[.)]\s"


def spellings() -> list[tuple[str, str, str]]:
    """``(first word, pattern, replacement)``, longest first. Between two words may be a line end and a mark."""
    return [(a.split()[0], rf"\b{spaced(a)}(s?)\b", f"{b}$1") for a, b in sorted(SAME_SPELLING, key=lambda p: -len(p[0]))]


def spaced(words: str) -> str:
    return words.replace(" ", r"[^\p{L}\p{N}]+")


def variants() -> str:
    """A pattern of all spellings, parted by their first letters so that most words are passed over at once."""
    heads: dict[str, list[str]] = {}
    for a, _ in SAME_SPELLING:
        heads.setdefault(a[0], []).append(spaced(a[1:]))
    return r"\b(?:" + "|".join(f"{h}(?:{'|'.join(rest)})" for h, rest in sorted(heads.items())) + r")s?\b"


def respelled(text: Column) -> Column:
    """Lower case, one spelling; line ends stay."""
    t = F.lower(text)
    rules = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(p).alias("p"), F.lit(r).alias("r")) for a, p, r in spellings()])
    same = F.aggregate(rules, t, lambda same, x: F.when(F.contains(same, x["a"]), F.regexp_replace(same, x["p"], x["r"])).otherwise(same))
    return F.when(t.rlike(variants()), same).otherwise(t)


def marked(t: Column) -> Column:
    found = [F.contains(t, F.lit(x)) for x in ("copyright", "(c)", "©", "all rights")]
    return found[0] | found[1] | found[2] | found[3]


def without_notices(t: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(t, COPYRIGHT_LINE, ""), RIGHTS_LINE, "")


def bare(line: Column) -> Column:
    """Letters and digits only, every other run one space; without what leads a line and without numbers of clauses. The
    last two patterns do the same to a lower-case line of ASCII, the first one faster."""
    wide = F.concat(F.lit("  "), F.regexp_replace(F.regexp_replace(line, LEADER, ""), r"\s+", "  "), F.lit("  "))
    line = F.when(line.rlike("[0-9][.)]"), F.regexp_replace(wide, CLAUSE, "  ")).otherwise(line)
    ascii_only = F.length(line) == F.octet_length(line)
    return F.trim(F.when(ascii_only, F.regexp_replace(line, "[^a-z0-9]+", " ")).otherwise(F.regexp_replace(line, r"[^a-z0-9\p{L}\p{N}]+", " ")))


def canonical_forms(text: Column) -> Column:
    """A struct of ``lines``, those of the text in canonical form without copyright lines and empty ones, and ``kept``, the same with
    copyright lines (null where there are none)."""
    lines = lambda t: F.filter(F.transform(F.split(t, "\n"), bare), lambda x: x != "")
    return let(respelled(text), lambda t: F.struct(lines(F.when(marked(t), without_notices(t)).otherwise(t)).alias("lines"), F.when(marked(t), lines(t)).alias("kept")))


def digest(canonical: Column) -> Column:
    return F.when(canonical != "", F.sha2(canonical, 256))


def known_digests(spark, known: list[tuple[str, str]] = KNOWN, digests: list[tuple[str, int, str]] = KNOWN_DIGESTS) -> list[tuple[str, int, str]]:
    """``(license_id, canonical length, digest)``, one for each digest: of the texts ``known`` and those given as ``digests``."""
    forms = spark.createDataFrame(known, "license_id string, text string").select("license_id", canonical_forms(F.col("text")).alias("f"))
    texts = forms.select("license_id", F.explode(F.array("f.lines", "f.kept")).alias("ls")).select("license_id", F.array_join("ls", " ").alias("c"))
    found = {d: (i, n, d) for i, n, d in sorted(digests, reverse=True)}
    for r in texts.filter("c <> ''").select("license_id", F.length("c").alias("n"), digest(F.col("c")).alias("d")).orderBy(F.desc("license_id")).collect():
        found[r["d"]] = tuple(r)
    return sorted(found.values())


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", known: list[tuple[str, str]] = KNOWN, digests: list[tuple[str, int, str]] = KNOWN_DIGESTS) -> DataFrame:
    """One row per row of ``docs``: its key, ``digest`` of the whole canonical text, ``license_id`` if that is a
    known licence, and ``notices``, the sorted licences whose whole text is one of its lines.

    The canonical text is its canonical lines joined, so it does not know where lines end, what marks them as comments, or how clauses
    are numbered. A text with copyright lines is looked up without them, and else with them, for where
    its lines were joined a notice has no end. A line is hashed only if a known text is as long. Null and empty texts, and texts of
    punctuation or copyright lines alone, have a null digest and match nothing. Of licences with one digest the first by name
    counts. Columns other than ``key`` and ``text`` are not looked at.
    The known digests are the only broadcast side; they are a list in the code. Rows are aggregated by key and
    text before the shuffle and repeated afterwards, so exact repetitions and equal keys stay apart and whole.
    """
    spark = docs.sparkSession
    table_ = known_digests(spark, known, digests)
    lengths = sorted({n for _, n, _ in table_})
    lines = docs.select(F.col(key), fingerprint(F.col(text)).alias("_text"), canonical_forms(F.coalesce(F.col(text), F.lit(""))).alias("_f"))
    unit = lambda kind, ls: F.struct(F.lit(kind).alias("kind"), digest(ls).alias("digest"))
    kept = F.filter(F.array(unit("kept", F.array_join("_f.kept", " "))), lambda u: u["digest"].isNotNull())
    parts = F.transform(F.array_distinct(F.filter("_f.lines", lambda x: F.length(x).isin(lengths))), lambda x: unit("line", x))
    units = lines.select(key, "_text", F.explode(F.concat(F.array(unit("whole", F.array_join("_f.lines", " "))), kept, parts)).alias("_unit")).select(key, "_text", "_unit.kind", "_unit.digest")
    frame = spark.createDataFrame([(i, d) for i, _, d in table_] or [("", "")], "license_id string, digest string")
    looked_up = units.join(F.broadcast(frame), "digest", "left").filter("kind = 'whole' OR license_id IS NOT NULL")
    of = lambda kind, c: F.when(F.col("kind") == kind, F.col(c))
    grouped = looked_up.groupBy(key, "_text").agg(
        F.max(of("whole", "digest")).alias("digest"),
        F.coalesce(F.max(of("whole", "license_id")), F.max(of("kept", "license_id"))).alias("license_id"),
        F.array_sort(F.collect_set(of("line", "license_id"))).alias("notices"),
        F.count(of("whole", "kind")).alias("_rows"),
    )
    return grouped.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int")))).drop("_row", "_rows", "_text")


def op1_licenses(spark, sf_dir: str) -> DataFrame:
    """Every document with its canonical digest and the licences found."""
    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "digest", "license_id", F.array_join("notices", ",").alias("notices"))


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    same = "lower(t)"
    for _, pattern, to in spellings():
        same = f"regexp_replace({same}, {quote(pattern)}, {quote(to.replace('$', chr(92)))}, 'g')"
    values = ",\n".join(f"({quote(i)}, {quote(t)})" for i, t in KNOWN)
    digests = ",\n".join(f"({quote(i)}, {quote(d)})" for i, _, d in KNOWN_DIGESTS)
    calm = f"regexp_replace(regexp_replace({same}, {quote(COPYRIGHT_LINE)}, '', 'g'), {quote(RIGHTS_LINE)}, '', 'g')"
    wide = rf"'  ' || regexp_replace(regexp_replace(l, {quote(LEADER)}, ''), '\s+', '  ', 'g') || '  '"
    bare_ = rf"trim(regexp_replace(regexp_replace({wide}, {quote(CLAUSE)}, '  ', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' ')"
    whole = lambda source, form: f"""SELECT rid, string_agg(l, ' ' ORDER BY i) AS c FROM (
  SELECT rid, i, {bare_} AS l FROM (SELECT rid, unnest(string_split(c, chr(10))) AS l, generate_subscripts(string_split(c, chr(10)), 1) AS i
    FROM (SELECT rid, {form} AS c FROM {source}))) WHERE l <> '' GROUP BY rid"""  # noqa: E731
    return f"""
WITH known_texts(rid, t) AS (VALUES {values}),
numbered AS (SELECT row_number() OVER () AS rid, rid AS license_id, t FROM known_texts),
known AS (
  SELECT digest, min(license_id) AS license_id FROM (
    SELECT n.license_id, sha256(w.c) AS digest FROM numbered n JOIN ({whole('numbered', calm)}) w USING (rid)
    UNION ALL SELECT n.license_id, sha256(w.c) AS digest FROM numbered n JOIN ({whole('numbered', same)}) w USING (rid)
    UNION ALL SELECT * FROM (VALUES {digests})) GROUP BY 1),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
whole AS ({whole('d', calm)}),
kept AS ({whole('d', same)}),
lines AS (SELECT rid, sha256({bare_}) AS digest FROM (SELECT rid, unnest(string_split({calm}, chr(10))) AS l FROM d) WHERE {bare_} <> ''),
notices AS (SELECT rid, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS n FROM lines JOIN known USING (digest) GROUP BY rid)
SELECT doc_id, sha256(w.c) AS digest, coalesce(k.license_id, m.license_id) AS license_id, coalesce(n.n, '') AS notices
FROM d LEFT JOIN whole w USING (rid) LEFT JOIN kept p USING (rid) LEFT JOIN known k ON sha256(w.c) = k.digest LEFT JOIN known m ON sha256(p.c) = m.digest
LEFT JOIN notices n USING (rid)
"""


OP1_SQL = _sql()
