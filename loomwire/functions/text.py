"""Column functions on titles, texts and names. All are pure expressions; null counts as an empty text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwire.config import (
    ACTION_HINTS,
    CATEGORY_IDS,
    CATEGORY_NAMES,
    DEFAULT,
    DEFAULT_CATEGORY,
    DEFAULT_CATEGORY_ID,
    ENTITY_STOPWORDS,
)

#: Python's and Java's word classes differ: spelled out, they are the same everywhere.
NOT_WORD = r"[^\p{L}\p{N}_\s]"


def full(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def first_of(*columns: Column) -> Column:
    """The first that is neither null nor empty, else an empty text."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def slugify(c: Column) -> Column:
    bare = F.regexp_replace(F.lower(F.trim(full(c))), "[^a-z0-9]+", "-")
    return first_of(F.trim(bare, F.lit("-")), F.lit("source"))


def normalize_title(c: Column) -> Column:
    """Lower case, punctuation a space, white space collapsed."""
    return collapse(F.regexp_replace(F.lower(full(c)), NOT_WORD, " "))


def normalize_title_for_hash(c: Column) -> Column:
    """Lower case and white space collapsed first, punctuation removed after, which may leave two spaces."""
    return F.regexp_replace(collapse(F.lower(full(c))), NOT_WORD, "")


def content_digest(c: Column, chars: int = DEFAULT.digest_chars) -> Column:
    n = normalize_title(F.substring(full(c), 1, chars))
    return F.when(n == "", "").otherwise(F.substring(F.sha1(n), 1, 16))


def article_id(*parts: Column) -> Column:
    """Twelve hex digits of the non-empty parts; null when all are empty."""
    given = [F.trim(F.nullif(p, F.lit(""))) for p in parts]
    return F.when(F.coalesce(*given).isNotNull(), F.substring(F.md5(F.concat_ws("||", *given)), 1, 12))


def title_hash(title: Column) -> Column:
    return F.substring(F.md5(normalize_title_for_hash(title)), 1, 12)


def article_key(source: Column, normalized_url: Column, hashed_title: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("|", full(source), full(normalized_url), hashed_title)), 1, 20)


def title_bigrams(c: Column) -> Column:
    """The set of character pairs of a title without punctuation; fewer than two characters have none."""
    t = F.regexp_replace(F.regexp_replace(F.trim(F.lower(full(c))), NOT_WORD, ""), r"\s+", " ")
    pairs = let(t, lambda x: F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.substring(x, i, F.lit(2))))
    return F.when(F.length(t) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(pairs))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets; 0 when either is empty."""
    both = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    return F.when((F.size(a) < 1) | (F.size(b) < 1) | a.isNull() | b.isNull(), 0.0).otherwise(both)


def lowered(a: Column) -> Column:
    return F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.lower(x))


def set_similarity(a: Column, b: Column) -> Column:
    """Jaccard of two lists of names, whatever their case."""
    return jaccard(F.array_distinct(lowered(a)), F.array_distinct(lowered(b)))


def first_wins(names: Column, limit: int) -> Column:
    """The list without later entries that differ in case only, cut at ``limit``."""
    low = lowered(names)
    return let(low, lambda x: F.slice(F.filter(names, lambda n, i: F.array_position(x, F.get(x, i)) == i + 1), 1, limit))


# What counts as a name, as capitals, as a Chinese run, and the characters kept of them.
_NAME = r"\b[A-Z][A-Za-z0-9&'/-]{1,}(?:\s+[A-Z][A-Za-z0-9&'/-]{1,}){0,2}"
_CAPITALS, _CHINESE, _UNKEPT = r"(\b[A-Z]{2,}\b)", "([一-鿿]{2,6})", r"[^0-9A-Za-z一-鿿&'\- ]"


def extract_entities(text: Column, limit: int = 12) -> Column:
    """Runs of one to three capitalised words, then words in capitals, then Chinese runs: cleaned, without stop words,
    each once (first spelling)."""
    t = full(text)
    found = F.concat(
        F.regexp_extract_all(t, F.lit(f"({_NAME})")),
        F.regexp_extract_all(t, F.lit(_CAPITALS)),
        F.slice(F.regexp_extract_all(t, F.lit(_CHINESE)), 1, 20),
    )
    clean = F.transform(found, lambda x: F.trim(F.regexp_replace(x, _UNKEPT, "")))
    kept = F.filter(clean, lambda x: (F.length(x) >= 2) & ~x.isin(*ENTITY_STOPWORDS))
    return let(kept, lambda k: first_wins(k, limit))


def extract_actions(text: Column, limit: int = 8) -> Column:
    """The hints that occur anywhere in the text, in the order of the hints."""
    low = F.lower(full(text))
    hints = F.array(*[F.lit(h) for h in ACTION_HINTS])
    return let(low, lambda x: F.slice(F.filter(hints, lambda h: F.contains(x, h)), 1, limit))


def extractive_summary(text: Column, limit: int = DEFAULT.embed_summary_chars) -> Column:
    """Whole leading sentences as far as they fit into ``limit`` characters; if none does, a cut."""
    raw = collapse(full(text))
    sentences = F.filter(F.split(raw, r"(?<=[。！？.!?])\s+"), lambda s: F.trim(s) != "")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("used"), F.lit(False).alias("over"))

    def take(state: Column, s: Column) -> Column:
        more = F.length(s) + F.when(F.size(state["out"]) > 0, 1).otherwise(0)
        over = state["over"] | (state["used"] + more > limit)
        return F.struct(
            F.when(over, state["out"]).otherwise(F.concat(state["out"], F.array(s))).alias("out"),
            F.when(over, state["used"]).otherwise(state["used"] + more).alias("used"),
            over.alias("over"),
        )

    whole = F.aggregate(sentences, start, take, lambda s: F.array_join(s["out"], " "))
    return F.trim(first_of(whole, F.substring(raw, 1, limit)))


def embedding_text(source, lang, content_type, title, article_summary, embedding_summary, full_text, snippet, limit: int = DEFAULT.embedding_input_chars) -> Column:
    body = F.substring(F.trim(first_of(article_summary, embedding_summary, full_text, snippet)), 1, limit)
    trimmed = lambda c: F.trim(full(c))
    return F.concat(
        F.lit("source: "), trimmed(source), F.lit(" ("), trimmed(lang), F.lit(")\ntype: "), trimmed(content_type),
        F.lit("\ntitle: "), trimmed(title), F.lit("\ncontent: "), body,
    )


def analysis_text(title, source, lang, source_type, category, published, article_summary, content_text, snippet, limit: int = DEFAULT.analysis_input_chars) -> Column:
    """What a reviewer of an article is shown."""
    trimmed = lambda c: F.trim(full(c))
    body = F.substring(F.trim(first_of(article_summary, content_text, snippet)), 1, limit)
    return F.concat(
        F.lit("title: "), trimmed(title), F.lit("\nsource: "), trimmed(source), F.lit(" ("), trimmed(lang), F.lit(", "), trimmed(source_type), F.lit(")"),
        F.lit("\ncategory: "), trimmed(category), F.lit("\npublished: "), trimmed(published), F.lit("\ncontent: "), body,
    )


def extract_json(text: Column) -> Column:
    """The first JSON found in a reply: a fenced block, else the widest braces, else the widest brackets; else null."""
    t = full(text)
    fenced = F.regexp_extract(t, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces, brackets = F.regexp_extract(t, r"(?s)(\{.*\})", 1), F.regexp_extract(t, r"(?s)(\[.*\])", 1)
    parsed = lambda c: F.to_json(F.try_parse_json(F.nullif(F.trim(c), F.lit(""))))
    return F.coalesce(parsed(fenced), parsed(braces), parsed(brackets))


def _lookup(table: dict[str, str], c: Column) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), full(c))


def category_id(name: Column) -> Column:
    return F.coalesce(_lookup(CATEGORY_IDS, name), F.lit(DEFAULT_CATEGORY_ID))


def category_name(ident: Column) -> Column:
    return F.coalesce(_lookup(CATEGORY_NAMES, ident), F.lit(DEFAULT_CATEGORY))
