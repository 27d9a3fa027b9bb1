"""Event fingerprints: what, by whom, when."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwire.functions.text import extract_actions, extract_entities, full, lowered, set_similarity
from loomwire.functions.times import bucket_score, time_bucket

ENTITY_WEIGHT, ACTION_WEIGHT, TIME_WEIGHT = 0.55, 0.20, 0.25


def _sorted(names: Column) -> Column:
    return F.array_join(F.array_sort(lowered(names)), ",")


def fingerprint_hash(entities: Column, actions: Column, dates: list[Column], sources: Column, n_entities: int, n_actions: int) -> Column:
    days = [F.date_format(d, "yyyy-MM-dd") for d in dates]
    parts = [_sorted(F.slice(entities, 1, n_entities)), _sorted(F.slice(actions, 1, n_actions)), *days, F.array_join(F.array_sort(sources), ",")]
    return F.substring(F.md5(F.concat_ws("|", *parts)), 1, 16)


def event_fingerprint(title, article_summary, embedding_summary, snippet, source, published: Column, run_ts: Column) -> Column:
    """STRUCT<hash, entities, actions, time_bucket, sources> of an article."""
    text = F.concat_ws(" ", full(title), full(article_summary), full(embedding_summary), full(snippet))
    sources = F.when(full(source) == "", F.array().cast("array<string>")).otherwise(F.array(source))
    entities, actions, bucket = extract_entities(text), extract_actions(text), time_bucket(published, run_ts)
    made = F.struct(entities.alias("entities"), actions.alias("actions"), bucket.alias("time_bucket"), sources.alias("sources"))
    return F.element_at(
        F.transform(
            F.array(made),
            lambda f: F.struct(
                fingerprint_hash(f["entities"], f["actions"], [f["time_bucket"]], f["sources"], 8, 6).alias("hash"),
                f["entities"].alias("entities"),
                f["actions"].alias("actions"),
                f["time_bucket"].alias("time_bucket"),
                f["sources"].alias("sources"),
            ),
        ),
        1,
    )


def fingerprint_similarity(a: Column, b: Column) -> Column:
    """Weighted agreement of entities, actions and time of two fingerprints (structs or prefixes of columns)."""
    entity = set_similarity(a["entities"], b["entities"])
    action = set_similarity(a["actions"], b["actions"])
    return ENTITY_WEIGHT * entity + ACTION_WEIGHT * action + TIME_WEIGHT * bucket_score(a["time_bucket"], b["time_bucket"])
