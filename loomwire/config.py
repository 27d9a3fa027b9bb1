"""Thresholds and limits of the fusion engine, in one frozen object."""

from __future__ import annotations

from dataclasses import dataclass


# Thresholds and limits with which results agree.
@dataclass(frozen=True)
class FusionConfig:
    tombstone_ttl_days: int = 30
    incremental_assign_score: float = 0.63
    max_topics: int = 500
    embedding_input_chars: int = 1800
    analysis_input_chars: int = 2200
    fulltext_chars: int = 8000
    html_text_chars: int = 3000
    snippet_chars: int = 800
    digest_chars: int = 1200
    embed_summary_chars: int = 600
    max_page_images: int = 200
    max_page_texts: int = 500
    max_items_per_source: int = 30
    crawl_pages: int = 2
    semantic_distance: float = 0.37
    tfidf_distance: float = 0.78
    title_similarity: float = 0.6
    dedup_days: int = 3
    stage_a_distance: float = 0.34
    stage_a_similarity: float = 0.82
    stage_a_fingerprint: float = 0.58
    stage_b_low: float = 0.55
    stage_b_high: float = 0.78
    stage_b_high_quality_reviews: int = 24
    stage_b_low_cost_reviews: int = 140
    high_confidence: float = 0.78
    cross_merge_strong: float = 0.66
    cross_merge_boundary: float = 0.62
    cross_merge_pairs: int = 220
    cross_merge_low_cost_reviews: int = 60
    cross_merge_high_quality_reviews: int = 15


DEFAULT = FusionConfig()

# Query keys and prefixes that only track a reader.
TRACKING_KEYS = ["fbclid", "gclid", "igshid", "ref", "ref_", "spm"]
TRACKING_PREFIXES = ["utm_", "mc_", "mkt_", "oly_"]

# Words whose presence marks an action, in order of precedence.
ACTION_HINTS = [
    "launch", "drops", "debut", "present", "show", "unveil", "announce", "release", "collaboration",
    "acquire", "buy", "sale", "invest", "raise", "open", "close", "appoint", "resign", "exit",
    "lawsuit", "ban", "strike", "campaign", "partnership", "capsule", "runway", "collection",
    "推出", "发布", "首发", "亮相", "联名", "收购", "任命", "离任", "开店", "关闭", "秀场", "系列",
]

# Capitalised words that are no entities.
ENTITY_STOPWORDS = [
    "The", "This", "That", "With", "From", "Into", "Over", "Under", "After", "Before",
    "Fashion", "Style", "Week", "News", "Report", "Review",
]

# Categories by name, and the names shown for their identifiers.
CATEGORY_IDS = {
    "秀场/系列": "runway-collection",
    "街拍/造型": "street-style",
    "趋势总结": "trend-summary",
    "品牌/市场": "brand-market",
    "高端时装": "runway-collection",
    "潮流街头": "street-style",
    "行业动态": "brand-market",
    "男装风尚": "street-style",
    "先锋文化": "trend-summary",
}
CATEGORY_NAMES = {"runway-collection": "秀场/系列", "street-style": "街拍/造型", "trend-summary": "趋势总结", "brand-market": "品牌/市场"}
DEFAULT_CATEGORY, DEFAULT_CATEGORY_ID, DEFAULT_CONTENT_TYPE = "品牌/市场", "brand-market", "general-fashion"
