"""The registered queries of the fusion engine, and the SQL that gives the same rows.

Articles, vectors and verdicts are made from the test tables (``loomwire.sources.fixtures``). Topics are groups of articles
by a remainder of the document's number, so that SQL can form them too.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwire.config import ACTION_HINTS, CATEGORY_IDS, DEFAULT, ENTITY_STOPWORDS, TRACKING_KEYS
from loomwire.functions import text as tx
from loomwire.functions import times as tm
from loomwire.functions import urls as ur
from loomwire.functions.fingerprints import fingerprint_similarity
from loomwire.operators import cluster as cl
from loomwire.operators import dedup as dd
from loomwire.operators import feed as fd
from loomwire.operators import ingest as ig
from loomwire.operators import pages as pg
from loomwire.operators import simjoin as sj
from loomwire.operators import state as st
from loomwire.operators import topics as tp
from loomwire.operators import verdicts as vd
from loomwire.operators.graph import connected_components
from loomwire.session import cut
from loomwire.sources import fixtures as fx

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


# ---- SQL pieces -------------------------------------------------------------------------------------------------------

quote = lambda s: "'" + s.replace("'", "''") + "'"
listed = lambda xs: "[" + ", ".join(quote(x) for x in xs) + "]"
collapse = lambda x: rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"
norm = lambda x: collapse(rf"regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')")
hashable = lambda x: rf"regexp_replace({collapse(f'lower({x})')}, '[^\p{{L}}\p{{N}}_\s]', '', 'g')"

ART = f"""
a0 AS (SELECT doc_id, source, lang, text, 'https://' || source || '.example.com/a/' || doc_id AS link,
  trim(substr(split_part(text, chr(10), 1), 1, 120)) AS title, TIMESTAMP '2024-01-01' + to_minutes((doc_id * 7919) % 14400) AS published FROM documents),
art AS (SELECT *, substr(md5(link || '||' || title || '||' || source), 1, 12) AS id, substr(text, 1, 800) AS snippet,
  substr(md5({hashable('title')}), 1, 12) AS title_hash,
  CASE WHEN {norm("substr(text, 1, 1200)")} = '' THEN '' ELSE substr(sha1({norm("substr(text, 1, 1200)")}), 1, 16) END AS content_hash FROM a0)"""
KEYED = ART + ", keyed AS (SELECT *, substr(md5(source || '|' || link || '|' || title_hash), 1, 20) AS article_key FROM art)"
VEC = """
vec AS (SELECT e.vec_id AS id, list_transform(list_zip(b.embedding, e.embedding), lambda z: z[1]::DOUBLE + 0.6::DOUBLE * z[2]::DOUBLE) AS u
  FROM embeddings e JOIN embeddings b ON b.vec_id = e.vec_id % 50 AND b.vec_id < 50),
vecs AS (SELECT id, list_transform(u, lambda x: x / sqrt(list_inner_product(u, u))) AS v FROM vec)"""
_clean = r"trim(regexp_replace(x, '[^0-9A-Za-z一-鿿&''\- ]', '', 'g'))"
# RE2 knows no word borders beyond ASCII: the character before a name is matched too, those around capitals are doubled
_edge = r"[^\p{L}\p{N}_]"
_name = rf"(?:^|{_edge})([A-Z][A-Za-z0-9&''/-]{{1,}}(?:\s+[A-Z][A-Za-z0-9&''/-]{{1,}}){{0,2}})"


def entities_sql(t: str, n: int = 12) -> str:
    """The entities of a text; three lists, cleaned, then the first of each spelling."""
    wide = rf"regexp_replace({t}, '({_edge})', '\1\1', 'g')"
    capitals = rf"regexp_extract_all({wide}, '(?:^|{_edge})([A-Z]{{2,}})(?:$|{_edge})', 1)"
    found = rf"list_concat(list_concat(regexp_extract_all({t}, '{_name}', 1), {capitals}), regexp_extract_all({t}, '([一-鿿]{{2,6}})')[1:20])"
    kept = f"list_filter(list_transform({found}, lambda x: {_clean}), lambda x: length(x) >= 2 AND NOT list_contains({listed(ENTITY_STOPWORDS)}, x))"
    return f"list_transform([{kept}], lambda k: list_filter(k, lambda y, i: list_position(list_transform(k, lambda q: lower(q)), lower(y)) = i)[1:{n}])[1]"


def actions_sql(t: str, n: int = 8) -> str:
    return f"list_filter({listed(ACTION_HINTS)}, lambda h: contains(lower({t}), h))[1:{n}]"


_low = lambda x: f"list_sort(list_transform({x}, lambda q: lower(q)))"
bucket_sql = lambda ts: f"to_timestamp(floor(epoch({ts}) / 21600) * 21600)::TIMESTAMP"
FP = (
    KEYED
    + f""",
e0 AS (SELECT *, concat_ws(' ', title, '', '', snippet) AS t FROM keyed),
e1 AS (SELECT *, {entities_sql('t')} AS entities, {actions_sql('t')} AS actions, {bucket_sql('published')} AS bucket FROM e0),
fp AS (SELECT *, substr(md5(concat_ws('|', array_to_string({_low('entities[1:8]')}, ','), array_to_string({_low('actions[1:6]')}, ','), strftime(bucket, '%Y-%m-%d'), source)), 1, 16) AS hash FROM e1)"""
)


def jaccard_sql(a: str, b: str) -> str:
    low = lambda x: f"list_distinct(list_transform({x}, lambda q: lower(q)))"
    both = f"len(list_intersect({low(a)}, {low(b)}))"
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE {both}::DOUBLE / (len({low(a)}) + len({low(b)}) - {both}) END"


def time_score_sql(a: str, b: str) -> str:
    h = f"abs(epoch({a}) - epoch({b})) / 3600"
    return f"CASE WHEN {h} <= 12 THEN 1.0::DOUBLE WHEN {h} <= 36 THEN 0.75::DOUBLE WHEN {h} <= 72 THEN 0.45::DOUBLE ELSE 0.0::DOUBLE END"


def similarity_sql(a: str, b: str) -> str:
    return f"(0.55::DOUBLE * {jaccard_sql(f'{a}.entities', f'{b}.entities')} + 0.2::DOUBLE * {jaccard_sql(f'{a}.actions', f'{b}.actions')} + 0.25::DOUBLE * {time_score_sql(f'{a}.bucket', f'{b}.bucket')})"


NOTHING = "SELECT 0::BIGINT AS violations"


def r6(c):
    return F.round(c, 6)


def fingerprinted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ig.attach_fingerprints(fx.articles(spark, sf_dir), fx.run_ts())


def numbered(df: DataFrame) -> DataFrame:
    """Articles under their document's number, which joins them to vectors."""
    return df.drop("id").withColumnRenamed("doc_id", "id")


# ---- sources and articles ----------------------------------------------------------------------------------------------


@query("WITH" + ART + ", k AS (SELECT *, row_number() OVER (PARTITION BY link ORDER BY published DESC, id) AS n FROM art) SELECT id, title, link, source, published, 'brand-market' AS category_id, content_hash FROM k WHERE n = 1 ORDER BY published DESC, id LIMIT 500")
def newest_articles(spark, sf_dir):
    """The 500 newest articles, each address once."""
    best = tp.newest_first(dd.dedup_exact(fx.articles(spark, sf_dir))).limit(500)
    return best.select("id", "title", "link", "source", "published", "category_id", "content_hash")


@query("WITH s AS (SELECT DISTINCT source FROM documents) SELECT 'rss' AS type, count(*) AS n FROM s")
def source_counts(spark, sf_dir):
    """S1, S2."""
    return ig.source_type_counts(fx.sources(spark, sf_dir))


@query("WITH" + ART + " SELECT doc_id, id, link, source || '.example.com' AS source_host, snippet AS content_snippet, content_hash, published, false AS has_offset FROM art")
def article_records(spark, sf_dir):
    """S3, J4, C2, C7, C24."""
    return fx.articles(spark, sf_dir).select("doc_id", "id", "link", "source_host", "content_snippet", "content_hash", "published", "has_offset")


@query("WITH" + ART + " SELECT doc_id, source AS source_id FROM art WHERE title <> '' QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 30")
def source_caps(spark, sf_dir):
    """S4."""
    return ig.cap_per_source(fx.entries(spark, sf_dir), [F.col("doc_id")]).select("doc_id", "source_id")


@query("SELECT lang, count(*) AS n, count(n_chars) AS with_size FROM (SELECT lang, n_chars FROM documents UNION ALL SELECT split_part(url, '/', 4), NULL FROM pages) GROUP BY lang")
def source_union(spark, sf_dir):
    """Documents and pages as one frame, the pages without sizes."""
    docs = fx.read(spark, sf_dir, "documents").select("lang", "n_chars")
    pages = fx.read(spark, sf_dir, "pages").select(F.split_part("url", F.lit("/"), F.lit(4)).alias("lang"))
    return ig.union_sources(docs, pages).groupBy("lang").agg(F.count("*").alias("n"), F.count("n_chars").alias("with_size"))


# ---- scalar functions -----------------------------------------------------------------------------------------------------

_q = "list_filter(string_split(coalesce(regexp_extract(url, '\\?([^#]*)', 1), ''), '&'), lambda p: contains(p, '=') AND split_part(p, '=', 2) <> '' AND NOT list_contains(" + listed(TRACKING_KEYS) + ", lower(split_part(p, '=', 1))) AND NOT regexp_matches(lower(p), '^(utm_|mc_|mkt_|oly_)'))"
_path = r"regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+', '/', 'g')"
URLS = rf"""u AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS s, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host,
  {_path} AS p, array_to_string({_q}, '&') AS q FROM pages),
urls AS (SELECT page_id, host, s || '://' || host || CASE WHEN p IN ('', '/') THEN '/' ELSE regexp_replace(p, '/+$', '') END || CASE WHEN q = '' THEN '' ELSE '?' || q END AS url FROM u)"""


@query(f"WITH {URLS} SELECT page_id, host, url FROM urls")
def url_normalize(spark, sf_dir):
    """C1, C2."""
    p = fx.read(spark, sf_dir, "pages")
    return p.select("page_id", ur.url_host(F.col("url")).alias("host"), ur.normalize_url(F.col("url")).alias("url"))


@query(f"WITH {URLS} SELECT host, count(*) AS pages, count(DISTINCT url) AS urls FROM urls GROUP BY host")
def url_dedup(spark, sf_dir):
    """Pages and different addresses of each host."""
    return url_normalize(spark, sf_dir).groupBy("host").agg(F.count("*").alias("pages"), F.count_distinct("url").alias("urls"))


@query("WITH" + ART + f" SELECT doc_id, {norm('title')} AS norm_title, {hashable('title')} AS hash_title, title_hash, coalesce(nullif(trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'source') AS slug FROM art")
def title_keys(spark, sf_dir):
    """C3, C4, C5."""
    t = F.col("title")
    return fx.articles(spark, sf_dir).select("doc_id", tx.normalize_title(t).alias("norm_title"), tx.normalize_title_for_hash(t).alias("hash_title"), "title_hash", tx.slugify(t).alias("slug"))


@query("WITH" + ART + " SELECT content_hash, count(*) AS n, min(doc_id) AS first_doc FROM art GROUP BY content_hash")
def content_digest(spark, sf_dir):
    """C6."""
    return fx.articles(spark, sf_dir).groupBy("content_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query("WITH" + KEYED + " SELECT doc_id, article_key, link AS normalized_url, title_hash FROM keyed")
def article_keys(spark, sf_dir):
    """C8."""
    return fx.articles(spark, sf_dir).select("doc_id", "article_key", "normalized_url", "title_hash")


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, date_trunc('second', ts) AS parsed, event_id % 2 = 0 AS with_offset, epoch_us(ts) <= epoch_us(TIMESTAMP '2024-01-18') AND event_id % 2 = 0 AS near FROM events")
def times_parsed(spark, sf_dir):
    """Times as texts, every other one with an offset, read again and held against a fixed day."""
    e = fx.read(spark, sf_dir, "events")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.when(F.col("event_id") % 2 == 0, F.concat(iso, F.lit("Z"))).otherwise(iso)
    day = F.lit("2024-01-10 00:00:00").cast("timestamp")
    seen = e.select("event_id", iso.alias("iso"), raw.alias("raw"), "ts")
    near = tm.within_days(F.col("ts"), tm.has_offset(F.col("raw")), day, F.lit(True), 8) | (F.col("ts") < day) & tm.has_offset(F.col("raw"))
    return seen.select("event_id", "iso", tm.parse_time(F.col("raw")).alias("parsed"), tm.has_offset(F.col("raw")).alias("with_offset"), near.alias("near"))


@query(f"SELECT {bucket_sql('ts')} AS bucket, event_type, count(*) AS n FROM events GROUP BY ALL")
def time_bucket_counts(spark, sf_dir):
    """C11, T8 as a batch."""
    e = fx.read(spark, sf_dir, "events")
    return e.groupBy(tm.time_bucket(F.col("ts"), fx.run_ts()).alias("bucket"), "event_type").agg(F.count("*").alias("n"))


@query(f"SELECT event_id, {time_score_sql('ts', chr(84) + 'IMESTAMP ' + quote('2024-01-15'))} AS score FROM events")
def time_scores(spark, sf_dir):
    """C12."""
    return fx.read(spark, sf_dir, "events").select("event_id", tm.bucket_score(F.col("ts"), F.lit("2024-01-15").cast("timestamp")).alias("score"))


@query("SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%-m/%-d %H:%M') AS short, strftime(ts + INTERVAL 8 HOUR, '%Y年%-m月%-d日 %H:%M') AS long FROM events")
def display_times(spark, sf_dir):
    """C25."""
    ts = F.col("ts")
    return fx.read(spark, sf_dir, "events").select("event_id", tm.display_time(ts).alias("short"), tm.display_time(ts, "full").alias("long"))


@query("WITH" + FP + " SELECT doc_id, entities FROM fp")
def entities(spark, sf_dir):
    """C15."""
    return fingerprinted(spark, sf_dir).select("doc_id", "event_fingerprint.entities")


@query("WITH" + FP + " SELECT doc_id, actions FROM fp")
def actions(spark, sf_dir):
    """C16."""
    return fingerprinted(spark, sf_dir).select("doc_id", "event_fingerprint.actions")


@query("WITH" + FP + " SELECT doc_id, hash, bucket AS time_bucket FROM fp")
def fingerprints(spark, sf_dir):
    """C17."""
    return fingerprinted(spark, sf_dir).select("doc_id", "event_fingerprint.hash", "event_fingerprint.time_bucket")


@query("WITH" + FP + f" SELECT a.doc_id AS a, b.doc_id AS b, round({similarity_sql('a', 'b')}, 6) AS similarity FROM fp a JOIN fp b ON b.doc_id = a.doc_id + 20")
def fingerprint_pairs(spark, sf_dir):
    """Articles twenty numbers apart."""
    f = cut(fingerprinted(spark, sf_dir).select("doc_id", "event_fingerprint"))
    other = f.select((F.col("doc_id") - 20).alias("a"), F.col("doc_id").alias("b"), F.col("event_fingerprint").alias("g"))
    both = f.join(other, F.col("doc_id") == F.col("a"))
    return both.select("a", "b", r6(fingerprint_similarity(F.col("event_fingerprint"), F.col("g"))).alias("similarity"))


_bare = r"regexp_replace(regexp_replace(trim(lower(title)), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g')"
BIGRAMS = ART + f", t AS (SELECT doc_id, {_bare} AS b FROM art), bg AS (SELECT doc_id, CASE WHEN length(b) < 2 THEN [] ELSE list_distinct(list_transform(range(1, length(b)), lambda i: substr(b, i, 2))) END AS g FROM t)"


@query("WITH" + BIGRAMS + " SELECT doc_id, len(g)::INT AS n, list_sort(g) AS grams FROM bg")
def bigrams(spark, sf_dir):
    """C13."""
    g = tx.title_bigrams(F.col("title"))
    return fx.articles(spark, sf_dir).select("doc_id", F.size(g).alias("n"), F.array_sort(g).alias("grams"))


@query("WITH" + ART + " SELECT doc_id, 'source: ' || source || ' (' || l || ')' || chr(10) || 'type: general-fashion' || chr(10) || 'title: ' || title || chr(10) || 'content: ' || trim(snippet) AS text FROM art JOIN (SELECT source, min(lang) AS l FROM documents GROUP BY source) USING (source)")
def embedding_texts(spark, sf_dir):
    """C20."""
    c = F.col
    made = tx.embedding_text(c("source"), c("source_lang"), c("content_type"), c("title"), c("article_summary"), c("embedding_summary"), c("full_text"), c("content_snippet"))
    return fx.articles(spark, sf_dir).select("doc_id", made.alias("text"))


@query(
    "WITH" + ART + rf""", s AS (SELECT doc_id, {collapse('text')} AS t, list_filter(string_split(regexp_replace({collapse('text')}, '([。！？.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS s FROM art),
n AS (SELECT *, list_transform(range(1, len(s) + 1), lambda i: list_sum(list_transform(s[1:i], lambda x: length(x))) + i - 1) AS used FROM s)
SELECT doc_id, CASE WHEN len(list_filter(used, lambda u: u <= 600)) > 0 THEN array_to_string(s[1:len(list_filter(used, lambda u: u <= 600))], ' ') ELSE trim(substr(t, 1, 600)) END AS embedding_summary FROM n"""
)
def extractive_summaries(spark, sf_dir):
    """No verdicts, so every article summarises itself."""
    a = fx.articles(spark, sf_dir)
    told = spark.createDataFrame([], "article_key string, summary string")
    return vd.embedding_summaries(a, told).select("doc_id", "embedding_summary")


@query("SELECT item_id, CASE item_id % 3 WHEN 0 THEN NULL ELSE '{\"id\":' || item_id || '}' END AS found FROM benchmark")
def extracted_json(spark, sf_dir):
    """Replies with a fenced block, with bare braces, and without any."""
    b = fx.read(spark, sf_dir, "benchmark")
    body = F.concat(F.lit('{"id": '), F.col("item_id"), F.lit("}"))
    reply = F.when(F.col("item_id") % 3 == 0, F.col("text")).when(F.col("item_id") % 3 == 1, F.concat("text", F.lit("\n```json\n"), body, F.lit("\n```"))).otherwise(F.concat("text", F.lit(" "), body))
    return b.select("item_id", tx.extract_json(reply).alias("found"))


_cats = list(CATEGORY_IDS)


@query(f"SELECT doc_id, CASE {listed(_cats)}[(doc_id % 10)::INT + 1] " + " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in CATEGORY_IDS.items()) + " ELSE 'brand-market' END AS category FROM documents")
def category_ids(spark, sf_dir):
    """A tenth of the names is unknown."""
    name = F.get(F.array(*[F.lit(c) for c in _cats]), F.pmod("doc_id", F.lit(10)).cast("int"))
    return fx.read(spark, sf_dir, "documents").select("doc_id", tx.category_id(name).alias("category"))


# ---- pages -------------------------------------------------------------------------------------------------------------------


def shown_sql(html: str) -> str:
    """The text that a page of the test tables' form shows."""
    bare = rf"regexp_replace(regexp_replace({html}, '(?s)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"
    for mark, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#x27", "''"), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        bare = f"replace({bare}, '&{mark};', '{sign}')"
    return collapse(bare)


_body = r"regexp_extract(html, '(?s)<body[^>]*>(.*)', 1)"
_article = r"regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1)"
_heading = r"regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)"


@query(f"SELECT page_id, coalesce(substr({shown_sql('html')}, 1, 3000), '') AS text, coalesce(substr({shown_sql(_body)}, 1, 8000), '') AS full_text FROM pages")
def page_texts(spark, sf_dir):
    """P1, P3."""
    parts = pg.page_parts(fx.read(spark, sf_dir, "pages"))
    return pg.html_text(parts).join(pg.page_fulltext(parts), "page_id")


@query(
    f"""WITH {URLS}, p AS (SELECT page_id, pages.url, urls.url AS canonical_url, {shown_sql(_heading)} AS title, {shown_sql(_article)} AS t FROM pages JOIN urls USING (page_id))
SELECT page_id, url, canonical_url, coalesce(title, '') AS title, CASE WHEN length(t) >= 120 THEN substr(t, 1, 3000) ELSE '' END AS content_text, '' AS published, '' AS image FROM p"""
)
def page_articles(spark, sf_dir):
    """P2."""
    return pg.extract_pages(pg.page_parts(fx.read(spark, sf_dir, "pages")))


def link_rules(spark: SparkSession) -> DataFrame:
    """Three sources: all links, those with an ``a`` but no ``th``, those of one domain."""
    rows = [("all", [], [], [], [], []), ("some", [], ["/[^/]*a[^/]*$"], ["th"], [], []), ("one", ["example.org"], [], [], [], [])]
    kind = ", ".join(f"{c} array<string>" for c in ("allowed_domains", "include_patterns", "exclude_patterns", "strip_query_params", "page_hosts"))
    return spark.createDataFrame(rows, f"id string, {kind}")


_anchor = r"""regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1)"""
LINKS = rf"""l0 AS (SELECT page_id, regexp_extract(url, '^[a-z]+://', 0) || regexp_extract(url, '://([^/?#]*)', 1) AS root, unnest({_anchor}) AS href FROM pages),
links AS (SELECT DISTINCT page_id, lower(regexp_extract(root, '://(.*)', 1)) AS host, CASE WHEN href = '/' THEN root || '/' ELSE root || regexp_replace(regexp_replace(href, '[?#].*$', ''), '/+$', '') END AS url FROM l0 WHERE href LIKE '/%')"""


@query(rf"""WITH {LINKS} SELECT source_id, count(*) AS links, count(DISTINCT page_id) AS pages FROM (
  SELECT 'all' AS source_id, page_id FROM links UNION ALL
  SELECT 'some', page_id FROM links WHERE regexp_matches(url, '(?i)/[^/]*a[^/]*$') AND NOT regexp_matches(url, '(?i)th') UNION ALL
  SELECT 'one', page_id FROM links WHERE host = 'example.org' OR host LIKE '%.example.org') GROUP BY source_id""")
def link_discovery(spark, sf_dir):
    """Admitted links of each source."""
    found = pg.discover_links(pg.page_parts(fx.read(spark, sf_dir, "pages")), link_rules(spark))
    return found.groupBy("source_id").agg(F.count("*").alias("links"), F.count_distinct("page_id").alias("pages"))


@query(NOTHING)
def frontier_violations(spark, sf_dir):
    """P5 over the pages of each host, each page leading to the next by number: no source goes beyond its limits, and none
    visits a page twice."""
    p = fx.read(spark, sf_dir, "pages").select(ur.url_host(F.col("url")).alias("source_id"), F.col("page_id").cast("string").alias("url"), "page_id")
    starts = p.groupBy("source_id").agg(F.min("page_id").cast("string").alias("url"))
    following = F.lead("page_id").over(Window.partitionBy("source_id").orderBy("page_id"))
    after = p.withColumn("next", following.cast("string")).filter("next IS NOT NULL").select("source_id", "url", "next")
    links = p.select("source_id", F.col("url").alias("page"), F.explode(F.array(F.concat("url", F.lit("-a")), F.concat("url", F.lit("-b")))).alias("url")).withColumn("pos", F.lit(0))
    limits = starts.select("source_id", F.lit(3).alias("max_pages"), F.lit(5).alias("max_items"))
    visited, items = pg.crawl_frontier(starts, after.select("source_id", F.col("url").alias("page"), "next", F.lit(0).alias("pos")), links, limits)
    over = visited.groupBy("source_id").agg(F.count("*").alias("n"), F.count_distinct("url").alias("d")).filter("n > 3 OR n <> d").select("source_id")
    many = items.groupBy("source_id").agg(F.count("*").alias("n"), F.count_distinct("url").alias("d")).filter("n > 5 OR n <> d").select("source_id")
    return over.unionByName(many).agg(F.count("*").alias("violations"))


IMAGES = """c AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'https://img.example.com/ads/' || page_id || '.jpg' WHEN 2 THEN '//img.example.com/logo-' || page_id || '.svg'
  ELSE '/media/' || page_id || '.jpg#x' END AS src, regexp_extract(url, '^([a-z]+)://', 1) AS s, regexp_extract(url, '://([^/?#]*)', 1) AS h FROM pages)"""


@query(f"WITH {IMAGES} SELECT page_id, s || '://' || h || '/media/' || page_id || '.jpg' AS image FROM c WHERE page_id % 6 >= 3")
def image_pick(spark, sf_dir):
    """Pages whose html gets an image of several kinds; advertisements, icons and blanks are not picked."""
    p = fx.read(spark, sf_dir, "pages")
    n = F.pmod("page_id", F.lit(6))
    src = (
        F.when(n == 0, "").when(n == 1, F.concat(F.lit("https://img.example.com/ads/"), "page_id", F.lit(".jpg")))
        .when(n == 2, F.concat(F.lit("//img.example.com/logo-"), "page_id", F.lit(".svg"))).otherwise(F.concat(F.lit("/media/"), "page_id", F.lit(".jpg#x")))
    )
    tagged = p.withColumn("html", F.concat(F.lit('<article><img class="wide" src="'), src, F.lit('"></article>'), "html"))
    return pg.pick_image(pg.page_parts(tagged))


@query("WITH" + ART + ", m AS (SELECT *, doc_id % 3 = 0 AS has, row_number() OVER (PARTITION BY doc_id % 3 = 0 ORDER BY published DESC, id) AS n FROM art) SELECT doc_id, CASE WHEN has THEN 'own' WHEN n <= 200 AND doc_id % 5 > 0 THEN 'found' ELSE 'none' END AS image FROM m")
def backfilled(spark, sf_dir):
    """A third has an image; the 200 newest of the others look for one."""
    a = fx.articles(spark, sf_dir).withColumn("image", F.when(F.col("doc_id") % 3 == 0, "own").otherwise(""))
    found = a.filter(F.col("doc_id") % 5 > 0).select("link", F.lit("found").alias("image"))
    return pg.backfill(a, found, "image", 200, F.lit("none")).select("doc_id", "image")


# ---- deduplication and similarity ------------------------------------------------------------------------------------------------


@query(
    "WITH" + BIGRAMS + f""", f AS (SELECT a.*, g, {norm('title')} AS nt FROM art a JOIN bg USING (doc_id)),
p AS (SELECT x.id AS id_hi, y.id AS id_lo, x.content_hash = y.content_hash AND x.content_hash <> '' AS h, x.nt = y.nt AND x.nt <> '' AS t,
  len(list_intersect(x.g, y.g))::DOUBLE / nullif(len(x.g) + len(y.g) - len(list_intersect(x.g, y.g)), 0) > 0.6 AND len(x.g) > 0 AND len(y.g) > 0 AS s
  FROM f x JOIN f y ON x.source = y.source AND (x.published > y.published OR x.published = y.published AND x.id < y.id) AND abs(epoch(x.published) - epoch(y.published)) <= 259200)
SELECT id_hi, id_lo, CASE WHEN h THEN 'hash' WHEN t THEN 'title' ELSE 'similar' END AS reason FROM p WHERE h OR t OR s"""
)
def probable_same_pairs(spark, sf_dir):
    """D2, J5, J6."""
    return dd.probable_same_pairs(fx.articles(spark, sf_dir))


@query(
    "WITH" + BIGRAMS + f""", f AS (SELECT a.*, g, {norm('title')} AS nt FROM art a JOIN bg USING (doc_id)),
p AS (SELECT y.id, x.id AS o, x.published AS moment, x.content_hash = y.content_hash AND x.content_hash <> '' AS is_hash, x.nt = y.nt AND x.nt <> '' AS is_title,
  len(list_intersect(x.g, y.g))::DOUBLE / nullif(len(x.g) + len(y.g) - len(list_intersect(x.g, y.g)), 0) > 0.6 AND len(x.g) > 0 AND len(y.g) > 0 AS is_like
  FROM f x JOIN f y ON x.source = y.source AND (x.published > y.published OR x.published = y.published AND x.id < y.id) AND abs(epoch(x.published) - epoch(y.published)) <= 259200),
k AS (SELECT id, o, moment, unnest([CASE WHEN is_hash THEN 'hash' END, CASE WHEN is_title THEN 'title' END, CASE WHEN is_like THEN 'similar' END]) AS kind FROM p)
SELECT id, scope, kind, count(*) AS n_earlier, arg_max(o, row(-epoch(moment), o)) AS nearest FROM k, (SELECT unnest(['source', 'host']) AS scope) WHERE kind IS NOT NULL GROUP BY id, scope, kind"""
)
def probable_same_nearest(spark, sf_dir):
    """D2 in linear form; each source has one host."""
    return dd.probable_same_nearest(fx.articles(spark, sf_dir))


#: Parts of a scope whose articles are compared with its kept ones apart.
SHARES = 64


def dedup_faults(articles: DataFrame, kept: DataFrame, dropped: DataFrame) -> DataFrame:
    """``id_lo`` of what is wrong in a deduplication of ``articles`` into ``kept`` and ``dropped``: a kept article with an earlier kept
    neighbour, a dropped one without, one that is neither or both.

    All articles of a scope are compared with all kept ones of it, which are what the three look at; dropped ones are not compared with each
    other. A scope's articles are dealt to SHARES, its kept ones copied to each.
    """
    kept = cut(kept.select("id"))
    f = cut(dd.features(articles).withColumn("o", F.struct((-F.unix_micros("published")).alias("t"), "id")))
    names = ("id", "source_id", "published", "key", "norm", "content_hash", "bigrams", "o")
    x, y = (df.select(*[F.col(c).alias(f"{c}_{k}") for c in names]) for df, k in ((f.join(kept, "id", "left_semi"), "x"), (f, "y")))
    x_dealt, y_dealt = x.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))), y.withColumn("share", F.pmod(F.xxhash64("id_y"), F.lit(SHARES)).cast("int"))
    earlier = F.col("o_x") < F.col("o_y")
    pairs = x_dealt.join(y_dealt, (F.col("source_id_x") == F.col("source_id_y")) & (x_dealt["share"] == y_dealt["share"]) & earlier)
    shared = F.size(F.array_intersect("bigrams_x", "bigrams_y"))
    alike = (F.col("content_hash_x") == F.col("content_hash_y")) | (F.col("norm_x") == F.col("norm_y")) | (shared / (F.size("bigrams_x") + F.size("bigrams_y") - shared) > 0.6)
    close = F.col("published_x") <= F.col("published_y") + F.expr("INTERVAL 3 DAYS")
    fuzzy = pairs.filter(close & F.coalesce(alike, F.lit(False))).select("id_y")
    same_key = x.join(y, (F.col("key_x") == F.col("key_y")) & earlier).select("id_y")
    met = cut(fuzzy.unionByName(same_key).distinct().withColumnRenamed("id_y", "id_lo"))
    wrong = met.join(kept.select(F.col("id").alias("id_lo")), "id_lo")
    unfounded = dropped.select(F.col("id").alias("id_lo")).join(met, "id_lo", "left_anti")
    told = kept.unionByName(dropped.select("id")).groupBy("id").agg(F.count("*").alias("n")).filter("n = 1")
    lost = articles.select("id").join(told, "id", "left_anti").select(F.col("id").alias("id_lo"))
    return wrong.unionByName(unfounded).unionByName(lost)


@query(NOTHING)
def dedup_violations(spark, sf_dir):
    """D3: every article is kept or dropped, no kept one has an earlier kept neighbour, and each dropped one has. The three
    determine the answer. Neighbours are found here by comparing articles of a scope, not by the operator's joins."""
    a = cut(fx.articles(spark, sf_dir).withColumn("dedup_key", F.concat(F.lit("k"), F.col("doc_id") % 800)))
    return dedup_faults(a, *dd.dedup_articles(a)).agg(F.count("*").alias("violations"))


@query(
    "WITH RECURSIVE" + BIGRAMS + f""", f AS (SELECT a.*, g, {norm('title')} AS nt, row_number() OVER (ORDER BY published DESC, id)::INT AS n FROM art a JOIN bg USING (doc_id)),
p AS (SELECT x.n AS hi, y.n AS lo, x.doc_id % 800 = y.doc_id % 800 AS same,
  x.source = y.source AND abs(epoch(x.published) - epoch(y.published)) <= 259200 AND (x.content_hash = y.content_hash AND x.content_hash <> '' OR x.nt = y.nt AND x.nt <> ''
    OR len(list_intersect(x.g, y.g))::DOUBLE / nullif(len(x.g) + len(y.g) - len(list_intersect(x.g, y.g)), 0) > 0.6) AS near
  FROM f x JOIN f y ON x.n < y.n AND (x.source = y.source OR x.doc_id % 800 = y.doc_id % 800)),
a AS MATERIALIZED (SELECT n, coalesce(list(hi) FILTER (same), []) AS keys, coalesce(list(hi) FILTER (near), []) AS alike FROM f LEFT JOIN p ON lo = n AND (same OR near) GROUP BY n),
r AS (SELECT 0 AS n, []::INT[] AS kept, '' AS reason UNION ALL
  SELECT n, CASE WHEN reason = 'kept' THEN list_append(kept, n) ELSE kept END, reason FROM (
    SELECT a.n, r.kept, CASE WHEN list_has_any(r.kept, a.keys) THEN 'key' WHEN list_has_any(r.kept, a.alike) THEN 'fuzzy' ELSE 'kept' END AS reason FROM r JOIN a ON a.n = r.n + 1))
SELECT reason, count(*) AS n FROM r WHERE n > 0 GROUP BY reason"""
)
def dedup_counts(spark, sf_dir):
    """D4."""
    a = fx.articles(spark, sf_dir).withColumn("dedup_key", F.concat(F.lit("k"), F.col("doc_id") % 800))
    return dd.dedup_stats(*dd.dedup_articles(a))


@query("WITH" + VEC + " SELECT a.id AS a, b.id AS b, round(1 - list_inner_product(a.v, b.v), 6) AS distance FROM vecs a JOIN vecs b ON a.id < b.id AND 1 - list_inner_product(a.v, b.v) < 0.34")
def cosine_pairs(spark, sf_dir):
    """D5."""
    return sj.cosine_pairs(fx.vectors(spark, sf_dir), 0.34, "exact").select("a", "b", r6("distance").alias("distance"))


@query("WITH RECURSIVE" + VEC + ", e AS (SELECT a.id AS x, b.id AS y FROM vecs a JOIN vecs b ON a.id <> b.id AND 1 - list_inner_product(a.v, b.v) < 0.3), r AS (SELECT id AS v, id AS u FROM vecs UNION SELECT r.v, e.y FROM r JOIN e ON r.u = e.x) SELECT v AS node, min(u) AS component FROM r GROUP BY v")
def components(spark, sf_dir):
    """G1."""
    v = fx.vectors(spark, sf_dir)
    edges = sj.cosine_pairs(v, 0.3, "exact").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return connected_components(edges, v.select(F.col("id").alias("node")))


@query(NOTHING)
def hac_violations(spark, sf_dir):
    """No two final clusters are nearer than the threshold, no cluster holds a member far from all others, and every vector
    is in one cluster."""
    v = cut(fx.vectors(spark, sf_dir))
    members = cut(cl.hac_average(v, 0.34))
    sums = cl.vector_sums(members, v).select("cluster_id", "n", "s")
    pairs = sj.cosine_pairs(sums.select(F.col("cluster_id").alias("id"), F.col("s").alias("v")), 0.34, "exact")
    side = lambda c, i: sums.select(F.col("cluster_id").alias(c), F.col("n").alias(f"n{i}"), F.col("s").alias(f"s{i}"))
    link = 1 - cl.vec_dot(F.col("s1"), F.col("s2")) / (F.col("n1") * F.col("n2"))
    near = pairs.join(side("a", 1), "a").join(side("b", 2), "b").filter(link < 0.34 - 1e-9).select("a")
    loose = members.groupBy("cluster_id").agg(F.count("*").alias("n")).join(cl.cohesion(members, v), "cluster_id").filter((F.col("n") > 1) & (F.col("cohesion") < 0.5)).select("cluster_id")
    lost = v.join(members.groupBy("id").agg(F.count("*").alias("k")).filter("k = 1"), "id", "left_anti").select(F.col("id").alias("a"))
    return near.unionByName(loose.select(F.col("cluster_id").alias("a"))).unionByName(lost).agg(F.count("*").alias("violations"))


@query()
def tfidf_clusters(spark, sf_dir):
    """Clusters of articles by the terms of title and snippet."""
    a = fx.articles(spark, sf_dir)
    return cl.cluster_stats(cl.cluster_tfidf(a, ["the", "of", "and", "to", "in"]))


_words = r"list_filter(regexp_extract_all(lower(concat_ws(' ', title, title, title, substr(snippet, 1, 300))), '([\p{L}\p{N}_]{2,})'), lambda w: NOT list_contains(['the', 'of', 'and'], w))"


@query(
    "WITH" + ART + f""", w AS (SELECT id, {_words} AS w FROM art),
t AS (SELECT id, unnest(list_concat(w, CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END)) AS term FROM w),
tf AS (SELECT id, term, count(*) AS tf FROM t GROUP BY ALL),
k AS (SELECT term, count(*) AS df, sum(tf) AS n FROM tf GROUP BY term HAVING count(*) <= 0.95 * (SELECT count(*) FROM art) ORDER BY n DESC, term LIMIT 10000),
x AS (SELECT id, term, tf * (ln((1 + (SELECT count(*) FROM art))::DOUBLE / (1 + df)) + 1) AS w FROM tf JOIN k USING (term)),
l AS (SELECT id, sqrt(sum(w * w)) AS len FROM x GROUP BY id)
SELECT term, count(*) AS articles, round(sum(w / len), 4) AS weight FROM x JOIN l USING (id) GROUP BY term"""
)
def tfidf_top_terms(spark, sf_dir):
    """D7."""
    w = sj.tfidf_terms(fx.articles(spark, sf_dir), ["the", "of", "and"])
    return w.groupBy("term").agg(F.count("*").alias("articles"), F.round(F.sum("weight"), 4).alias("weight"))


# ---- clusters -----------------------------------------------------------------------------------------------------------------------


def by_label(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = fx.read(spark, sf_dir, "embeddings")
    return e.select(F.col("label").alias("cluster_id"), F.col("vec_id").alias("id")), fx.raw_vectors(spark, sf_dir)


_raw = "n AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings)"


@query(f"WITH {_raw} SELECT a.label AS cluster_id, round(avg(list_inner_product(a.v, b.v)), 6) AS cohesion FROM n a JOIN n b ON a.label = b.label AND a.id < b.id GROUP BY a.label")
def cohesion(spark, sf_dir):
    """A3, C26."""
    members, v = by_label(spark, sf_dir)
    return cl.cohesion(members, v).select("cluster_id", r6("cohesion").alias("cohesion"))


@query(f"WITH {_raw}, d AS (SELECT label, i, avg(v[i]) AS m FROM n, unnest(range(1, 65)) t(i) GROUP BY label, i), l AS (SELECT label, sqrt(sum(m * m)) AS len FROM d GROUP BY label) SELECT label AS cluster_id, (i - 1)::INT AS d, round(m / len, 6) AS x FROM d JOIN l USING (label)")
def centroids(spark, sf_dir):
    """A2."""
    members, v = by_label(spark, sf_dir)
    return cl.centroids(members, v).select("cluster_id", F.posexplode("centroid").alias("d", "x")).select("cluster_id", "d", r6("x").alias("x"))


#: Groups of a fixed number, which grow with the table.
GROUPS = 97
#: Articles of a group; the number of groups grows with the table.
TOGETHER = 10
_group = f"doc_id // {TOGETHER}"
GROUPED = f"m AS (SELECT *, {_group} AS g FROM fp)"


def group_of(c: str) -> F.Column:
    return F.floor(F.col(c) / TOGETHER)


def grouped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members, articles and vectors: articles in groups by number, those that have a vector with it."""
    a = cut(numbered(fingerprinted(spark, sf_dir)))
    return a.select(group_of("id").alias("cluster_id"), "id"), a, fx.vectors(spark, sf_dir)


@query(
    "WITH" + FP + f", m AS (SELECT *, doc_id % {GROUPS} AS g FROM fp)," + VEC + """, p AS (SELECT a.g, avg(list_inner_product(x.v, y.v)) AS c FROM m a JOIN m b ON a.g = b.g AND a.doc_id < b.doc_id JOIN vecs x ON x.id = a.doc_id JOIN vecs y ON y.id = b.doc_id GROUP BY a.g),
s AS (SELECT g, count(DISTINCT source) AS k FROM m GROUP BY g)
SELECT s.g AS cluster_id, round_even(greatest(0.3, least(0.98, 0.4 + 0.4 * greatest(0, least(1, coalesce(c, 1))) + 0.2 * least(k / 6.0, 1))), 3)::DOUBLE AS cluster_confidence FROM s LEFT JOIN p USING (g)"""
)
def cluster_confidence(spark, sf_dir):
    """A4: groups that grow with the table."""
    _, a, v = grouped(spark, sf_dir)
    return cl.cluster_confidence(a.select((F.col("id") % GROUPS).alias("cluster_id"), "id"), a, v).select("cluster_id", "cluster_confidence")


MERGED = """
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY published DESC, doc_id) AS ord FROM m),
x AS (SELECT g, ord, i, entities[i] AS e FROM o, unnest(range(1, len(entities) + 1)) t(i)),
xe AS (SELECT g, list(e ORDER BY ord, i)[1:16] AS entities FROM (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY g, lower(e) ORDER BY ord, i) = 1) GROUP BY g),
y AS (SELECT g, ord, i, actions[i] AS e FROM o, unnest(range(1, len(actions) + 1)) t(i)),
ya AS (SELECT g, list(e ORDER BY ord, i)[1:10] AS actions FROM (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY g, lower(e) ORDER BY ord, i) = 1) GROUP BY g),
z AS (SELECT g, min(bucket) AS bucket, max(bucket) AS hi, list_sort(list(DISTINCT source)) AS sources FROM o GROUP BY g),
mf AS (SELECT g, coalesce(entities, []) AS entities, coalesce(actions, []) AS actions, bucket, hi, sources FROM z LEFT JOIN xe USING (g) LEFT JOIN ya USING (g))"""


@query("WITH" + FP + "," + GROUPED + "," + MERGED + f" SELECT g AS cluster_id, entities, actions, sources, bucket AS start, hi AS stop, substr(md5(concat_ws('|', array_to_string({_low('entities[1:10]')}, ','), array_to_string({_low('actions[1:8]')}, ','), strftime(bucket, '%Y-%m-%d'), strftime(hi, '%Y-%m-%d'), array_to_string(sources, ','))), 1, 16) AS hash FROM mf")
def merge_fingerprints(spark, sf_dir):
    """A1."""
    members, a, _ = grouped(spark, sf_dir)
    f = cl.merge_fingerprints(cl.ordered(members, a, "event_fingerprint").select("cluster_id", "ord", F.col("event_fingerprint").alias("fp")), "cluster_id")
    e = "event_fingerprint"
    return f.select("cluster_id", f"{e}.entities", f"{e}.actions", f"{e}.sources", F.col(f"{e}.time_window.start").alias("start"), F.col(f"{e}.time_window.end").alias("stop"), f"{e}.hash")


@query("SELECT 97::BIGINT AS total, 97::BIGINT AS multi, max(n) AS max_size FROM (SELECT count(*) AS n FROM documents GROUP BY doc_id % 97)")
def cluster_stats(spark, sf_dir):
    """The articles in groups that grow with the table."""
    _, a, _ = grouped(spark, sf_dir)
    return cl.cluster_stats(a.select((F.col("id") % GROUPS).alias("cluster_id"), "id"))


def article_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every article as a topic of its own, named by its number; not all have a vector."""
    a = numbered(fingerprinted(spark, sf_dir)).join(fx.vectors(spark, sf_dir), "id", "left")
    return cut(a.select(F.col("id").alias("topic_id"), F.col("id").alias("cluster_id"), "published", F.col("v").alias("centroid"), "event_fingerprint"))


ONE = ", one AS (SELECT f.*, v.v FROM fp f LEFT JOIN vecs v ON v.id = f.doc_id)"
_dot = "coalesce(list_inner_product(a.v, b.v), 0)"
_pair = "one a JOIN one b ON a.doc_id < b.doc_id"


@query("WITH" + FP + "," + VEC + ONE + f", s AS (SELECT a.doc_id AS a, b.doc_id AS b, {_dot} AS sim, {similarity_sql('a', 'b')} AS fp FROM {_pair}) SELECT a, b, round(sim, 6) AS sim, round(fp, 6) AS fp FROM s WHERE sim >= 0.82 AND fp >= 0.58 OR sim >= 0.9 OR fp >= 0.76")
def stage_a_pairs(spark, sf_dir):
    """D9."""
    return cl.stage_a_pairs(article_topics(spark, sf_dir), mode="exact").select("a", "b", r6("sim").alias("sim"), r6("fp").alias("fp"))


@query("WITH" + FP + "," + VEC + ONE + f", s AS (SELECT a.doc_id AS a, b.doc_id AS b, 0.68 * greatest(0, least(1, {_dot})) + 0.32 * {similarity_sql('a', 'b')} AS score FROM {_pair}) SELECT a, b, round(score, 6) AS score FROM s WHERE score >= 0.62")
def topic_pairs(spark, sf_dir):
    """D11."""
    return tp.topic_pair_scores(article_topics(spark, sf_dir), mode="exact").select("a", "b", r6("score").alias("score"))


@query("WITH" + FP + "," + VEC + ONE + f""", s AS (SELECT b.article_key, a.doc_id AS topic_id, a.published AS tp, 0.62 * greatest(0, least(1, {_dot})) + 0.28 * {similarity_sql('a', 'b')} + 0.1 * {time_score_sql('a.bucket', 'b.bucket')} AS score
  FROM one a JOIN one b ON a.doc_id % 4 = 0 AND b.doc_id % 4 > 0)
SELECT article_key, topic_id, round(score, 6) AS score FROM s WHERE score >= 0.63 QUALIFY row_number() OVER (PARTITION BY article_key ORDER BY score DESC, tp DESC, topic_id) = 1""")
def assign_topics(spark, sf_dir):
    """A quarter of the articles are topics, the others look for one."""
    a = cut(numbered(fingerprinted(spark, sf_dir)).join(fx.vectors(spark, sf_dir), "id", "left"))
    topics = article_topics(spark, sf_dir).filter(F.col("topic_id") % 4 == 0)
    found = tp.assign_to_topics(a.filter(F.col("id") % 4 > 0).select("article_key", "v", "event_fingerprint"), topics)
    return found.select("article_key", "topic_id", r6("score").alias("score"))


def topic_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Topics of the groups of articles, their keys beside them; the topic's id is its group's number."""
    members, a, v = grouped(spark, sf_dir)
    topics = tp.topics_from_clusters(members, a).withColumn("topic_id", F.col("cluster_id").cast("string"))
    keys = members.join(a.select("id", "article_key"), "id").select(F.col("cluster_id").cast("string").alias("topic_id"), "article_key").distinct()
    return topics.drop("cluster_id").withColumn("id", F.col("topic_id")), keys


TOPICS = f"""
tg AS (SELECT *, {_group} AS g FROM keyed),
tf AS (SELECT * FROM tg QUALIFY row_number() OVER (PARTITION BY g ORDER BY published DESC, doc_id) = 1),
tc AS (SELECT g, count(*)::INT AS article_count, list_sort(list(DISTINCT source)) AS names FROM tg GROUP BY g),
topics AS (SELECT g::VARCHAR AS id, title, substr(snippet, 1, 300) AS summary, published, article_count, names FROM tf JOIN tc USING (g))"""


@query("WITH" + KEYED + "," + TOPICS + " SELECT id, title, summary, published, article_count, names FROM topics")
def topic_heads(spark, sf_dir):
    """A5."""
    topics, _ = topic_tables(spark, sf_dir)
    return topics.select("id", "title", "summary", "published", "article_count", tp.names_of(F.col("sources")).alias("names"))


# the groups' centroids: unit means of the unit vectors, a row for each dimension; and the head of each group
CENTRES = """
dims AS (SELECT g, i, avg(v[i]) AS x FROM {rows}, unnest(range(1, 65)) t(i) GROUP BY g, i),
centres AS (SELECT g, i, x / sqrt(sum(x * x) OVER (PARTITION BY g)) AS x FROM dims)"""
STATE_SQL = (
    "WITH" + FP + "," + VEC + "," + GROUPED + "," + MERGED
    + """, one AS (SELECT m.*, v.v FROM m LEFT JOIN vecs v ON v.id = m.doc_id), hd AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY g ORDER BY published DESC, doc_id) = 1),
ct AS (SELECT g, count(*)::INT AS n, list_sort(list(DISTINCT source)) AS names FROM m GROUP BY g),"""
)


def first_numbers(c: str = "centroid") -> F.Column:
    """The first two numbers of a vector and its length, as one text."""
    parts = [F.round(F.get(c, F.lit(i)) * 1e6).cast("long") for i in (0, 1)]
    return F.coalesce(F.concat_ws(",", *parts, F.size(c)), F.lit("")).alias(c)


_first_numbers = "coalesce((SELECT string_agg(round(x * 1e6)::BIGINT::VARCHAR, ',' ORDER BY i) FILTER (i <= 2) || ',' || count(*) FROM {t} c WHERE c.g = q.g), '') AS centroid"


@query(STATE_SQL + CENTRES.format(rows="(SELECT * FROM one WHERE v IS NOT NULL)") + f""" SELECT q.id AS topic_id, title, substr(snippet, 1, 300) AS summary, published, n AS article_count, names AS source_set,
  mf.entities AS entity_set, mf.actions, mf.bucket AS start, mf.hi AS stop, {_first_numbers.format(t='centres')}
FROM (SELECT g, doc_id::VARCHAR AS id, title, snippet, published FROM hd) q JOIN ct USING (g) JOIN mf USING (g)""")
def topic_states(spark, sf_dir):
    """The state of every group's topic, its centroid, fingerprint and sets."""
    state, _ = tp.topic_state(*grouped(spark, sf_dir), fx.run_ts())
    e = "event_fingerprint"
    return state.select(
        "topic_id", "title", "summary", "published", "article_count", "source_set", "entity_set", f"{e}.actions", F.col(f"{e}.time_window.start").alias("start"), F.col(f"{e}.time_window.end").alias("stop"), first_numbers()
    )


@query("WITH" + KEYED + "," + TOPICS + """, h AS (SELECT * FROM tg QUALIFY row_number() OVER (PARTITION BY g ORDER BY published DESC, doc_id) = 1)
SELECT h.doc_id::VARCHAR AS id, h.title, substr(snippet, 1, 300) AS summary, 0::INT AS n_points, 0::INT AS n_tags, 'brand-market' AS category, '品牌/市场' AS category_name, '' AS image, h.published, tc.article_count,
  (SELECT string_agg(source || ' ' || link || ' ' || title || ' ' || (SELECT min(lang) FROM documents d WHERE d.source = t.source), chr(10) ORDER BY published DESC, doc_id) FROM tg t WHERE t.g = h.g) AS sources,
  'article_count category category_name id image key_points published sources summary tags title' AS fields FROM h JOIN tc USING (g)""")
def topic_output(spark, sf_dir):
    """The state as it is shown: every field's value, the names of the fields that stay, and all sources in order."""
    shown = tp.topics_output(tp.topic_state(*grouped(spark, sf_dir), fx.run_ts())[0])
    links = F.array_join(F.transform("sources", lambda x: F.concat_ws(" ", x["name"], x["link"], x["title"], x["lang"])), "\n")
    return shown.select(
        "id", "title", "summary", F.size("key_points").alias("n_points"), F.size("tags").alias("n_tags"), "category", "category_name", "image", "published", "article_count", links.alias("sources"),
        F.lit(" ".join(sorted(shown.columns))).alias("fields"),
    )


REFRESHED = STATE_SQL + """
early AS (SELECT *, doc_id % 2 AS late FROM one), s0 AS (SELECT g, count(DISTINCT article_key) FILTER (late = 0)::INT AS c0, count(DISTINCT article_key)::INT AS c1, max(published) AS published, count(DISTINCT link)::INT AS n_sources,
  max(late) AS l, count(*) FILTER (late = 0)::DOUBLE AS w, list_sort(list(DISTINCT source)) AS source_set,
  min(bucket) AS start, CASE WHEN l = 1 THEN greatest(min(bucket) FILTER (late = 0), max(bucket) FILTER (late = 1)) ELSE max(bucket) END AS stop FROM early GROUP BY g HAVING count(*) FILTER (late = 0) > 0),
d0 AS (SELECT g, i, avg(v[i]) FILTER (late = 0) AS x, sum(v[i]) FILTER (late = 1) AS y, count(*) FILTER (late = 1) AS k FROM (SELECT * FROM early WHERE v IS NOT NULL), unnest(range(1, 65)) t(i) GROUP BY g, i),
d1 AS (SELECT g, i, x / sqrt(sum(x * x) OVER (PARTITION BY g)) AS x, y, k FROM d0),
d2 AS (SELECT g, i, CASE WHEN k = 0 THEN x WHEN x IS NULL THEN y / k ELSE (y + x * w) / (w + k) END AS x FROM d1 JOIN s0 USING (g)),
fresh AS (SELECT g, i, x / sqrt(sum(x * x) OVER (PARTITION BY g)) AS x FROM d2)"""


@query(REFRESHED + f""" SELECT q.g::VARCHAR AS topic_id, CASE WHEN l = 1 THEN c1 ELSE c0 END AS article_count, published, n_sources, source_set,
  round(CASE WHEN l = 1 THEN 0.7 * (0.7 * 0.6 + 0.3 * 0.82) + 0.3 * 0.7 ELSE 0.6 END, 6)::DOUBLE AS cluster_confidence, start, stop, {_first_numbers.format(t='fresh')}
FROM s0 q""")
def topic_refresh(spark, sf_dir):
    """Each group's odd articles join the topic of its even ones at a score of .7."""
    members, a, v = grouped(spark, sf_dir)
    late = F.col("id") % 2 == 1
    early = members.filter(~late)
    sure = early.select("cluster_id").distinct().withColumn("cluster_confidence", F.lit(0.6))
    state, keys = tp.topic_state(early, a, v, fx.run_ts(), sure)
    name = state.select(F.col("topic_id").alias("t"), F.floor(F.col("topic_id").cast("long") / TOGETHER).cast("string").alias("name"))
    renamed = lambda df: df.join(name, F.col("topic_id") == F.col("t")).withColumn("topic_id", F.col("name")).drop("t", "name")
    state, keys = cut(renamed(state)), cut(renamed(keys))
    assigned = a.filter(late).select("article_key", group_of("id").cast("string").alias("topic_id"), F.lit(0.7).alias("score"))
    out, _ = tp.refresh_topics(state, keys, assigned, a.join(v, "id", "left"), fx.run_ts())
    window = "event_fingerprint.time_window"
    return out.select(
        "topic_id", "article_count", "published", F.size("sources").alias("n_sources"), "source_set", r6("cluster_confidence").alias("cluster_confidence"), F.col(f"{window}.start").alias("start"), F.col(f"{window}.end").alias("stop"), first_numbers()
    )


MERGED_TOPICS = STATE_SQL + CENTRES.format(rows="(SELECT * FROM one WHERE v IS NOT NULL)") + """,
sets AS (SELECT g // 3 AS h, CASE WHEN count(*) = 1 THEN any_value(entities) ELSE list_sort(list_distinct(flatten(list(entities))))[1:24] END AS entity_set, min(bucket) AS start,
  CASE WHEN count(*) = 1 THEN max(hi) ELSE max(bucket) END AS stop FROM mf GROUP BY h),
n AS (SELECT g // 3 AS h, count(*)::INT AS article_count, count(DISTINCT article_key)::INT AS n_keys, max(published) AS published, list_sort(list(DISTINCT source)) AS source_set, count(DISTINCT link)::INT AS n_sources FROM m GROUP BY h),
base AS (SELECT doc_id // 30 AS h, doc_id::VARCHAR AS topic_id, title FROM m QUALIFY row_number() OVER (PARTITION BY h ORDER BY published DESC, topic_id) = 1),
mean AS (SELECT g // 3 AS h, i, sum(x * n) / sum(n) AS x FROM centres JOIN ct USING (g) GROUP BY h, i),
joint AS (SELECT h AS g, i, x / sqrt(sum(x * x) OVER (PARTITION BY h)) AS x FROM mean)"""


@query(MERGED_TOPICS + f""" SELECT topic_id, title, article_count, n_keys, published, source_set, n_sources, entity_set, start, stop, {_first_numbers.format(t='joint')}
FROM (SELECT h AS g, * FROM n) q JOIN sets USING (h) JOIN base USING (h)""")
def topic_merge(spark, sf_dir):
    """Every three topics in a row become one; its base is the newest."""
    state, keys = tp.topic_state(*grouped(spark, sf_dir), fx.run_ts())
    state, keys = cut(state), cut(keys)
    g = state.select("topic_id", F.floor(F.col("id").cast("long") / (3 * TOGETHER)).alias("g"))
    first = g.groupBy("g").agg(F.min("topic_id").alias("dst"))
    edges = g.join(first, "g").select(F.col("topic_id").alias("src"), "dst")
    merged, held = tp.merge_components(state, keys, edges, fx.run_ts())
    merged = merged.join(held.groupBy("topic_id").agg(F.count_distinct("article_key").cast("int").alias("n_keys")), "topic_id", "left")
    window = "event_fingerprint.time_window"
    return merged.select(
        "topic_id", "title", "article_count", "n_keys", "published", "source_set", F.size("sources").alias("n_sources"), "entity_set", F.col(f"{window}.start").alias("start"), F.col(f"{window}.end").alias("stop"), first_numbers()
    )


@query("WITH" + KEYED + "," + TOPICS + " SELECT id AS topic_id, row_number() OVER (ORDER BY published DESC, id) > 50 AS evicted FROM topics")
def topic_cap(spark, sf_dir):
    """W2 with a cap of 50."""
    kept, evicted = tp.cap_topics(topic_tables(spark, sf_dir)[0], 50)
    return kept.select("topic_id", F.lit(False).alias("evicted")).unionByName(evicted.select("topic_id", F.lit(True).alias("evicted")))


@query("WITH" + KEYED + "," + TOPICS + " SELECT id, article_count, published FROM topics ORDER BY article_count DESC, published, id LIMIT 20")
def cluster_cap(spark, sf_dir):
    """The largest twenty, older ones first."""
    members, a, _ = grouped(spark, sf_dir)
    best = tp.cap_clusters(tp.cluster_sizes(members, a).withColumn("cluster_id", F.col("cluster_id").cast("string")), 20, "size_oldest")
    return best.select(F.col("cluster_id").alias("id"), F.col("size").alias("article_count"), F.col("newest").alias("published"))


# ---- state ----------------------------------------------------------------------------------------------------------------------------

EV = "SELECT md5(event_id::VARCHAR) AS article_key, ts, user_id, event_type FROM events"


def event_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.read(spark, sf_dir, "events").select(F.md5(F.col("event_id").cast("string")).alias("article_key"), "event_id", "ts", "user_id", "event_type")


def event_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors, blocked for ten days each."""
    return event_keys(spark, sf_dir).filter("event_type = 'error'").select("article_key", F.col("ts").alias("evicted_at"), F.expr("ts + INTERVAL 10 DAYS").alias("expired_at"))


_tomb = f"tomb AS (SELECT article_key, ts AS evicted_at, ts + INTERVAL 10 DAY AS expired_at FROM ({EV}) WHERE event_type = 'error')"


@query(f"WITH {_tomb} SELECT article_key, expired_at FROM tomb WHERE expired_at > TIMESTAMP '{fx.RUN_TS}'")
def tombstone_prune(spark, sf_dir):
    """F3."""
    return st.prune_tombstones(event_tombstones(spark, sf_dir), fx.run_ts()).select("article_key", "expired_at")


@query(f"WITH {_tomb}, k AS (SELECT DISTINCT article_key FROM ({EV}) WHERE user_id % 7 = 0) SELECT coalesce(t.article_key, k.article_key) AS article_key, CASE WHEN k.article_key IS NULL THEN t.expired_at ELSE TIMESTAMP '{fx.RUN_TS}' + INTERVAL 30 DAY END AS expired_at FROM tomb t FULL JOIN k USING (article_key)")
def tombstone_upsert(spark, sf_dir):
    """X3."""
    fresh = event_keys(spark, sf_dir).filter("user_id % 7 = 0")
    return st.upsert_tombstones(event_tombstones(spark, sf_dir), fresh, fx.run_ts()).select("article_key", "expired_at")


@query(f"WITH {_tomb}, e AS ({EV}), d AS (SELECT *, CAST(ts AS DATE) AS day FROM e) SELECT 'new' AS what, count(*) AS n FROM d WHERE day >= '2024-01-05' AND event_type <> 'error' AND user_id % 5 > 0 UNION ALL SELECT 'blocked', count(*) FROM d WHERE day >= '2024-01-03' AND event_type = 'error' UNION ALL SELECT 'active', count(*) FROM d WHERE user_id % 5 = 0 UNION ALL SELECT 'known', count(*) FROM d WHERE user_id % 5 = 0 OR event_type = 'error'")
def new_articles(spark, sf_dir):
    """Events as articles of the days from the 3rd on, against the snapshot of the days before the 5th."""
    e = event_keys(spark, sf_dir)
    tombs, seen, snapshot = event_tombstones(spark, sf_dir), e.filter("user_id % 5 = 0"), e.filter("ts < '2024-01-05'")
    new, blocked = st.select_new(e.filter("ts >= '2024-01-03'"), tombs, seen, snapshot)
    count = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    active = st.active_keys(seen.select(F.lit("t").alias("topic_id"), "article_key"))
    return count(new, "new").unionByName(count(blocked, "blocked")).unionByName(count(active, "active")).unionByName(count(st.union_keys(seen, tombs), "known"))


@query("WITH" + KEYED + " SELECT article_key, source, link AS normalized_url, title_hash, published FROM keyed")
def snapshot(spark, sf_dir):
    """A11."""
    return st.build_snapshot(fx.articles(spark, sf_dir))


@query("WITH" + KEYED + "," + TOPICS + " SELECT round_even(greatest(0, least(1, (sum(article_count) - count(*)) / sum(article_count)::DOUBLE)), 4)::DOUBLE AS merge_rate, round_even(avg(len(names)), 4)::DOUBLE AS avg_sources_per_topic, 1.0::DOUBLE AS high_confidence_topic_ratio, 'full' AS rebuild_mode FROM topics")
def quality_metrics(spark, sf_dir):
    """A9."""
    topics, _ = topic_tables(spark, sf_dir)
    none = F.array().cast("array<string>")
    return st.quality_metrics(topics.withColumns({"source_set": none, "cluster_confidence": F.lit(0.9)}), "full")


@query("WITH" + KEYED + "," + TOPICS + " SELECT (SELECT count(*) FROM topics) AS total_topics, (SELECT sum(article_count) FROM topics)::BIGINT AS total_articles, (SELECT count(DISTINCT source) FROM keyed) AS sources_count, (SELECT list_sort(list(DISTINCT source)) FROM keyed) AS sources")
def feed_meta(spark, sf_dir):
    """A10, A13."""
    topics, _ = topic_tables(spark, sf_dir)
    return st.feed_meta(topics, fx.articles(spark, sf_dir))


@query(NOTHING)
def state_violations(spark, sf_dir):
    """T4: topics without any fingerprint, confidence or sets get them, within their bounds, and normalising twice changes
    nothing."""
    members, a, v = grouped(spark, sf_dir)
    state, _ = tp.topic_state(members, a, v, fx.run_ts())
    kind = dict(state.dtypes)
    bare = state.withColumns({c: F.lit(None).cast(kind[c]) for c in ("event_fingerprint", "source_set", "entity_set", "cluster_confidence", "last_merged_at")})
    once = cut(st.normalize_state(bare, fx.run_ts()))
    twice = st.normalize_state(once, fx.run_ts()).select("topic_id", F.xxhash64("event_fingerprint", "source_set", "entity_set", "cluster_confidence").alias("h"))
    same = once.select("topic_id", F.xxhash64("event_fingerprint", "source_set", "entity_set", "cluster_confidence").alias("g")).join(twice, "topic_id").filter("g <> h").select("topic_id")
    bad = once.filter("event_fingerprint.hash IS NULL OR cluster_confidence NOT BETWEEN 0.3 AND 0.99 OR size(entity_set) > 24 OR last_merged_at IS NULL").select("topic_id")
    lost = state.select("topic_id").join(once, "topic_id", "left_anti")
    return same.unionByName(bad).unionByName(lost).agg(F.count("*").alias("violations"))


# ---- verdicts ----------------------------------------------------------------------------------------------------------------------------


def article_verdicts(spark: SparkSession, sf_dir: str, a: DataFrame) -> DataFrame:
    """Labels as verdicts: good quality is kept, toxic is sensitive."""
    told = fx.read(spark, sf_dir, "labels").join(a.select("doc_id", "article_key"), "doc_id")
    return told.select(
        "article_key", (F.col("quality") == 1).alias("keep"), (F.col("toxic") == 1).alias("is_sensitive"), F.concat(F.col("doc_id") % 100, F.when(F.col("doc_id") % 3 == 0, "x").otherwise("")).alias("relevance_score"),
        F.lit("r").alias("reason"), F.lit(" s ").alias("summary"), F.when(F.col("doc_id") % 2 == 0, "街拍/造型").otherwise("?").alias("category"), F.array(F.lit(" a "), F.lit(""), F.lit("b")).alias("tags"), F.lit("").alias("content_type"),
    )


@query("WITH" + KEYED + ", l AS (SELECT doc_id, quality, toxic FROM labels) SELECT k.doc_id, coalesce(quality = 1 AND toxic <> 1, true) AS is_relevant, coalesce(toxic = 1, false) AS is_sensitive, CASE WHEN l.doc_id IS NOT NULL AND k.doc_id % 3 > 0 THEN (k.doc_id % 100)::INT END AS relevance_score, CASE WHEN l.doc_id IS NOT NULL AND k.doc_id % 2 = 0 THEN 'street-style' ELSE 'brand-market' END AS category_id, CASE WHEN l.doc_id IS NULL THEN '' ELSE 'a,b' END AS tags, coalesce(quality = 1 AND toxic <> 1, true) AS kept FROM keyed k LEFT JOIN l USING (doc_id)")
def verdict_apply(spark, sf_dir):
    """U2, J3, F1."""
    a = cut(fx.articles(spark, sf_dir))
    done = cut(vd.apply_article_verdicts(a, article_verdicts(spark, sf_dir, a)))
    kept = ig.keep_relevant(done).select("doc_id", F.lit(True).alias("kept"))
    return done.join(kept, "doc_id", "left").select("doc_id", "is_relevant", "is_sensitive", "relevance_score", "category_id", F.array_join("article_tags", ",").alias("tags"), F.coalesce("kept", F.lit(False)).alias("kept"))


@query("WITH" + KEYED + " SELECT article_key, md5('title: ' || title || chr(10) || 'source: ' || source || ' (' || l || ', rss)' || chr(10) || 'category: 品牌/市场' || chr(10) || 'published: ' || strftime(published, '%Y-%m-%d %H:%M:%S') || chr(10) || 'content: ' || substr(trim(text), 1, 2200)) AS prompt FROM keyed JOIN (SELECT source, min(lang) AS l FROM documents GROUP BY source) USING (source) WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def review_queue(spark, sf_dir):
    """U1, C21."""
    a = cut(fx.articles(spark, sf_dir))
    return vd.article_queue(a, article_verdicts(spark, sf_dir, a)).select("article_key", F.md5("prompt").alias("prompt"))


@query("WITH" + KEYED + "," + TOPICS + " SELECT id AS cluster_id, article_count AS size FROM topics WHERE article_count > 1 AND (id::INT % 2 = 0 OR article_count >= 6) ORDER BY published DESC, id LIMIT 140")
def group_review_queue(spark, sf_dir):
    """Every other group is loose."""
    members, a, _ = grouped(spark, sf_dir)
    sizes = tp.cluster_sizes(members, a).withColumn("cohesion", F.when(F.col("cluster_id") % 2 == 0, 0.5).otherwise(0.95)).withColumn("cluster_id", F.col("cluster_id").cast("string"))
    return vd.group_queue(sizes).select("cluster_id", "size")


@query(f"WITH m AS (SELECT doc_id AS id, {_group} AS g, (row_number() OVER (PARTITION BY {_group} ORDER BY doc_id) - 1)::INT AS i FROM documents), n AS (SELECT *, CASE WHEN g % 2 = 1 THEN 0 WHEN i % 3 = 2 THEN -1 - i ELSE i % 3 END AS k FROM m) SELECT id, CASE WHEN g % 2 = 1 THEN g ELSE min(id) OVER (PARTITION BY g, k) END AS cluster_id, CASE WHEN g % 2 = 1 THEN NULL WHEN k < 0 THEN 0.5 WHEN k = 0 THEN 0.98 ELSE 0.6 END::DOUBLE AS confidence FROM n")
def group_verdicts(spark, sf_dir):
    """U4, U8: reviewed groups fall into two parts and the members that no part lists."""
    docs = fx.read(spark, sf_dir, "documents")
    w = F.row_number().over(cl_window())
    members = docs.select(group_of("doc_id").alias("cluster_id"), F.col("doc_id").alias("id")).withColumn("local_index", (w - 1).cast("int"))
    part = F.col("local_index") % 3
    told = members.filter((F.col("cluster_id") % 2 == 0) & (part < 2)).select(F.col("cluster_id").alias("group_id"), part.alias("group_no"), "local_index", F.when(part == 0, 1.5).alias("confidence"))
    return vd.apply_group_verdicts(members, told.unionByName(told.withColumn("group_no", F.lit(9)))).select("id", "cluster_id", "confidence")


def cl_window():
    from pyspark.sql import Window

    return Window.partitionBy("cluster_id").orderBy("id")


@query("WITH g AS (SELECT doc_id % 50 AS id, doc_id % 200 AS group_id, (doc_id % 200)::DOUBLE / 200 AS confidence FROM documents), s AS (SELECT group_id, max(confidence) AS confidence, list_sort(list(DISTINCT id)) AS m FROM g GROUP BY group_id), t AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY confidence DESC, group_id) AS n FROM s) SELECT group_id, confidence, len(m)::INT AS size FROM t WHERE n = 1")
def group_dedup(spark, sf_dir):
    """X4."""
    d = fx.read(spark, sf_dir, "documents")
    return tp.dedup_groups(d.select((F.col("doc_id") % 200).alias("group_id"), (F.col("doc_id") % 50).alias("id"), ((F.col("doc_id") % 200) / 200).alias("confidence")))


@query("WITH RECURSIVE" + FP + "," + VEC + ONE + f""", s AS (SELECT a.doc_id AS a, b.doc_id AS b, 0.68 * greatest(0, least(1, {_dot})) + 0.32 * {similarity_sql('a', 'b')} AS score FROM {_pair}),
t AS MATERIALIZED (SELECT * FROM s WHERE score >= 0.62 ORDER BY score DESC, a, b LIMIT 220),
e AS MATERIALIZED (SELECT a AS x, b AS y FROM t WHERE score >= 0.66 UNION SELECT b, a FROM t WHERE score >= 0.66),
r AS (SELECT x AS v, x AS u FROM e UNION SELECT r.v, e.y FROM r JOIN e ON r.u = e.x),
c AS (SELECT v, min(u) AS m FROM r GROUP BY v)
SELECT a, b, round(score, 6) AS score FROM t LEFT JOIN c p ON p.v = a LEFT JOIN c q ON q.v = b WHERE score < 0.66 AND coalesce(p.m, a) <> coalesce(q.m, b) ORDER BY score DESC, a, b LIMIT 60""")
def pair_review_queue(spark, sf_dir):
    """U5, W4."""
    pairs = cut(tp.topic_pair_scores(article_topics(spark, sf_dir), mode="exact"))
    return tp.pair_queue(tp.top_pairs(pairs)).select("a", "b", r6("score").alias("score"))


@query("WITH" + KEYED + "," + TOPICS + " SELECT id, CASE WHEN id::INT % 3 = 0 THEN 'T' ELSE title END AS title, CASE WHEN id::INT % 6 = 0 THEN 'S ' || id ELSE summary END AS summary, CASE WHEN id::INT % 3 = 0 THEN ['p', id] ELSE []::VARCHAR[] END AS key_points, CASE WHEN id::INT % 6 = 3 THEN ['tag'] ELSE []::VARCHAR[] END AS tags, CASE WHEN id::INT % 3 = 0 AND id::INT % 2 = 0 THEN 'trend-summary' ELSE 'brand-market' END AS category, CASE WHEN id::INT % 3 = 0 AND id::INT % 2 = 0 THEN '趋势总结' ELSE '品牌/市场' END AS category_name FROM topics WHERE id::INT % 9 <> 0")
def editorial_apply(spark, sf_dir):
    """U6."""
    topics, _ = topic_tables(spark, sf_dir)
    n = F.col("topic_id").cast("int")
    none = F.array().cast("array<string>")
    points, tags, summary = F.array(F.lit("p"), "topic_id"), F.when(n % 2 == 1, F.array(F.lit("tag"))).otherwise(none), F.when(n % 2 == 0, F.concat(F.lit("S "), "topic_id")).otherwise("")
    told = topics.filter(n % 3 == 0).select("topic_id", F.lit("T").alias("title"), summary.alias("summary"), points.alias("key_points"), tags.alias("tags"), F.when(n % 2 == 0, "趋势总结").alias("category"), (n % 9 == 0).alias("is_sensitive"))
    return vd.apply_editorial(topics, told).select("id", "title", "summary", "key_points", "tags", "category", "category_name")


# ---- the feed -----------------------------------------------------------------------------------------------------------------------------


def feed_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics, every other one of the street, two in five with an image."""
    topics, _ = topic_tables(spark, sf_dir)
    n = F.col("id").cast("int")
    return topics.withColumns({"category": F.when(n % 2 == 0, "street-style").otherwise("brand-market"), "image": F.when(n % 5 < 2, F.concat(F.lit("i"), "id")).otherwise("")})


FEED = TOPICS + ", feed AS (SELECT *, CASE WHEN id::INT % 2 = 0 THEN 'street-style' ELSE 'brand-market' END AS category, CASE WHEN id::INT % 5 < 2 THEN 'i' || id ELSE '' END AS image FROM topics)"
_first = "(SELECT id FROM feed ORDER BY CASE WHEN image <> '' AND article_count > 1 THEN 0 WHEN image <> '' THEN 1 ELSE 2 END, published DESC, id LIMIT 1)"


@query("WITH" + KEYED + "," + FEED + " SELECT id, published FROM feed WHERE category = 'street-style' AND list_has_any(names, ['src1', 'src2', 'src3'])")
def feed_filter(spark, sf_dir):
    """F4, F5."""
    return fd.feed_view(feed_topics(spark, sf_dir), "street-style", ["src1", "src2", "src3"]).select("id", "published")


@query("WITH" + KEYED + "," + FEED + " SELECT 'newest' AS mode, id, row_number() OVER (ORDER BY published DESC, id)::INT AS n FROM feed UNION ALL SELECT 'oldest', id, row_number() OVER (ORDER BY published, id)::INT FROM feed UNION ALL SELECT 'most-sources', id, row_number() OVER (ORDER BY article_count DESC, published DESC, id)::INT FROM feed")
def feed_sort(spark, sf_dir):
    """The place of every topic in each mode."""
    from pyspark.sql import Window

    topics = cut(feed_topics(spark, sf_dir))
    out = None
    for mode in ("newest", "oldest", "most-sources"):
        one = topics.select(F.lit(mode).alias("mode"), "id", F.row_number().over(Window.orderBy(*fd.sort_keys(mode))).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("WITH" + KEYED + "," + FEED + f" SELECT id, id = {_first} AS chosen FROM feed")
def featured(spark, sf_dir):
    """W7, F6."""
    topics = cut(feed_topics(spark, sf_dir))
    best = fd.featured(topics)
    return best.select("id", F.lit(True).alias("chosen")).unionByName(fd.grid(topics, best).select("id", F.lit(False).alias("chosen")))


@query("WITH" + KEYED + f", g AS (SELECT {_group} AS g, source, min(row) AS p FROM (SELECT *, row_number() OVER (ORDER BY published DESC, doc_id) AS row FROM keyed) GROUP BY ALL), n AS (SELECT g::VARCHAR AS id, list(source ORDER BY p) AS names FROM g GROUP BY g) SELECT id, names, names[1:3] AS shown FROM n")
def source_names(spark, sf_dir):
    """A14, W9."""
    return fd.source_names(topic_tables(spark, sf_dir)[0], 3)


# ---- runs ------------------------------------------------------------------------------------------------------------------------------------


def run_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All articles, under their number as text, and the vectors that there are."""
    v = fx.vectors(spark, sf_dir).withColumn("id", F.col("id").cast("string"))
    a = fx.articles(spark, sf_dir).withColumn("id", F.col("doc_id").cast("string"))
    return cut(a), cut(v)


@query(NOTHING)
def full_run_violations(spark, sf_dir):
    """After a full run without a cap of topics every key belongs to one topic, counts fit, no active key is blocked, and
    all are known."""
    from loomwire.plans.runs import run_full
    from loomwire.sources.state import empty_state

    a, v = run_inputs(spark, sf_dir)
    state, _ = run_full(a, v, empty_state(spark), fx.run_ts(), replace(DEFAULT, max_topics=1 << 30))
    topics, keys = cut(state.topics_state), cut(state.topic_articles)
    twice = keys.groupBy("article_key").agg(F.count("*").alias("n")).filter("n > 1").select("article_key")
    blocked = state.tombstones.join(keys, "article_key", "left_semi").select("article_key")
    unknown = keys.join(state.snapshot, "article_key", "left_anti").select("article_key")
    held = keys.select("article_key").unionByName(state.tombstones.select("article_key"))
    lost = a.select("article_key").distinct().join(held, "article_key", "left_anti")
    counts = keys.groupBy("topic_id").agg(F.count("*").alias("n")).join(topics, "topic_id", "full_outer").filter("n IS NULL OR article_count IS NULL OR n > article_count").select(F.col("topic_id").alias("article_key"))
    return twice.unionByName(blocked).unionByName(unknown).unionByName(lost).unionByName(counts).agg(F.count("*").alias("violations"))


@query(NOTHING)
def incremental_run_violations(spark, sf_dir):
    """Half of the articles fully, then all incrementally: old articles are not taken again and every new one is in a topic."""
    from loomwire.plans.runs import run_full, run_incremental
    from loomwire.schemas import STATE
    from loomwire.sources.state import State, empty_state

    a, v = run_inputs(spark, sf_dir)
    first = a.filter(F.col("doc_id") % 2 == 0)
    state, _ = run_full(first, v.join(first.select("id"), "id", "left_semi"), empty_state(spark), fx.run_ts())
    state = State(**{name: cut(getattr(state, name)) for name in STATE})
    after, stats = run_incremental(a, v, state, fx.run_ts())
    held = cut(after.topic_articles.unionByName(after.tombstones.select(F.lit("").alias("topic_id"), "article_key")))
    lost = a.select("article_key").distinct().join(held, "article_key", "left_anti")
    twice = after.topic_articles.groupBy("article_key").agg(F.count("*").alias("n")).filter("n > 1").select("article_key")
    again = stats.filter(F.col("new_articles") != a.filter(F.col("doc_id") % 2 == 1).join(first.select("article_key"), "article_key", "left_anti").count()).select(F.lit("again").alias("article_key"))
    return lost.unionByName(twice).unionByName(again).agg(F.count("*").alias("violations"))


@query(f"SELECT {bucket_sql('ts')} AS bucket, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_parity(spark, sf_dir):
    """The six-hour counts of a stream, micro-batch by micro-batch and summed at the end; equal to the batch. Windows with a
    watermark (T8) are tested in tests/test_streaming.py."""
    from loomwire.session import new_folder
    from loomwire.streaming.jobs import stream_articles

    src, out, mark = new_folder(spark, "stream-in"), new_folder(spark, "stream-out"), new_folder(spark, "stream-mark")
    e = fx.read(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    e.repartition(4, "event_id").write.parquet(src)
    bucket = tm.time_bucket(F.col("ts"), fx.run_ts())

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy(bucket.alias("bucket"), "event_type").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    stream = stream_articles(spark, src, e.schema, 1).writeStream.foreachBatch(keep).option("checkpointLocation", mark).trigger(availableNow=True).start()
    stream.awaitTermination()
    return spark.read.parquet(out).groupBy("bucket", "event_type").agg(F.sum("n").alias("n"))
