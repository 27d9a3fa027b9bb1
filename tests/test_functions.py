"""Column functions on literal rows that the test tables lack."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loomwire.functions import text as tx
from loomwire.functions import times as tm
from loomwire.functions import urls as ur
from loomwire.functions import vectors as vx


def one(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[1] for r in df.select("i", f(F.col("x"))).orderBy("i").collect()]


def test_normalize_url(spark):
    cases = {
        "HTTP://User@Example.COM:80/a//b/?utm_source=x&q=1&REF=2&empty=#frag": "http://user@example.com:80/a/b?q=1",
        "https://e.org": "https://e.org/", "https://e.org/a/b;params?x=a b": "https://e.org/a/b?x=a+b", "/only/path": "", "mailto:x@y.z": "", "": "", None: "",
        "https://e.org/p/?fbclid=1&mc_cid=2&b=2&a=1": "https://e.org/p?b=2&a=1",
    }
    assert one(spark, list(cases), ur.normalize_url) == list(cases.values())


def test_resolve_and_hosts(spark):
    base = F.lit("https://e.org/x/y.html?q=1")
    hrefs = {"a": "https://e.org/x/a", "/b": "https://e.org/b", "//c.org/d": "https://c.org/d", "?p=2": "https://e.org/x/y.html?p=2", "javascript:void(0)": "", "#top": "", "http://z/": "http://z/"}
    assert one(spark, list(hrefs), lambda c: ur.resolve(c, base)) == list(hrefs.values())
    allowed = F.array(F.lit("e.org"))
    assert one(spark, ["e.org", "a.e.org", "ae.org", ""], lambda c: ur.host_allowed(c, allowed)) == [True, True, False, False]


def test_titles(spark):
    assert one(spark, ["Héllo,  World!", "东京：春夏 系列", None, "a_b"], tx.normalize_title) == ["héllo world", "东京 春夏 系列", "", "a_b"]
    assert one(spark, ["a - b", None], tx.normalize_title_for_hash) == ["a  b", ""]
    assert one(spark, ["Ab c!", "x", "", None], tx.title_bigrams) == [["ab", "b ", " c"], [], [], []]
    assert one(spark, ["Vogue Runway!", "***", None], tx.slugify) == ["vogue-runway", "source", "source"]
    assert one(spark, ["", None, "..."], tx.content_digest) == ["", "", ""]
    assert one(spark, [None, ""], tx.article_id) == [None, None]


def test_entities_and_actions(spark):
    text = "The Gucci Group and GUCCI Group, Louis Vuitton launch 春夏系列 in NYC. This Week"
    assert one(spark, [text, None], tx.extract_entities) == [["The Gucci Group", "GUCCI Group", "Louis Vuitton", "NYC", "This Week", "GUCCI", "春夏系列"], []]
    assert one(spark, ["They SHOWER and launch 系列", ""], tx.extract_actions) == [["launch", "show", "系列"], []]


def test_summary_and_json(spark):
    assert one(spark, ["One. Two two! Three", "x" * 30, None, "  "], lambda c: tx.extractive_summary(c, 14)) == ["One. Two two!", "x" * 14, "", ""]
    replies = ['a ```json\n{"b": 1, "a": [2]}\n``` z', "t {bad} [1,2]", "none", 'x {"k":{"z":1}} y']
    assert one(spark, replies, tx.extract_json) == ['{"a":[2],"b":1}', "[1,2]", None, '{"k":{"z":1}}']


def test_times(spark):
    raw = ["2024-01-02T03:04:05Z", "2024-01-02 03:04:05+08:00", "2024/01/02", "2024-01-02T03:04:05", "soon", "", None]
    utc = lambda *a: dt.datetime(*a)
    got = one(spark, raw, lambda c: F.date_format(tm.parse_time(c), "yyyy-MM-dd HH:mm:ss"))
    assert got == ["2024-01-02 03:04:05", "2024-01-01 19:04:05", "2024-01-02 00:00:00", "2024-01-02 03:04:05", None, None, None]
    assert one(spark, raw, tm.has_offset) == [True, True, False, False, False, False, False]
    base = F.lit("2024-01-01").cast("timestamp")
    days = [utc(2024, 1, 4), utc(2024, 1, 4, 0, 0, 1), None]
    near = lambda c: tm.within_days(c, F.lit(False), base, F.lit(False), 3)
    assert one(spark, days, near, "timestamp") == [True, False, False]
    assert one(spark, days[:1], lambda c: tm.within_days(c, F.lit(True), base, F.lit(False), 3), "timestamp") == [False]
    assert one(spark, [utc(2024, 1, 1, 13, 5)], lambda c: tm.display_time(c, "full"), "timestamp") == ["2024年1月1日 21:05"]


def test_vectors(spark):
    assert one(spark, [[3.0, 4.0], [0.0, 0.0], None], vx.vec_normalize, "array<float>") == [[0.6, 0.8], [0.0, 0.0], None]
    assert one(spark, [[1.0, 2.0], [1.0]], lambda c: vx.vec_dot(c, F.array(F.lit(3.0), F.lit(4.0))), "array<float>") == [11.0, None]
    assert one(spark, [[1.0, 1.0]], lambda c: vx.vec_weighted_mean(c, F.lit(1), F.array(F.lit(3.0), F.lit(5.0)), F.lit(3)), "array<double>") == [[2.5, 4.0]]


@pytest.mark.parametrize(("name", "ident"), [("趋势总结", "trend-summary"), ("娱乐文化", "brand-market"), (None, "brand-market")])
def test_categories(spark, name, ident):
    assert one(spark, [name], tx.category_id) == [ident]


def test_bucket_score_knows_parts_of_a_second(spark):
    noon = F.lit("2024-01-15 00:00:00").cast("timestamp")
    times = ["2024-01-15 12:00:00", "2024-01-15 12:00:00.000001", "2024-01-13 11:59:59.999999", "2024-01-12 00:00:00", "2024-01-18 00:00:00.5", None]
    assert one(spark, times, lambda x: tm.bucket_score(x.cast("timestamp"), noon)) == [1.0, 0.75, 0.45, 0.45, 0.0, 0.0]
