"""Operators 1 to 4."""

import zlib
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomwire.llm import licenses, quality, shards, tool_calls

COMMON = Path("/usr/share/common-licenses")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank string, shard string"


def docs(spark, texts, source="s", start=0):
    rows = [(start + i, t, "en", source, None if t is None else len(t), "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def test_licenses(spark):
    mit = next(t for i, t in licenses.KNOWN if i == "MIT" and len(t) > 200)
    texts = [
        mit, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(".", " !"), mit.replace("sublicense", "sub-license").replace("COPYRIGHT HOLDERS", "copyright owners"),
        "Words.\nReleased under the MIT Licence!\nLicensed under CC BY-NC 4.0.", None, "", "...", "Copyright 2001 by nobody", mit + " and more",
    ]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    assert [got[i]["license_id"] for i in range(3)] == ["MIT"] * 3
    assert got[3]["license_id"] is None and got[3]["notices"] == ["CC-BY-NC-4.0", "MIT"]
    assert all(got[i]["digest"] is None for i in (4, 5, 6, 7)) and got[8]["license_id"] is None and got[8]["digest"]
    bsd = next(t for i, t in licenses.KNOWN if i == "BSD-2-Clause")
    ways = [bsd, bsd.replace("1. ", "(1) ").replace("2. ", "* "), bsd.replace("1. ", "").replace("2. ", "").replace(", ", ",\n"), "\n".join(bsd.split(" ")), bsd * 40]
    same = [r["license_id"] for r in licenses.scan_licenses(docs(spark, ways)).orderBy("doc_id").collect()]
    assert same == ["BSD-2-Clause"] * 4 + [None]  # a text forty times as long is another
    twice = docs(spark, ["same"]).unionByName(docs(spark, ["same"]))
    assert licenses.scan_licenses(twice).count() == 2 and licenses.scan_licenses(twice.limit(0)).count() == 0


@pytest.mark.skipif(not COMMON.is_dir(), reason="no licence texts on this machine")
@pytest.mark.parametrize("name, license_id", [("Apache-2.0", "Apache-2.0"), ("GPL-2", "GPL-2.0-only"), ("LGPL-3", "LGPL-3.0-only"), ("MPL-2.0", "MPL-2.0")])
def test_whole_licenses(spark, name, license_id):
    text = (COMMON / name).read_text()
    texts = [text, " ".join(text.lower().split(" ")) + "\n\n", "Copyright (c) 2024 A. Nobody\n" + text, text.replace(" license ", " licence ")]
    assert {r["license_id"] for r in licenses.scan_licenses(docs(spark, texts)).collect()} == {license_id}


STYLES = ["# ", "// ", " * ", ";; "]


def laid_out(text):
    """A text wrapped at three widths, on one line, and under four marks of comments."""
    import textwrap

    paragraphs = [" ".join(p.split()) for p in text.split("\n\n")]
    ways = ["\n\n".join(textwrap.fill(p, w, break_long_words=False, break_on_hyphens=False) for p in paragraphs) for w in (40, 60, 100)]
    return [*ways, " ".join(text.split()), *("\n".join((mark + line).rstrip() for line in text.split("\n")) for mark in STYLES), "\n".join("#" + line for line in text.split("\n"))]


def test_known_texts_however_they_are_laid_out(spark):
    long = [(i, t) for i, t in licenses.KNOWN if len(t) > 200]
    texts = [(i, way) for i, t in long for way in laid_out(t)]
    got = {r["doc_id"]: r["license_id"] for r in licenses.scan_licenses(docs(spark, [t for _, t in texts])).collect()}
    missed = [(i, n) for n, (i, _) in enumerate(texts) if got[n] != i]
    assert not missed and len(long) > 8


@pytest.mark.skipif(not COMMON.is_dir(), reason="no licence texts on this machine")
def test_whole_licenses_however_they_are_laid_out(spark):
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "MPL-2.0": "MPL-2.0", "GFDL-1.3": "GFDL-1.3-only"}
    texts = [(i, way) for name, i in names.items() for way in laid_out((COMMON / name).read_text())]
    got = {r["doc_id"]: r["license_id"] for r in licenses.scan_licenses(docs(spark, [t for _, t in texts])).collect()}
    assert [(i, n) for n, (i, _) in enumerate(texts) if got[n] != i] == []


def test_licenses_with_one_digest_and_clashing_columns(spark):
    clashing = docs(spark, ["the very same words"]).withColumns({"digest": F.lit("x"), "license_id": F.lit("y"), "_text": F.lit("z"), "kind": F.lit("k")})
    row = licenses.scan_licenses(clashing, known=[("B", "The very same words"), ("A", "the very, same words.")], digests=[]).first()
    assert (row["license_id"], row["notices"]) == ("A", ["A"])
    long = licenses.scan_licenses(docs(spark, ["word " * 300_000 + "\nReleased under the MIT License."])).first()
    assert long["license_id"] is None and long["notices"] == ["MIT"] and long["digest"]


def test_shards_even_and_gapless(spark):
    keys = spark.range(1003).selectExpr("if(id % 3 = 0, null, id) AS doc_id", "id AS size", "id AS text_crc32", "id AS rank")
    keys = keys.unionByName(keys.limit(50))
    got = shards.shard(keys, "doc_id", 7, vnodes=16).collect()
    sizes = Counter(r["shard"] for r in got)
    assert len(got) == 1053 and max(sizes.values()) - min(sizes.values()) <= 1
    assert sorted((r["shard"], r["slot"]) for r in got) == [(s, i) for s in range(7) for i in range(sizes[s])]
    assert sorted(map(str, got)) == sorted(map(str, shards.shard(keys.repartition(3), "doc_id", 7, vnodes=16).collect()))
    assert shards.shard(keys.limit(0), "doc_id", 7).count() == 0


def test_shards_move_little(spark):
    keys = spark.range(4000).selectExpr("id AS doc_id")
    place = lambda n: {r["doc_id"]: r["shard"] for r in shards.shard(keys, "doc_id", n, slack=0.25).collect()}
    a, b = place(8), place(9)
    assert max(Counter(a.values()).values()) <= 500 * 1.25
    assert sum(a[k] != b[k] for k in a) < 4000 / 9 * 2.5


def slow_figures(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if __import__("re").search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_figures(spark):
    texts = [
        "a b c d e a b c d e a b c d e", "x " * 400, "one\n\ntwo\none\n \n one", None, "", " \t\n", "é#*  ß\x0bü", "a b c d e f g h i j k l m a b c d e", "\U0001f600 " * 12,
        " ".join(f"w{i}" for i in range(5000)) + " w1 w2 w3 w4 w5",
    ]
    got = {r["doc_id"]: r for r in quality.quality_rules(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == slow_figures(t), i
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
    assert quality.quality_rules(docs(spark, [])).count() == 0


def test_quality_counts_every_occurrence(spark):
    """A line that stands twice in a document is one document's, and both places go; repeated rows change nothing."""
    texts = [f"common line of all\nown words of number {chr(97 + i) * 5} here\ncommon line of all" for i in range(25)]
    d = docs(spark, texts)
    for rows in (d, d.unionByName(d.limit(3))):
        got = quality.quality_rules(rows, line_docs=17).collect()
        assert {r["removed_words"] for r in got} == {8} and {len(r["removed_lines"]) for r in got} == {1}
    assert {r["removed_words"] for r in quality.quality_rules(d, line_docs=18).collect()} == {0}  # 18 log10(25) is 25.2


def test_quality_boilerplate(spark):
    spell = lambda n: "".join(chr(97 + int(c)) for c in str(n))
    own = lambda i: " ".join(f"w{spell(i)}x{spell(k)}" for k in range(12))
    texts = [f"Click here, to read ALL our great terms of the service today {i % 10}!\n{own(i)}" for i in range(30)]
    texts += ["Click here to read all our great terms of the service today 7"] * 40 + [own(99)] * 30 + [own(98)] * 60
    d = docs(spark, texts).unionByName(docs(spark, texts[:5], source=None, start=500))
    got = {r["doc_id"]: r for r in quality.quality_rules(d, line_docs=20).collect()}
    assert all(got[i]["kept"] and got[i]["removed_words"] > 0 for i in range(30))
    assert not any(got[i]["kept"] for i in range(30, 70)), "nothing but boilerplate"
    assert all(got[i]["kept"] and not got[i]["removed_words"] for i in range(70, 100)), "copies below the limit, 20 log10(160) = 44"
    assert not any(got[i]["kept"] for i in range(100, 160)), "copies are documents"
    assert all(got[i]["removed_words"] == 0 for i in range(500, 505)), "another host"
    clean = {r["doc_id"]: r for r in quality.filter_documents(d).collect()}
    assert clean[3]["text"] == own(3) and clean[3]["n_chars"] == len(own(3)) and clean[500]["text"] == texts[0] and 30 not in clean


CALLS = "conv_id long, call_id string, after_id string, turn long, name string, arguments string"
RESULTS = "conv_id long, call_id string, turn long, content string"


def test_tool_calls(spark):
    good = '{"turn": 1, "prompt": "h\\u00e9 \\"q\\"", "words": 5}'
    calls = [
        (1, "a", None, 0, "ask", good), (1, "b", "a", 2, "ask", '{"turn": "x", "extra": 1}'), (1, "c", "b", 4, "nope", "{}"), (1, "d", "e", 5, "ask", good), (1, "e", "d", 6, "ask", good),
        (1, None, None, 7, "ask", good), (2, "a", "missing", 0, "ask", "[1]"), (2, "a", None, 3, "ask", good), (None, "n", None, 0, "ask", good), (3, "z", "z", 0, "ask", None),
    ]
    results = [(1, "a", 1, "ok\n"), (1, "a", 9, "late"), (4, "q", 1, "lost"), (1, None, 1, "loose"), (None, "n", 1, None)]
    got = tool_calls.link_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS)).collect()
    by = {(r["conv_id"], r["call_id"]): r for r in got if r["call_id"] is not None}
    assert len(got) == 11 and sum(r["status"] == "no id" for r in got) == 2
    assert [by[1, k]["level"] for k in "abcde"] == [0, 1, 2, None, None]
    assert [by[1, k]["status"] for k in "abcd"] == ["ok", "invalid", "invalid", "cycle"]
    assert by[1, "b"]["problems"] == ["extra extra", "missing prompt", "type of turn"] and by[1, "c"]["problems"] == ["unknown tool"]
    assert by[1, "a"]["n_results"] == 2 and by[2, "a"]["n_calls"] == 2 and by[4, "q"]["status"] == "no call" and by[3, "z"]["status"] == "cycle"
    assert by[None, "n"]["status"] == "ok" and by[2, "a"]["problems"] == ["arguments are no JSON object"]
    assert by[1, "a"]["json"] == '{"arguments":{"prompt":"hé \\"q\\"","turn":1,"words":5},"call_id":"a","name":"ask","result":"ok\\n","result_turn":1,"turn":0}'


@pytest.mark.parametrize("n", [1, 40])
def test_tool_call_chains(spark, n):
    calls = [(1, f"c{i}", f"c{i - 1}", i, "ask", "{}") for i in range(n)]
    got = tool_calls.levels(spark.createDataFrame(calls, CALLS)).collect()
    assert {r["call_id"]: r["level"] for r in got} == {f"c{i}": i for i in range(n)}


def test_tool_schemas_and_numbers(spark):
    schema = {
        "book": {
            "properties": {
                "when": {"type": "object", "properties": {"day": {"type": "string", "pattern": r"^\d{4}-\d\d$"}, "hour": {"type": "integer", "maximum": 23}}, "required": ["day"]},
                "seats": {"type": "array", "items": {"type": "integer"}}, "class": {"type": "string", "enum": ["a", "b"]}, "price": {"type": "number", "minimum": 1},
            },
            "required": ["when"], "extra": False,
        }
    }
    cases = [
        ('{"when": {"day": "2024-01", "hour": 3}, "seats": [1, 2], "class": "a", "price": 1.5}', [], '{"class":"a","price":1.5,"seats":[1,2],"when":{"day":"2024-01","hour":3}}'),
        ('{"when": {"hour": 24}, "seats": [1, "x"], "class": "c"}', ["enum of class", "items of seats", "maximum of when.hour", "missing when.day"], '{"class":"c","seats":[1,"x"],"when":{"hour":24}}'),
        ('{"when": {"day": "soon"}, "price": 1.0}', ["pattern of when.day"], '{"price":1,"when":{"day":"soon"}}'),
        ('{"price": 1e0, "when": 7, "note": "1.0, \\"2.0\\" 3.0"}', ["extra note", "type of when"], '{"note":"1.0, \\"2.0\\" 3.0","price":1,"when":7}'),
        ('{"price": 10.05, "price": 2}', ["arguments are no JSON object"], "null"), ("", ["arguments are no JSON object"], "null"), (None, ["arguments are no JSON object"], "null"),
    ]
    calls = spark.createDataFrame([(1, f"c{i}", None, i, "book", c[0]) for i, c in enumerate(cases)], CALLS).withColumn("status", F.lit("clash"))
    got = {r["turn"]: r for r in tool_calls.link_calls(calls, spark.createDataFrame([], RESULTS), schema).collect()}
    for i, (_, wrong, text) in enumerate(cases):
        assert got[i]["problems"] == wrong, i
        assert got[i]["json"].startswith('{"arguments":' + text + ',"call_id"'), got[i]["json"]
    assert tool_calls.link_calls(calls.limit(0), spark.createDataFrame([], RESULTS)).count() == 0
    long = tool_calls.link_calls(spark.createDataFrame([(1, "x", None, 0, "ask", '{"turn": 1, "prompt": "' + "y " * 300_000 + '"}')], CALLS), spark.createDataFrame([(1, "x", 1, "z" * 500_000)], RESULTS)).first()
    assert long["problems"] == ["max_length of prompt"] and len(long["json"]) > 1_100_000


def test_shard_sizes_and_digests(spark, tmp_path):
    texts = [None, "", "plain", "é文😀", "x" * 70_000, "plain"]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in shards.op2_shards(spark, str(tmp_path)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        data = (t or "").encode()
        assert (rows[i]["size"], rows[i]["text_crc32"], rows[i]["law"], rows[i]["grown_shard"]) == (len(data) + 16, zlib.crc32(data), "rows", None)
