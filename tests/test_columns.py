"""Column functions against decision tables, and segments through Spark."""

from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from glossmill.functions import lang, text
from glossmill.operators.extract import segments
from glossmill.sources.pages import text_inputs, wrapped

GATE = [
    ("😀 !", "emoji"), ("…!?", "punct"), ("404", "numeric"), ("$1,234.50", "numeric"), ("10:30", "numeric"), ("a@b.co", "email"), ("https://x.y/z", "url"), ("www.x", "url"), ("U.S.A", None),
    ("\x85", "whitespace"), ("字", None), ("/usr/lib", "path"), ("my_file.js", "filename"), ("a.js", "url"), ("example.com", "url"), ("a", "min-length"), ("é", "min-length"), ("v1.2.3", "min-length"),
    ("©", "emoji"), ("ok", None), ("x.7z", "filename"), ("", "whitespace"), ("a b.js", None),
]
#: Parts of language tags; every combination is judged by the rule in test_variants.
LANGUAGES, SCRIPTS, REGIONS, ENDS = ["zh", "Zh", "nan", "de", "zhuang"], ["", "hANT", "Hans", "Bopo"], ["", "mo", "My", "GB"], ["", "pinyin", "u-hant", "t-my"]
#: Blanks of several kinds, and what a run of them comes to.
RUNS = {"\t\t": " ", "\u2003\r": " ", "\u00a0 \u3000": " ", "\ufeff": " ", "\n": "\n", "\u2009\n\t\n": "\n", "\r\n": "\n", " \x0b\n\u1680": "\n"}


def test_gate(spark):
    df = spark.createDataFrame(GATE, "t string, expected string")
    found = df.select("t", "expected", text.skip_reason(text.gate_text(F.col("t")), F.lit(False)).alias("found"))
    assert [r for r in found.collect() if r.expected != r.found] == []


def test_gate_on_pages_in_the_target(spark):
    df = spark.createDataFrame([("已經是中文",), ("日本語です",)], "t string")
    assert [r[0] for r in df.select(text.skip_reason(F.col("t"), F.lit(True))).collect()] == ["already-target", None]


def test_variants(spark):
    """A script decides, then a region that is known; what follows a one-letter subtag doesn't count; spaces and case never do."""
    rows = []
    for k, (language, script, region, end) in enumerate(itertools.product(LANGUAGES, SCRIPTS, REGIONS, ENDS)):
        parts = [p for p in (script, region, end) if p]
        tag = "-_"[k % 2].join([language, *parts])
        by_region = {"mo": "hant", "my": "hans"}.get(region.lower(), "unknown")
        variant = {"hant": "hant", "hans": "hans", "bopo": "unknown"}.get(script.lower(), by_region if parts else "zh")
        rows.append((f" {tag}\t" if k % 3 else tag, variant if language.lower() == "zh" else None))
    rows += [(None, None), ("", None), ("\n", None), ("zh-", "unknown")]
    found = spark.createDataFrame(rows, "tag string, expected string").withColumn("found", lang.zh_variant(F.col("tag")))
    assert [r for r in found.collect() if r.expected != r.found] == []


@pytest.mark.parametrize(("tag", "sample", "target", "expected"), [("zh-TW", "", "zh-Hant", True), ("zh-CN", "", "zh-Hant", False), ("zh-CN", "", "zh-Hans", True), ("zh", "", "zh-Hans", False), (None, "這是一段中文內容", "", True), (None, "日本語です", "zh-Hant", False), (None, "English", "zh-Hant", False), ("zh-TW", "", "ja", False)])
def test_page_gate(spark, tag, sample, target, expected):
    df = spark.createDataFrame([(tag, sample, target)], "a string, b string, c string")
    assert df.select(lang.page_is_target(F.col("a"), F.col("b"), F.col("c"))).first()[0] is expected


@pytest.mark.parametrize(("own", "target", "expected"), [("ja-JP", "ja", True), ("ja_JP", "ja", False), ("FR-ca ", " fr", True), ("", "fr", False), ("zh", "zh-Hans", False), ("zh-CN", "zh-CHS", False), (None, "ja", False), ("ja", None, False)])
def test_already_target(spark, own, target, expected):
    assert spark.createDataFrame([(own, target)], "a string, b string").select(lang.already_target(F.col("a"), F.col("b"))).first()[0] is expected


def test_normalized(spark):
    """Runs between words, at the ends, next to each other, and alone."""
    pairs = list(itertools.product(RUNS, RUNS))
    rows = [(f"{a}fir{b}elm tree{a}", f"fir{RUNS[b]}elm tree") for a, b in pairs] + [(f"fir{a}{b}elm", f"fir{max(RUNS[a], RUNS[b], key='\n'.__eq__)}elm") for a, b in pairs] + [(a + b, "") for a, b in pairs] + [("fir elm", "fir elm"), ("", ""), (None, None)]
    found = spark.createDataFrame(rows, "raw string, expected string").withColumn("found", text.normalized(F.col("raw")))
    assert [r for r in found.collect() if r.expected != r.found] == []


def test_utf16_length(spark):
    assert spark.createDataFrame([("😀 ok",)], "t string").select(text.utf16_length(F.col("t"))).first()[0] == 5


CASES = [
    ("<button>送出</button>", "zh-Hant", [("送出", "button", "replace", "chrome")]),
    ("<button>A deliberately long button label past it</button>", "zh-Hant", [("A deliberately long button label past it", None, "after-segment", "main")]),
    ('<div lang="zh-CN"><p>这是简体中文段落。</p></div>', "zh-Hant", [("这是简体中文段落。", None, "replace", "chrome")]),
    ('<div lang="zh-CN"><p>这是简体中文段落。</p></div>', "en", [("这是简体中文段落。", None, "after-segment", "chrome")]),
    ('<p lang="zh-CN">English here</p>', "zh-Hant", [("English here", None, "after-segment", "chrome")]),
    ("<nav role='main'><p>text in it</p></nav>", "zh-Hant", [("text in it", None, "after-segment", "main")]),
    ("<article><nav><p>some link</p></nav></article>", "zh-Hant", [("some link", None, "after-segment", "chrome")]),
    ('<div class="sidebar"><p>' + "word " * 15 + "</p></div>", "zh-Hant", [(("word " * 15).strip(), None, "after-segment", "chrome")]),
    ("<p>" + "word " * 14 + "</p>", "zh-Hant", [(("word " * 14).strip(), None, "after-segment", "main")]),
]


def test_segments(spark):
    for target in ("zh-Hant", "en"):
        own = [(k, h) for k, (h, t, _) in enumerate(CASES) if t == target]
        found = segments(wrapped(spark.createDataFrame(own, "page_id long, html string")), target).orderBy("page_id", "order").collect()
        got = [(r.page_id, r.source, r.kind, r.insert_mode, r.region) for r in found]
        assert got == [(k, *x) for k, (_, t, rows) in enumerate(CASES) if t == target for x in rows]
    assert segments(spark.createDataFrame([], "page_id long, html string")).count() == 0
    assert segments(spark.createDataFrame([(1, None)], "page_id long, html string")).count() == 0


def test_ids(spark):
    rows = segments(spark.createDataFrame([(1, "<p>First paragraph.</p><p>404</p>")], "page_id long, html string")).orderBy("order").collect()
    assert [(r.seg_id, r.state, r.skip_reason) for r in rows] == [("k1-0", "pending", None), ("k1-1", "skipped", "numeric")]


def test_text_inputs(spark):
    rows = [(" Hello ", None), (None, b" \n"), (None, b"\xff\xfe"), (None, b" ok ")]
    found = text_inputs(spark.createDataFrame(rows, "positional string, content binary")).select("text", "status").collect()
    assert [tuple(r) for r in found] == [("Hello", "ok"), ("", "empty"), (None, "invalid_utf8"), ("ok", "ok")]
