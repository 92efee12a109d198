"""Pages cut into segments: structure, what is skipped, spans, languages, regions, buttons; all pages of a test run as one table."""

from __future__ import annotations

import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from glossmill.operators import nodes
from glossmill.operators.extract import node_audit, segments
from glossmill.operators.html_tree import MARK_CLASS, Nodes, parse

#: (page, sources)
CUTS = [
    ("<h2>Tide tables</h2>  <p>High water at noon.</p>", ["Tide tables", "High water at noon."]),
    ("<p>Rope, <em>tar</em> and <u>canvas</u>, all <b><i>new</i></b>!</p>", ["Rope, tar and canvas, all new!"]),
    ("<section><div><div><p>Far down.</p></div></div></section>", ["Far down."]),
    ("<ol><li>Lead</li><li>Tin<ul><li>White tin</li></ul></li></ol>", ["Lead", "Tin", "White tin"]),
    ("<p>First verse<br>second verse</p>", ["First verse\nsecond verse"]),
    ("<p>Kept.</p><style>b{top:0}</style><script>let q = '<p>';</script><p>Kept too.</p>", ["Kept.", "Kept too."]),
    ("<p><ruby>港<rt>みなと</rt></ruby> means harbour.</p>", ["港 means harbour."]),
    ("<em>ahead <p>inside</p> behind</em>", ["ahead", "inside", "behind"]),
    ("<i>left <u>mid <p>block</p> dle</u> right</i>", ["left", "mid", "block", "dle", "right"]),
    ("<div>one<div></div>two</div>", ["one", "two"]),
    ("<p>salt<!-- no break -->water</p>", ["saltwater"]),
    ("<p>oak<script>1</script>wood</p>", ["oakwood"]),
    ("<p> \n\t </p><p>　</p><p>ink</p>", ["ink"]),
    ('<span style="color:red; display: block">Upper.</span><span style="DISPLAY:block">Lower.</span>', ["Upper.", "Lower."]),
    ('<p>Turn <a style="display:block">the wheel</a> slowly.</p>', ["Turn", "the wheel", "slowly."]),
    ('<nav style="display:contents">outer <p>in</p></nav>', ["outer", "in"]),
    ('<div>sun <span style="display:contents">and <em style="display:contents">moon <p>P</p> set</em> or</span> rise</div>', ["sun and moon", "P", "set or rise"]),
    ('<div style="display:flex"><span>cup</span><b>jug</b>loose<p>bowl</p></div>', ["cup", "jug", "loose", "bowl"]),
    ('<div style="display:grid"><span style="display:inline-flex"><b>x1</b><i>x2</i></span></div>', ["x1", "x2"]),
    ('<div style="display:flex"><span style="display:contents">as it is</span> here</div>', ["as it is here"]),
    ("<p>mm <b>nn<br>oo</b> pp</p>", ["mm", "nn\noo", "pp"]),
    ("<p>open<p>next<ul><li>c<li>d</ul>", ["open", "next", "c", "d"]),
    ("<table><tr><td>r1</td><td>r2<tr><td>r3</table>", ["r1", "r2", "r3"]),
    ("<div>yes<pre><code>no</code></pre>so</div>", ["yesso"]),
    ("bare words", ["bare words"]),
    ("<html><head><title>T</title></head><body>body text</body></html> after", ["body text after"]),
    ("", []),
    (None, []),
]

HIDDEN = [
    '<span aria-hidden="true">L</span>', "<span hidden>L</span>", '<span data-d="none">L</span>', '<i class="x sr-only">L</i>', '<b translate="no">L</b>', "<script>L</script>", "<textarea>L</textarea>", "<svg><text>L</text></svg>",
    f'<span class="{MARK_CLASS}">L</span>', '<span contenteditable>L</span>', '<b role=" Slider ">L</b>', '<i style="content-visibility:hidden">L</i>',
]
FRAMES = ["<p>north X south</p>", "<p><em>north X south</em></p>", "<p>north <code>X</code> south</p>", "<p>north <time>9 X</time> south</p>"]

#: (page, source, spans)
SPANS = [
    ("<p>Run <code>make all</code> twice.</p>", "Run make all twice.", [(4, 12, "code")]),
    ("<p>\n\tRun  <code>make</code>\n\tonce.\n</p>", "Run make\nonce.", [(4, 8, "code")]),
    ("<p><code> ls </code> and <time>noon</time></p>", "ls and noon", [(0, 2, "code"), (7, 11, "time")]),
    ("<p>yes <br> <code>no</code> maybe</p>", "yes\nno maybe", [(4, 6, "code")]),
    ('<p>big <code>f(<var lang="zh-Hant">名</var>, <s hidden>x</s>y)</code> end</p>', "big f(名, y) end", [(4, 11, "code")]),
    ("<p>\U0001f600\U0001f600 <code>\U0001f680z</code></p>", "\U0001f600\U0001f600 \U0001f680z", [(5, 8, "code")]),
    ("<p>sand <code> </code> dune</p>", "sand dune", [(4, 4, "code")]),
    ("<p> <code>  </code>dune</p>", "dune", [(0, 0, "code")]),
    ("<p>a1 <code>b<time>c</time></code><code>d</code></p>", "a1 bcd", [(3, 5, "code"), (5, 6, "code")]),
    ("<p>dune <time> </time>end</p>", "dune end", []),
]


def table(spark, pages):
    return spark.createDataFrame([(k, html) for k, html in enumerate(pages)], "page_id long, html string")


def collected(spark, pages, *columns, **options):
    out = [[] for _ in pages]
    for r in segments(table(spark, pages), **options).orderBy("page_id", "order").collect():
        out[r.page_id].append(r[columns[0]] if len(columns) == 1 else tuple(r[c] for c in columns))
    return out


def test_cuts(spark):
    assert collected(spark, [p for p, _ in CUTS], "source") == [s for _, s in CUTS]


def test_nothing_hidden_leaks(spark):
    pages = [frame.replace("X", hidden) for frame in FRAMES for hidden in HIDDEN]
    wanted = ["north 9 south" if "<time>" in p else "north south" for p in pages]
    assert collected(spark, pages, "source") == [[w] for w in wanted]


def test_whole_subtrees_are_skipped(spark):
    pages = ['<section translate="no"><p>brand</p></section><p>kept</p>', '<p lang="zh-TW">海</p><p lang="fr">mer</p>', '<body class="notranslate"><p>kept</p></body>', '<body hidden><p>gone</p></body>', '<time> <b hidden>x</b> </time><p>kept</p>']
    assert collected(spark, pages, "source") == [["kept"], ["mer"], ["kept"], [], ["kept"]]


def test_protected_spans(spark):
    found = collected(spark, [p for p, _, _ in SPANS], "source", "protected_spans")
    assert [[(s, [tuple(x) for x in spans]) for s, spans in own] for own in found] == [[(s, spans)] for _, s, spans in SPANS]


def test_spans_agree_with_collapsed_prefixes(spark):
    """A place on the normalized text is the length of what precedes it, collapsed; inside white space, that character's place."""
    import itertools

    words = ["a", " b", "c ", " ", "d  e", "\n"]
    pages = ["<p>" + "".join(f"<code>{w}</code>" if k % 2 else w for k, w in enumerate(own)) + "</p>" for own in itertools.product(words, repeat=3)]
    for own, found in zip(itertools.product(words, repeat=3), collected(spark, pages, "source", "protected_spans"), strict=True):
        raw = "".join(own)
        place = lambda k: len(" ".join(raw[:k].split())) + (raw[:k].strip() != "" and raw[:k][-1:].isspace() and not raw[k : k + 1].isspace())  # noqa: B023, E731
        for source, spans in found:
            a, b = len(own[0]), len(own[0]) + len(own[1])
            assert [(s.start, s.end) for s in spans] == [(min(place(a), len(source)), min(place(b), len(source)))], own


def test_languages_and_insert_modes(spark):
    pages = ['<html lang="zh-CN"><body><p>海港</p><p>海<b>港</b></p><div lang=""><p>海湾</p></div><ul lang="ja"><li>海</li></ul><button>海船</button></body></html>']
    (found,) = collected(spark, pages, "source", "eff_lang", "insert_mode", "kind", "replace_snapshot")
    assert found == [
        ("海港", "zh-cn", "replace", None, "海港"), ("海港", "zh-cn", "after-segment", None, None), ("海湾", "", "after-segment", None, None),
        ("海", "ja", "after-segment", None, None), ("海船", "zh-cn", "replace", "button", "海船"),
    ]
    assert [x[2] for x in collected(spark, pages, "source", "state", "insert_mode", target="zh-Hans")[0]] == ["after-segment"] * 4 + ["replace"]


def test_regions(spark):
    long = "words " * 30
    pages = [
        "<nav><p>a</p></nav><main><p>b</p></main><div role='banner'><article><p>c</p></article><p>d</p></div>",
        f"<div class='sidebar'><p>{long[:60]}</p><p>{long}</p></div><div class='post-body menu'><p>ok</p></div>",
        f"<p><a>{long[:60]}</a></p><p>{long}<a>x</a></p><p>short</p>",
    ]
    assert collected(spark, pages, "region") == [["chrome", "main", "main", "chrome"], ["chrome", "main", "main"], ["chrome", "main", "chrome"]]


def test_buttons(spark):
    pages = ["<button>Go</button><button>Go <b>on</b></button><label>Twenty-one letters ab</label><div role=' Button '>Ok</div><button>a<!-- -->b</button><button>x<p>y</p></button>"]
    assert collected(spark, pages, "source", "kind")[0] == [("Go", "button"), ("Go on", None), ("Twenty-one letters ab", None), ("Ok", "button"), ("ab", None), ("x", None), ("y", None)]


def test_places_pass_over_marks(spark):
    plain = "<div>one <p>two</p></div><p>three</p>"
    marked = plain.replace("</p></div>", f"</p><div class='{MARK_CLASS}'>T <b>x</b></div></div><div class='{MARK_CLASS}'>U</div>")
    a, b = collected(spark, [plain, marked], "source", "anchor_path", "ref_path", "anchor_tag")
    assert a == b == [("one", "1", "2", "div"), ("two", "3", "4", "p"), ("three", "5", "6", "p")]


def test_style_resolver_is_an_argument(spark):
    shown = lambda tag, attrs: F.when(tag == "span", "block").when(attrs["id"] == "off", "none").otherwise(nodes.display_by_tag(tag, attrs))
    assert collected(spark, ["<p>a <span>b</span> c</p><p id='off'>d</p>"], "source", display_of=shown) == [["a", "b", "c"]]


def test_composed_text_decides_the_gate(spark):
    syllable = "가"
    jamo = unicodedata.normalize("NFD", syllable)
    assert collected(spark, [f"<p>{jamo}</p>", f"<p>{syllable}</p>", f"<p>{jamo}{jamo}</p>"], "source", "skip_reason") == [[(jamo, "min-length")], [(syllable, "min-length")], [(jamo * 2, None)]]


def test_audit(spark):
    found = {(r.tag, r.rule): (r.disposition, r.n) for r in node_audit(table(spark, ["<p>x<!-- c --><code>y</code></p><i hidden>z<b>w</b></i><time> </time><p lang='zh-HK'>h</p>"])).collect()}
    assert found == {
        ("body", "walk"): ("WALK", 1), ("p", "walk"): ("WALK", 1), ("#text", "text"): ("WALK", 2), ("#comment", "comment"): ("SKIP_SUBTREE", 1), ("code", "opaque"): ("OPAQUE_INLINE", 1),
        ("i", "attribute"): ("SKIP_SUBTREE", 1), ("time", "walk"): ("WALK", 1), ("p", "already-target"): ("SKIP_SUBTREE", 1),
    }


@pytest.mark.parametrize("page", ["<div>" * 3000 + "low down" + "</div>" * 3000, "".join(f"<p>item {k}</p>" for k in range(20_000)), "".join(f"<div>t{k} x" for k in range(3000)), "<p>" + "".join(f"<code>c{k}</code> and " for k in range(3000))])
def test_large_pages_take_linear_work(spark, page):
    began = time.time()
    found = segments(table(spark, [page])).agg(F.count("*"), F.max("order")).first()
    assert found[0] == found[1] + 1 == max(page.count("item "), page.count(" x"), 1)
    assert time.time() - began < 60


def test_files_and_fragments(spark, tmp_path):
    from glossmill.sources.pages import html_files, wrapped

    for name, body in (("a", "<p>from a\nfile</p>"), ("b", "<p>other</p>")):
        (tmp_path / f"{name}.html").write_text(body)
    found = segments(html_files(spark, str(tmp_path))).select("page_id", "source").collect()
    assert sorted(r.source for r in found) == ["from a\nfile", "other"] and len({r.page_id for r in found}) == 2
    assert [r.source for r in segments(wrapped(table(spark, ["<p>part</p>"]))).collect()] == ["part"]


def test_node_table():
    tables = Nodes()
    tables.add("<p id=1>\U0001f600<b x=y>c</b></p>d")
    tables.add(None)
    first, second = tables.arrow().to_pylist()
    assert [(n["tag"], n["parent"], n["last"], n["depth"], n["place"], n["units"]) for n in first] == [
        ("html", 0, 6, 0, 0, 0), ("body", 0, 6, 1, 0, 0), ("p", 1, 5, 2, 1, 0), ("#text", 2, 3, 3, 2, 2), ("b", 2, 5, 3, 3, 2), ("#text", 4, 5, 4, 4, 3), ("#text", 1, 6, 2, 5, 4),
    ]
    assert [n["attrs"] for n in first] == [None, None, [("id", "1")], None, None, None, None]
    assert [n["tag"] for n in second] == ["html"]
    assert parse("just text")[1].children[0].text == "just text"


def test_open_elements_at_any_depth():
    """100,000 open elements and as many end tags that match none of them, or lists and cells, take seconds; nothing is closed by mistake."""
    n = 100_000
    began = time.time()
    for html, depth in (("<font>" * n + "</u>" * n, n), ("<ul><li>" * n + "</b>" * n, 2 * n), ("<div>" * n + "<p>" * n, n + 1), ("<table><tr><td><i>" * n + "</u>" * n, 4 * n), ("<div><p>" * n + "</p>" * n, n + 1)):
        top, body = parse(html)
        deepest, stack = 0, [(body, 0)]
        while stack:
            node, d = stack.pop()
            deepest = max(deepest, d)
            stack += [(c, d + 1) for c in node.children]
        assert deepest == depth, html[:20]
    assert time.time() - began < 30


def test_deep_pages_as_tables(spark):
    deep = "<div>" * 20_000 + "far down" + "</b>" * 20_000
    assert collected(spark, [deep, "<font>" * 9_000 + "x y" + "</u>" * 9_000], "source") == [["far down"], ["x y"]]
