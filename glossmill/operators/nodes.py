"""What the nodes of a page mean: labels, blocks, runs of inline content and their facts, as Column expressions on arrays.

A page is an array of nodes in document order (html_tree.NODE), so a subtree is a stretch of it. What a node gets from above (skipped
ancestors, language, landmark, owning block) is found by climbing in doubled steps, what it gets from below (blocks, text, links) by
differences of running totals: n log n work on a page, whatever its depth or breadth, and nothing is shuffled.

Each step adds array columns that later ones read several times, so that the optimizer computes them once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.functions import lang, text
from glossmill.functions.kept import kept
from glossmill.functions.lang import let
from glossmill.functions.text import BLANK
from glossmill.operators.html_tree import INLINE_TAGS, MARK_CLASS, MARK_ID, SOURCE_ATTR

# Tag, role and word lists that decide how a page is cut.
FORCE_BLOCK = "body h1 h2 h3 h4 h5 h6 br form select button label ul ol li blockquote pre article section figure figcaption header footer main nav".split()
SKIP_TAGS = "script style noscript template textarea input option optgroup svg canvas audio video img source track iframe object embed head title meta link base hr rt rp math pre".split()
OPAQUE_TAGS = ["code", "time"]
SKIP_ROLES = "presentation none math progressbar slider spinbutton scrollbar separator".split()
MAIN_ROLES, CHROME_ROLES = ["main", "article"], ["navigation", "banner", "contentinfo", "complementary", "search"]
MAIN_TAGS, CHROME_TAGS = ["main", "article"], ["nav", "header", "footer", "aside"]
MAIN_HINT = "(?i)article|content|post|main|story|body|entry"
CHROME_HINT = "(?i)nav|menu|sidebar|footer|header|breadcrumb|widget|banner|promo|social|comment"
FLEX = ["flex", "inline-flex", "grid", "inline-grid"]
#: Beyond every node's number.
NEVER = 2**31 - 1

SPAN = "start: int, end: int, kind: string"
#: A run of inline content: its text and protected spans, and the facts of its block that later decisions need.
RUN = (
    f"source: string, spans: array<struct<{SPAN}>>, eff_lang: string, landmark: string, hint: string, block_text_len: int, block_link_len: int, is_button_el: boolean, "
    "only_text_children: boolean, has_block_desc: boolean, block_text: string, anchor_tag: string, anchor_path: string, ref_path: string"
)

DisplayOf = Callable[[Column, Column], Column]


def running(values: Column, n: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Inclusive running totals of an array of n values under an associative join, by doubled steps."""

    def doubled(totals: Column, r: Column) -> Column:
        def step(x: Column, i: Column) -> Column:
            before = F.get(totals, i - F.call_function("shiftleft", F.lit(1), r))
            return F.when(before.isNull(), x).otherwise(join(before, x))

        return F.transform(totals, step)

    return F.aggregate(rounds(n), values, doubled)


def total(values: Column, n: Column) -> Column:
    return running(values, n, lambda a, b: a + b)


def rounds(n: Column) -> Column:
    return F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(n, F.lit(1)))).cast("int"))


def climbed(own: Column, parents: Column, depth: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each node its own value joined with those of all nodes above it; join(own, above) must be associative and idempotent."""
    start = F.struct(own.alias("value"), parents.alias("up"))

    def step(acc: Column, _: Column) -> Column:
        value = F.transform(acc["value"], lambda x, i: join(x, F.get(acc["value"], F.get(acc["up"], i))))
        return F.struct(value.alias("value"), F.transform(acc["up"], lambda u: F.get(acc["up"], u)).alias("up"))

    return F.aggregate(rounds(depth + 1), start, step, lambda acc: acc["value"])


def display_by_tag(tag: Column, attrs: Column) -> Column:
    """The default style resolver: display from data-d or an inline style, else by tag."""
    styled = F.lower(F.regexp_extract(F.coalesce(attrs["style"], F.lit("")), r"(?i)(?:^|;)\s*display\s*:\s*([a-z-]+)", 1))
    by_tag = F.when(tag.isin([*sorted(INLINE_TAGS), *OPAQUE_TAGS]), "inline").otherwise("block")
    return F.when(attrs.isNull(), by_tag).otherwise(F.coalesce(F.nullif(attrs["data-d"], F.lit("")), F.nullif(styled, F.lit("")), by_tag))


def inline(display: Column) -> Column:
    return display.rlike("^(?:inline|ruby)") | (display == "contents")


def named(classes: Column, *names: str) -> Column:
    return classes.rlike(rf"(?:^|\s)(?:{'|'.join(names)})(?:\s|$)")


def role_of(attrs: Column) -> Column:
    return F.lower(text.trimmed(attrs["role"]))


def self_skip(tag: Column, attrs: Column) -> Column:
    """The attribute rule by which an element and all below it is skipped, else null."""
    classes = F.coalesce(attrs["class"], F.lit(""))
    switched = (attrs["aria-hidden"] == "true") | attrs["hidden"].isNotNull() | F.lower(attrs["contenteditable"]).isin("", "true")
    attribute = F.coalesce(switched, F.lit(False)) | F.coalesce(role_of(attrs).isin(SKIP_ROLES), F.lit(False)) | named(classes, "sr-only", "visually-hidden")
    untranslated = (tag != "body") & (F.coalesce(attrs["translate"] == "no", F.lit(False)) | named(classes, "notranslate"))
    return F.when(attrs.isNull(), None).when(attribute, "attribute").when(untranslated, "translate-no")


def landmark_of(tag: Column, attrs: Column) -> Column:
    role = role_of(attrs)
    return F.when(role.isin(MAIN_ROLES), "main").when(role.isin(CHROME_ROLES), "chrome").when(tag.isin(MAIN_TAGS), "main").when(tag.isin(CHROME_TAGS), "chrome")


def hint_of(attrs: Column) -> Column:
    name = F.concat_ws(" ", F.coalesce(attrs["class"], F.lit("")), F.coalesce(attrs["id"], F.lit("")))
    return F.when(attrs.isNull(), None).when(name.rlike(MAIN_HINT), "main").when(name.rlike(CHROME_HINT), "chrome")


def facts_of(n: Column, display_of: DisplayOf) -> Column:
    """What a node says of itself."""
    tag, attrs = n["tag"], n["attrs"]
    element = ~tag.startswith("#")
    button_role = F.coalesce(role_of(attrs) == "button", F.lit(False))
    mark = F.when(attrs.isNull(), False).otherwise(attrs[MARK_ID].isNotNull() | attrs[SOURCE_ATTR].isNotNull() | named(F.coalesce(attrs["class"], F.lit("")), MARK_CLASS))
    style = F.coalesce(attrs["style"], F.lit(""))
    unseen = F.coalesce(F.nullif(attrs["data-cv"], F.lit("")), F.lower(F.regexp_extract(style, r"(?i)content-visibility\s*:\s*([a-z]+)", 1))) == "hidden"
    lead = F.length(n["text"]) - F.length(F.regexp_replace(n["text"], rf"^[{BLANK}]+", ""))
    trail = F.length(n["text"]) - F.length(F.regexp_replace(n["text"], rf"[{BLANK}]+\z", ""))
    return F.struct(
        element.alias("element"),
        F.when(element, display_of(tag, attrs)).alias("declared"),
        (tag.isin(FORCE_BLOCK) | button_role).alias("forced"),
        (tag.isin("button", "label") | button_role).alias("button"),
        mark.alias("mark"),
        F.when(attrs.isNull(), False).otherwise(F.coalesce(unseen, F.lit(False))).alias("unseen"),
        F.when(element, self_skip(tag, attrs)).alias("skip"),
        F.when(attrs["lang"].isNotNull(), F.lower(text.trimmed(attrs["lang"]))).alias("lang"),
        F.when(element, landmark_of(tag, attrs)).alias("landmark"),
        hint_of(attrs).alias("hint"),
        F.coalesce(n["text"].rlike(rf"[^{BLANK}]"), F.lit(False)).alias("filled"),
        F.coalesce(lead, F.lit(0)).alias("lead"),
        F.coalesce(trail, F.lit(0)).alias("trail"),
    )


@dataclass
class Page:
    """Arrays over the nodes of one page: facts, the next and previous node with visible text, labels, and what comes from above."""

    nodes: Column
    facts: Column
    after: Column
    before: Column
    labels: Column
    above: Column

    def fact(self, i: Column, name: str) -> Column:
        return F.get(self.facts, i)[name]

    def node(self, i: Column, name: str) -> Column:
        return F.get(self.nodes, i)[name]

    def trimmed_units(self, i: Column) -> Column:
        """UTF-16 units of all text in a node's subtree, less the white space at its ends."""

        first, end = F.get(self.after, i), self.node(i, "last")
        last = F.get(self.before, end)
        inner = self.node(last, "units") - self.node(first - 1, "units") - self.fact(first, "lead") - self.fact(last, "trail")
        return F.when(first <= end, inner).otherwise(0)

    def only_text(self, i: Column) -> Column:
        """Whether all children are text: neighbouring texts are one node, so there is one at most."""
        last = self.node(i, "last")
        return (last == i) | ((last == i + 1) & (self.node(i + 1, "tag") == "#text"))


def display(page: Page, i: Column) -> Column:
    """Computed display: children of flex and grid containers become blocks."""
    own = page.fact(i, "declared")
    inside = F.coalesce(page.fact(page.node(i, "parent"), "declared").isin(FLEX), F.lit(False)) & inline(own) & (own != "contents")
    return F.when(inside & ~own.isin(FLEX), "block").when(inside, F.regexp_replace(own, "^inline-", "")).otherwise(own)


def label_of(page: Page, i: Column, target: Column) -> Column:
    """(disposition, the rule that decided it); the first that matches wins."""
    tag, f = page.node(i, "tag"), F.get(page.facts, i)
    is_hidden = (f["declared"] == "none") | f["unseen"]
    label = lambda disposition, rule: F.struct(F.lit(disposition).alias("disposition"), (rule if isinstance(rule, Column) else F.lit(rule)).alias("rule"))
    opaque = tag.isin(OPAQUE_TAGS)
    return (
        F.when((i == 0) | (tag == "#text"), label("WALK", F.when(i == 0, "walk").otherwise("text")))
        .when(tag == "#comment", label("SKIP_SUBTREE", "comment"))
        .when(f["mark"], label("SKIP_SUBTREE", "own-mark"))
        .when(tag.isin(SKIP_TAGS), label("SKIP_SUBTREE", "tag"))
        .when(opaque & (f["skip"].isNotNull() | is_hidden), label("SKIP_SUBTREE", "opaque-self"))
        .when((tag == "code") | (opaque & (F.get(page.after, i) <= page.node(i, "last"))), label("OPAQUE_INLINE", "opaque"))
        .when(f["skip"].isNotNull(), label("SKIP_SUBTREE", f["skip"]))
        .when(F.when(f["lang"].isNull(), False).otherwise(lang.already_target(f["lang"], target)), label("SKIP_SUBTREE", "already-target"))
        .when(is_hidden, label("SKIP_SUBTREE", "display"))
        .otherwise(label("WALK", "walk"))
    )


def from_above(own: Column, above: Column) -> Column:
    """Of two neighbouring stretches of a node's ancestors (itself included): the topmost node that isn't walked, whether any is skipped
    for good, and the nearest language, landmark and hint."""
    nearest = [F.coalesce(own[c], above[c]).alias(c) for c in ("lang", "landmark", "hint")]
    return F.struct(F.coalesce(above["top"], own["top"]).alias("top"), (own["gone"] | above["gone"]).alias("gone"), *nearest)


def with_steps(rows: DataFrame, steps: list[dict[str, Column]]) -> DataFrame:
    for step in steps:
        rows = rows.withColumns(step)
    return rows


@kept
def label_steps(target: str, display_of: DisplayOf) -> list[dict[str, Column]]:
    """The columns of Page, in the order in which they are made."""
    page, wanted = this_page(), F.lit(target)
    size = F.size("nodes")
    numbers = lambda other: F.transform("facts", lambda x, i: F.when(x["filled"], i).otherwise(other))

    def start(x: Column, i: Column) -> Column:
        own = F.get("labels", i)
        top = F.when(own["disposition"] != "WALK", i)
        gone = (own["disposition"] == "SKIP_SUBTREE") & (own["rule"] != "already-target")
        return F.struct(top.alias("top"), gone.alias("gone"), x["lang"].alias("lang"), x["landmark"].alias("landmark"), x["hint"].alias("hint"))

    return [
        {"facts": F.transform("nodes", lambda n: facts_of(n, display_of))},
        {"after": F.reverse(running(F.reverse(numbers(NEVER)), size, F.least)), "before": running(numbers(-1), size, F.greatest)},
        {"labels": F.transform("facts", lambda _, i: label_of(page, i, wanted))},
        {"above": climbed(F.transform("facts", start), parents(), depth(), from_above)},
    ]


def labelled(pages: DataFrame, target: str, display_of: DisplayOf = display_by_tag) -> DataFrame:
    """pages (with nodes) and the columns of Page."""
    return with_steps(pages, label_steps(target, display_of))


def this_page() -> Page:
    return Page(*map(F.col, ("nodes", "facts", "after", "before", "labels", "above")))


def parents() -> Column:
    return F.transform("nodes", lambda n: n["parent"])


def depth() -> Column:
    return F.array_max(F.transform("nodes", lambda n: n["depth"]))


@kept
def met_nodes() -> Column:
    page = this_page()
    own = lambda x, i: F.struct(page.node(i, "tag").alias("tag"), x["disposition"].alias("disposition"), x["rule"].alias("rule"))
    reached = lambda i: (i > 0) & F.get(page.above, page.node(i, "parent"))["top"].isNull()
    return F.filter(F.transform(page.labels, lambda x, i: F.when(reached(i), own(x, i))), lambda x: x.isNotNull())


def audit(labelled_pages: DataFrame) -> DataFrame:
    """(tag, disposition, rule) of every node that a walk from the body meets."""
    return labelled_pages.select(F.explode(met_nodes()).alias("x")).select("x.*")


@kept
def run_steps() -> list[dict[str, Column]]:
    """Runs and what they are made from, in the order in which they are made."""
    page = this_page()
    size = F.size("nodes")
    walked = lambda x, i: (i > 0) & x["element"] & F.get(page.above, i)["top"].isNull()

    def shallow(x: Column, i: Column) -> Column:  # a block by itself
        own = display(page, i)
        return F.when(walked(x, i) & (x["forced"] | ((own != "none") & ~inline(own))), 1).otherwise(0)

    def frame(x: Column, i: Column) -> Column:  # blocks that hold runs: not br, nor those that display: contents makes transparent
        own = F.get("blocks", i) > F.coalesce(F.get("blocks", i - 1), F.lit(0))
        below = F.get("blocks", page.node(i, "last")) > F.get("blocks", i)
        transparent = (display(page, i) == "contents") & ~x["forced"]
        return F.when(walked(x, i) & (page.node(i, "tag") != "br") & (own | below) & ~transparent, i)

    begun = total(F.transform("frames", lambda x: F.when(x.isNull(), 0).otherwise(1)), size)
    links = total(F.transform("nodes", lambda n, i: F.when(n["tag"] == "a", page.trimmed_units(i)).otherwise(0)), size)
    differs = lambda x, k: (F.get("pieces", k - 1)["owner"] != x["owner"]) | (F.get("pieces", k - 1)["begun"] != x["begun"])
    cut = F.transform("first", lambda at, r: F.slice("pieces", at + 1, F.coalesce(F.get("first", r + 1), F.size("pieces")) - at))
    return [
        {"blocks": total(F.transform("facts", shallow), size)},
        {"frames": F.transform("facts", frame)},
        {"owners": climbed(F.col("frames"), parents(), depth(), F.coalesce), "begun": begun, "links": links},
        {"pieces": pieces(page)},
        {"first": F.filter(F.transform("pieces", lambda x, k: F.when((k == 0) | differs(x, k), k)), lambda k: k.isNotNull())},
        {"runs": F.filter(F.transform(cut, lambda run: described(page, run)), lambda r: r["source"] != "")},
    ]


def runs(labelled_pages: DataFrame) -> DataFrame:
    """labelled_pages with runs: array of RUN, in document order; runs without visible text are left out."""
    return with_steps(labelled_pages, run_steps())


def pieces(page: Page) -> Column:
    """The texts and line breaks that are collected: (text, owner, begun: blocks begun by then, opaque: the opaque element around, place)."""

    def piece(x: Column, i: Column) -> Column:
        n, top, gone = x["nodes"], x["above"]["top"], x["above"]["gone"]
        opaque = F.when(F.get(page.labels, top)["disposition"] == "OPAQUE_INLINE", top)
        words = F.when((n["tag"] == "#text") & (n["text"] != "") & (top.isNull() | (opaque.isNotNull() & ~gone)), n["text"]).when((n["tag"] == "br") & top.isNull(), "\n")
        own = F.struct(words.alias("text"), x["owners"].alias("owner"), x["begun"].alias("begun"), opaque.alias("opaque"), n["place"].alias("place"))
        return F.when(n["tag"].isin("#text", "br") & words.isNotNull(), own)

    return F.filter(F.transform(F.arrays_zip("nodes", "above", "owners", "begun"), piece), lambda x: x.isNotNull() & x["owner"].isNotNull())


def described(page: Page, run: Column) -> Column:
    """A run's struct from its pieces."""

    def of(block: Column, source: Column) -> Column:
        last, only, above = page.node(block, "last"), page.only_text(block), F.get(page.above, block)
        spans = F.when(F.exists(run, lambda x: x["opaque"].isNotNull()), protected(page, run, source)).otherwise(F.array().cast(f"array<struct<{SPAN}>>"))
        values = [
            source, spans, above["lang"], above["landmark"], above["hint"], page.trimmed_units(block), F.get("links", last) - F.get("links", block), page.fact(block, "button"), only,
            F.get("blocks", last) > F.get("blocks", block), F.when(only, F.coalesce(page.node(block + 1, "text"), F.lit(""))), page.node(block, "tag"), page.node(block, "place").cast("string"), F.element_at(run, -1)["place"].cast("string"),
        ]
        return F.struct(*(v.alias(n) for n, v in zip(RUN_NAMES, values, strict=True)))

    joined = F.array_join(F.transform(run, lambda x: x["text"]), "")
    return let(F.get(run, F.lit(0))["owner"], lambda block: let(text.normalized(joined), lambda source: of(block, source)))


RUN_NAMES = ["source", "spans", *(x.split(":")[0].strip() for x in RUN.split(f"array<struct<{SPAN}>>, ")[1].split(","))]


def protected(page: Page, run: Column, source: Column) -> Column:
    """Spans of a run's opaque elements on its normalized text, in UTF-16 units.

    A place between two pieces falls, in the normalized text, on the sum of the pieces' own normalized lengths before it: white space on
    both sides of a joint is one character, and a place inside it is that character's.
    """
    blank_first = lambda x: x["text"].rlike(rf"^[{BLANK}]")
    blank_last = lambda x: x["text"].rlike(rf"[{BLANK}]\z")
    joint = F.transform(run, lambda x, k: F.when((k > 0) & blank_first(x) & blank_last(F.get(run, k - 1)), 1).otherwise(0))
    own = F.transform(run, lambda x, k: text.utf16_length(F.regexp_replace(x["text"], rf"[{BLANK}]+", " ")) - F.when(blank_first(x) & ((k == 0) | blank_last(F.get(run, k - 1))), 1).otherwise(0))
    differs = lambda x, k: F.coalesce(F.get(run, k)["opaque"] != x["opaque"], F.lit(True))
    begins = F.filter(F.transform(run, lambda x, k: F.when(x["opaque"].isNotNull() & differs(x, k - 1), k)), lambda k: k.isNotNull())
    ends = F.filter(F.transform(run, lambda x, k: F.when(x["opaque"].isNotNull() & differs(x, k + 1), k + 1)), lambda k: k.isNotNull())

    def mapped(joints: Column, sums: Column) -> Column:
        def at(k: Column) -> Column:
            return F.greatest(F.lit(0), F.least(text.utf16_length(source), F.coalesce(F.get(sums, k - 1), F.lit(0)) - F.coalesce(F.get(joints, k), F.lit(0))))

        return F.zip_with(begins, ends, lambda a, b: F.struct(at(a).alias("start"), at(b).alias("end"), page.node(F.get(run, a)["opaque"], "tag").alias("kind")))

    return let(joint, lambda j: let(total(own, F.size(run)), lambda s: mapped(j, s)))
