"""HTML to a flat table of nodes, the one per-row helper of the page jobs. What nodes mean is decided in Columns (nodes.py)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa

# HTML's void elements and the elements that an opening tag closes.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
CLOSES_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr"}, "th": {"tr"}, "option": {"select"}}
P_STOPS = set("button td th table div li body article section nav footer header main aside".split())
CELLS = ("td", "th", "table", "button")
INLINE_TAGS = set("span a em strong b i u s small sup sub mark abbr q cite dfn var samp kbd bdi bdo wbr ruby font tt ins del".split())
#: Names of the marks that rendering leaves and collection skips; parameters of the jobs.
MARK_CLASS, MARK_ID, SOURCE_ATTR = "gm-translation", "data-gm-id", "data-gm-source"
#: Attributes that the rules read; the others stay in the page.
KEPT = {"class", "id", "role", "lang", "hidden", "aria-hidden", "contenteditable", "translate", "style", "data-d", "data-cv", MARK_ID, SOURCE_ATTR}


@dataclass(eq=False)
class Node:
    """An element (tag), a text ('#text') or a comment ('#comment')."""

    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    text: str = ""
    children: list[Node] = field(default_factory=list)
    parent: Node | None = None

    def is_mark(self) -> bool:
        return bool(self.attrs) and MARK_CLASS in (self.attrs.get("class") or "").split()


class Builder(HTMLParser):
    """Builds the tree. What an end tag or an opening tag closes is the nearest open element of some tags before a stop; as the open
    places of each tag are kept apart, finding it takes as long at any depth."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#document")
        self.stack = [self.root]
        self.open: dict[str, list[int]] = {}

    def put(self, node: Node) -> None:
        node.parent = self.stack[-1]
        self.stack[-1].children.append(node)

    def nearest(self, tags: Iterable[str]) -> int:
        """Place of the innermost open element that has one of the tags; 0 if there is none."""
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=0)

    def close_from(self, place: int) -> None:
        for node in self.stack[place:]:
            self.open[node.tag].pop()
        del self.stack[place:]

    def close_to(self, names: Iterable[str], stops: Iterable[str]) -> None:
        """Closes the innermost open element of names, unless one of stops is further in."""
        place = self.nearest(names)
        if place and place >= self.nearest(stops):
            self.close_from(place)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "html" and self.open.get("html"):
            return
        if tag in CLOSES_P:
            self.close_to(("p",), P_STOPS - {tag})
        if tag in SIBLINGS:
            self.close_to(SIBLINGS[tag], SCOPES[tag])
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)})
        self.put(node)
        if tag not in VOID:
            self.open.setdefault(tag, []).append(len(self.stack))
            self.stack.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("body", "html"):
            return
        if tag == "br":
            self.handle_starttag("br", [])
            return
        self.close_to((tag,), CELLS if tag in INLINE_TAGS or tag == "p" else ())

    def handle_data(self, data: str) -> None:
        last = self.stack[-1].children[-1:] if self.stack[-1].children else []
        if last and last[0].tag == "#text":
            last[0].text += data
        else:
            self.put(Node("#text", text=data))

    def handle_comment(self, data: str) -> None:
        self.put(Node("#comment", text=data))

    def handle_pi(self, data: str) -> None:
        self.put(Node("#comment", text=data))


def parse(html: str | None) -> tuple[Node, Node]:
    """(html element or document, body); a fragment becomes the body's content."""
    builder = Builder()
    builder.feed(html or "")
    builder.close()
    top = next((n for n in builder.root.children if n.tag == "html"), builder.root)
    body = next((n for n in top.children if n.tag == "body"), None)
    if body is None:
        body = Node("body", parent=top)
        for n in top.children:
            if n.tag != "head":
                n.parent = body
                body.children.append(n)
        top.children = [n for n in top.children if n.tag == "head"] + [body]
    return top, body


def u16(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) // 2


def numbered(body: Node) -> Iterator[tuple[Node, int]]:
    """The nodes from the body on in document order, each with its place: its number, where marks and all in them are passed over."""
    place, stack = 0, [(body, False)]
    while stack:
        n, marked = stack.pop()
        marked = marked or n.is_mark()
        yield n, place
        place += not marked
        stack.extend((c, marked) for c in reversed(n.children))


#: A node: its parent's and its last descendant's numbers, depth, place, tag, units (UTF-16, of all texts up to it), text and attributes.
NODE = "parent: int, last: int, depth: int, place: int, units: int, tag: string, text: string, attrs: map<string,string>"


class Nodes:
    """Node tables of pages, as Arrow columns. Number 0 is the html element, 1 the body; what is outside the body isn't listed."""

    def __init__(self) -> None:
        self.ends = [0]
        self.rows: dict[str, list] = {c: [] for c in ("parent", "last", "depth", "place", "units", "tag", "text")}
        self.keys: list[str] = []
        self.values: list[str] = []
        self.attr_ends: list[int | None] = [0]
        self.langs: list[str | None] = []

    def add(self, html: str | None) -> None:
        top, body = parse(html)
        self.langs.append(top.attrs.get("lang"))
        first, units, number = len(self.rows["tag"]), 0, {top: 0}
        self.put(0, 0, 0, 0, "html", None, top.attrs)
        if html is not None:
            for n, place in numbered(body):
                up = number[n.parent] if n.parent is not None else 0
                number[n] = len(self.rows["tag"]) - first
                is_text = n.tag == "#text"
                units += u16(n.text) if is_text else 0
                self.put(up, self.rows["depth"][first + up] + 1, place, units, n.tag, n.text if is_text else None, n.attrs)
        last = list(range(len(self.rows["tag"]) - first))
        for k in range(len(last) - 1, 0, -1):
            up = self.rows["parent"][first + k]
            last[up] = max(last[up], last[k])
        self.rows["last"] += last
        self.ends.append(len(self.rows["tag"]))

    def put(self, parent: int, depth: int, place: int, units: int, tag: str, text: str | None, attrs: dict[str, str]) -> None:
        for c, value in (("parent", parent), ("depth", depth), ("place", place), ("units", units), ("tag", tag), ("text", text)):
            self.rows[c].append(value)
        for k, v in attrs.items():
            if k in KEPT:
                self.keys.append(k)
                self.values.append(v)
        self.attr_ends.append(len(self.keys))

    def arrow(self) -> pa.Array:
        ends = self.attr_ends
        bare = pa.array([a == b for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.bool_())
        attrs = pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(self.keys, pa.string()), pa.array(self.values, pa.string()), mask=bare)
        numbers = ["parent", "last", "depth", "place", "units"]
        columns = [pa.array(self.rows[c], pa.int32()) for c in numbers] + [pa.array(self.rows[c], pa.string()) for c in ("tag", "text")] + [attrs]
        return pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), pa.StructArray.from_arrays(columns, [*numbers, "tag", "text", "attrs"]))
