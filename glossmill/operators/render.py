"""Bilingual pages: translations put back into the HTML, and what a page that was rendered or edited still needs."""

from __future__ import annotations

import html as escapes

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossmill.operators import html_tree as h
from glossmill.operators.translate import shown
from glossmill.sources.stored import spread

ITEM = "order: int, seg_id: string, anchor_path: string, insert_mode: string, source: string, text: string, snapshot: string"


def serialized(node: h.Node) -> str:
    out: list[str] = []
    stack: list[h.Node | str] = [node]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.tag == "#text":
            raw = n.parent is not None and n.parent.tag in ("script", "style")
            out.append(n.text if raw else escapes.escape(n.text, quote=False))
        elif n.tag == "#comment":
            out.append(f"<!--{n.text}-->")
        else:
            if n.tag != "#document":
                out.append(f"<{n.tag}{''.join(f' {k}="{escapes.escape(v)}"' for k, v in n.attrs.items())}>")
                if n.tag not in h.VOID:
                    stack.append(f"</{n.tag}>")
            stack.extend(reversed(n.children))
    return "".join(out)


def only_text(node: h.Node) -> bool:
    return all(c.tag == "#text" for c in node.children)


def render_page(page: str | None, items: list[dict]) -> str | None:
    """The page with its translations: a marked block after the anchor, or the anchor's own text replaced where it hasn't drifted.

    Anchors are places in document order; marks are put in at the end, each parent's children once, so work is linear in the page.
    """
    if page is None:
        return None
    top, body = h.parse(page)
    wanted = {int(i["anchor_path"]) for i in items}
    anchors: dict[int, h.Node] = {}
    for n, place in h.numbered(body):
        if place in wanted and not n.is_mark():
            anchors.setdefault(place, n)
    after: dict[h.Node, list[h.Node]] = {}
    for item in items:
        block = anchors.get(int(item["anchor_path"]))
        if block is None:
            continue
        if item["insert_mode"] == "replace":
            if only_text(block) and "".join(c.text for c in block.children) == item["snapshot"]:
                block.attrs[h.SOURCE_ATTR] = item["snapshot"]
                if "title" not in block.attrs and h.u16(item["source"]) <= 20:
                    block.attrs["title"] = item["source"]
                block.children = [h.Node("#text", text=item["text"], parent=block)]
            continue
        mark = h.Node("div", {"class": h.MARK_CLASS, h.MARK_ID: item["seg_id"]})
        mark.children = [h.Node("#text", text=item["text"], parent=mark)]
        after.setdefault(block, []).append(mark)
    for home in {b.parent for b in after if b is not body and b.parent is not None}:
        # Each mark goes right after its block, so of several the last comes first.
        home.children = [x for c in home.children for x in (c, *reversed(after.get(c, ())))]
    body.children += after.get(body, [])
    return serialized(top if top.tag == "#document" else top.parent or top)


def render(pages: DataFrame, segments: DataFrame) -> DataFrame:
    """pages (page_id, html) with the translations of their drafted segments; a page's segments meet it in one join by page."""
    drafts = shown(segments).groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("order").cast("int").alias("order"), "seg_id", "anchor_path", "insert_mode", "source", "text", F.col("replace_snapshot").alias("snapshot")))).alias("items")
    )
    joined = spread(pages.select("page_id", "html"), "page_id", "html").join(drafts, "page_id", "left")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                done = [render_page(page, items or []) for page, items in zip(part.column("html").to_pylist(), part.column("items").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), pa.array(done, pa.string())], ["page_id", "html"])

    return joined.mapInArrow(run, "page_id long, html string")


def occurrences(segments: DataFrame) -> DataFrame:
    """segments with `occurrence`: the how-many-th segment of its page with this source."""
    return segments.withColumn("occurrence", F.row_number().over(Window.partitionBy("page_id", "source").orderBy("order")))


def fresh(now: DataFrame, before: DataFrame) -> DataFrame:
    """Segments of a page's new version that its old one didn't have."""
    keys = ["page_id", "source", "occurrence"]
    return occurrences(now).join(occurrences(before).select(*keys), keys, "left_anti").drop("occurrence")


def drift(segments: DataFrame, now: DataFrame) -> DataFrame:
    """segments with `drifted`: whether the block at their anchor has other text by now, or no longer text alone, in the page's new
    version (now: its segments); such a block isn't replaced but collected again."""
    new = now.groupBy("page_id", "anchor_path").agg(F.max("block_text").alias("now_text"), F.bool_and("only_text").alias("now_only"))
    joined = segments.join(new, ["page_id", "anchor_path"], "left")
    same = F.coalesce(F.col("now_only") & (F.col("now_text") == F.coalesce("replace_snapshot", "block_text")), F.lit(False))
    return joined.withColumn("drifted", ~same).drop("now_text", "now_only")
