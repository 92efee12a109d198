"""Pages to segments: one vectorized helper turns HTML into a flat table of nodes; everything after it is Column expressions.

A map-only job: runs, order, ids and all decisions are made inside each page's array before it is exploded, so nothing is shuffled and
filters on what comes out stay above the work.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossmill.functions import lang, text
from glossmill.functions.kept import kept
from glossmill.functions.lang import let
from glossmill.operators import nodes
from glossmill.operators.html_tree import NODE, Nodes
from glossmill.sources.stored import spread

#: Characters from here on may change under NFC.
MAY_COMPOSE = r"[^\x{0}-\x{2FF}]"


def node_tables(pages: DataFrame) -> DataFrame:
    """page_id, page_lang (the html element's attribute) and nodes (array of html_tree.NODE) of each page; a null page has no body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                tables = Nodes()
                for html in part.column("html").to_pylist():
                    tables.add(html)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), pa.array(tables.langs, pa.string()), tables.arrow()], ["page_id", "page_lang", "nodes"])

    return spread(pages.select("page_id", "html"), "page_id", "html").mapInArrow(run, f"page_id long, page_lang string, nodes array<struct<{NODE}>>")


def sample_of(page: Column) -> Column:
    """The first 500 UTF-16 units of all text of a page; a character of two units that begins in the last one counts whole."""
    joined = F.array_join(F.transform(page, lambda n: F.coalesce(n["text"], F.lit(""))), "")
    # Two letters of the same kind stand for a character of two units.
    widened = F.regexp_replace(F.regexp_replace(F.substring(joined, 1, 500), r"[\p{IsHan}&&[\x{10000}-\x{10FFFF}]]", "\u4e00\u4e00"), r"[\x{10000}-\x{10FFFF}]", "xx")
    return F.substring(widened, 1, 500)


@F.pandas_udf(T.ArrayType(T.StringType()))
def composed(sources: pd.Series) -> pd.Series:
    """NFC of arrays of texts, which Spark has no function for; null arrays (pages where nothing may change) pass."""
    return sources.map(lambda own: None if own is None else [unicodedata.normalize("NFC", s) for s in own])


def region(landmark: Column, hint: Column, size: Column, links: Column) -> Column:
    """The nearest landmark, else chrome where its signs outweigh those of main content."""
    main = F.when(hint == "main", 2).otherwise(0) + F.when(size > 120, 2).otherwise(0)
    chrome = F.when(hint == "chrome", 2).otherwise(0) + F.when((size > 0) & (links / size > 0.5), 2).otherwise(0) + F.when(size < 40, 1).otherwise(0)
    return F.coalesce(landmark, F.when(chrome > main, "chrome").otherwise("main"))


def base36(n: Column) -> Column:
    return F.lower(F.conv(n.cast("string"), 10, 36))


def is_short_button(run: Column, units: Column) -> Column:
    return run["is_button_el"] & run["only_text_children"] & (units <= 20) & ~run["has_block_desc"]


def segment(run: Column, order: Column, nfc: Column, page_is_target: Column, target: Column, walk_id: int) -> Column:
    """A run's segment: identity, region, whether it is worth translating, kind and insert mode."""

    def of(units: Column, reason: Column) -> Column:
        kind = F.when(is_short_button(run, units), "button")
        mode = lang.insert_mode(F.coalesce(kind, F.lit("")), run["is_button_el"], run["anchor_tag"], run["eff_lang"], run["source"], run["only_text_children"], target)
        values = {
            "seg_id": F.concat(F.lit("k"), base36(F.lit(walk_id)), F.lit("-"), base36(order)), "order": order, "region": region(run["landmark"], run["hint"], run["block_text_len"], run["block_link_len"]),
            "source": run["source"], "state": F.when(reason.isNull(), "pending").otherwise("skipped"), "skip_reason": reason, "kind": kind, "insert_mode": mode, "char_count": units, "protected_spans": run["spans"],
            "eff_lang": run["eff_lang"], "anchor_path": run["anchor_path"], "anchor_tag": run["anchor_tag"], "ref_path": run["ref_path"], "only_text": run["only_text_children"],
            "replace_snapshot": F.when(mode == "replace", run["block_text"]), "block_text": run["block_text"],
        }
        return F.struct(*(v.alias(k) for k, v in values.items()))

    gated = let(text.gate_text(F.coalesce(F.get(nfc, order), run["source"])), lambda t: text.skip_reason(t, page_is_target))
    return let(text.utf16_length(run["source"]), lambda units: let(gated, lambda reason: of(units, reason)))


@kept
def gate_column(target: str) -> Column:
    sample = F.when(F.coalesce("page_lang", F.lit("")) == "", sample_of(F.col("nodes"))).otherwise("")
    return lang.page_is_target(F.col("page_lang"), sample, F.lit(target))


@kept
def composed_column() -> Column:
    return composed(F.when(F.exists("runs", lambda r: r["source"].rlike(MAY_COMPOSE)), F.transform("runs", lambda r: r["source"])))


@kept
def segment_column(target: str, walk_id: int) -> Column:
    return F.transform("runs", lambda r, i: segment(r, i, F.col("nfc"), F.col("page_is_target"), F.lit(target), walk_id))


def segments(pages: DataFrame, target: str = lang.DEFAULT_TARGET, walk_id: int = 1, display_of: nodes.DisplayOf = nodes.display_by_tag) -> DataFrame:
    """One row per segment of each page (page_id, html), in document order.

    display_of(tag, attributes) resolves styles. anchor_path and ref_path number nodes in document order, own marks passed over.
    """
    page = nodes.runs(nodes.labelled(node_tables(pages), target, display_of)).withColumn("page_is_target", gate_column(target)).select("page_id", "page_lang", "page_is_target", "runs")
    page = page.withColumn("nfc", composed_column())
    rows = page.select("page_id", "page_lang", "page_is_target", F.explode(segment_column(target, walk_id)).alias("s"))
    return rows.select("page_id", "s.*", "page_lang", "page_is_target")


def node_audit(pages: DataFrame, target: str = lang.DEFAULT_TARGET, display_of: nodes.DisplayOf = nodes.display_by_tag) -> DataFrame:
    """Number of nodes by tag, disposition and the rule that decided it, over all pages."""
    met = nodes.audit(nodes.labelled(node_tables(pages), target, display_of))
    return met.groupBy("tag", "disposition", "rule").agg(F.count("*").alias("n"))
