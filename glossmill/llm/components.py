"""Connected components of a large edge table, by alternating large-star and small-star steps (DataFrame joins only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.llm.shared import dropped, dropped_later, written


def stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step over rows (a, b), a > b. Neighbours move to the least node of the star; a hot node's rows meet only its minimum."""
    if large:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        moved = near.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
    return moved.filter("a <> b").distinct()


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node of `edges` (a, b: longs, in any direction) but the roots themselves; root: the component's least node."""
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while True:
        shape = now.agg(F.count("*").alias("n"), F.count_distinct("a").alias("nodes"), F.count_distinct("b").alias("roots")).first()
        roots = now.select(F.col("b").alias("a")).distinct()
        # Stars only: every node points at one root, and no root points anywhere.
        if shape.n == shape.nodes and not now.join(roots, "a", "left_semi").limit(1).count():
            return dropped_later(now).select(F.col("a").alias("node"), F.col("b").alias("root"))
        after = written(stars(stars(now, True), False), name)
        dropped(now)
        now = after
