"""The order in which pending segments are sent: priority, eager heads, lazy tiers, admission by viewport. Windows over one page each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Pixels per bucket, eager segments per page, margins around the viewport.
BUCKET, EAGER, MARGINS = 300, 10, {"main": 1200, "chrome": 400}


def distance(top: Column, bottom: Column, height: Column) -> Column:
    """Distance of a block from the viewport: 0 where they meet, above and below otherwise."""
    return F.when(bottom < 0, -bottom).when(top > height, top - height).otherwise(0)


def open_segments(segments: DataFrame) -> DataFrame:
    return segments.filter((F.col("state") == "pending") & F.col("anchor_path").isNotNull())


def priority(segments: DataFrame) -> DataFrame:
    """Segments (page_id, order, region, distance) with `place`, the rank within the page: near before far, main before chrome."""
    d = F.when(F.col("distance").isNull() | F.isnan(F.col("distance").cast("double")) | (F.col("distance") < 0), 0).otherwise(F.col("distance"))
    keys = [F.when(d <= 0, 0).otherwise(1), F.when(F.col("region") == "chrome", 1).otherwise(0), F.when(d <= 0, 0).otherwise(F.floor(d / BUCKET)), F.col("order")]
    return segments.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy(*keys)))


def eager(segments: DataFrame, n: int = EAGER) -> DataFrame:
    """Segments with `eager`: the page's first n open ones that aren't chrome."""
    good = (F.col("state") == "pending") & (F.col("region") != "chrome")
    rank = F.row_number().over(Window.partitionBy("page_id", good).orderBy("order"))
    return segments.withColumn("eager", good & (rank <= n))


def lazy_tiers(segments: DataFrame, n: int = EAGER) -> DataFrame:
    """One row per block with an open segment that isn't eager: the region of its first open segment is its tier."""
    blocks = eager(open_segments(segments), n).groupBy("page_id", "anchor_path")
    return blocks.agg(F.bool_and("eager").alias("done"), F.min_by("region", "order").alias("tier"), F.count("*").alias("n_segments")).filter("not done").drop("done")


def admitted(blocks: DataFrame) -> DataFrame:
    """Blocks (tier, top, bottom, height) no further from the viewport than their tier's margin."""
    margin = F.when(F.col("tier") == "chrome", MARGINS["chrome"]).otherwise(MARGINS["main"])
    return blocks.filter(distance(F.col("top"), F.col("bottom"), F.col("height")) <= margin)


def ranked_again(segments: DataFrame, sent: DataFrame, distances: DataFrame) -> DataFrame:
    """Priority anew, from fresh distances (page_id, seg_id, distance), of the segments that aren't sent yet."""
    rest = segments.join(sent.select("page_id", "seg_id"), ["page_id", "seg_id"], "left_anti").drop("distance")
    return priority(rest.join(distances, ["page_id", "seg_id"], "left"))
