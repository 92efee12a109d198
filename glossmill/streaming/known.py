"""The table of what is known of each page, kept up by a stream: exactly once, bucket by bucket.

A batch of new page versions is compared with the versions before it, and then takes their place in its pages' buckets, which are
replaced whole by dynamic partition overwrite. Rows carry the number of the batch that wrote them, and a page keeps its version from
before the batch beside the new one: a batch that is run again, after a failure at whatever step, finds what it found before, so its
results and the table come out the same. A page without segments has a row of its own, so that every touched bucket is written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossmill.functions.lang import DEFAULT_TARGET
from glossmill.operators.extract import segments
from glossmill.operators.render import fresh
from glossmill.sources.stored import dropped, written

BUCKETS = 64


def bucket_of(key: str = "page_id", buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class KnownSegments:
    """The table of known segments at `path`, in folders by page bucket. columns: those of the segments that are kept."""

    def __init__(self, spark: SparkSession, path: str, columns: tuple[str, ...] = ("seg_id", "order", "source"), buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.columns, self.buckets = spark, path, columns, buckets

    def table(self, schema: T.StructType, touched: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets, whose folders alone are read."""
        if not self.exists():
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(self.path)
        return rows if touched is None else rows.filter(F.col("bucket").isin(touched))

    def exists(self) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def before(self, rows: DataFrame, number: int) -> DataFrame:
        """The versions of pages from before batch `number`; of those, the last."""
        older = rows.filter(F.col("batch") < number)
        last = F.max("batch").over(Window.partitionBy("page_id"))
        return older.withColumn("last", last).filter(F.col("batch") == F.col("last")).drop("last")

    def update(self, pages: DataFrame, number: int, sink: Callable[[DataFrame, int], None], target: str = DEFAULT_TARGET) -> None:
        """Hands sink the segments of a batch of pages (each once) that their versions before don't have, and takes in the batch."""
        page_rows = pages.select("page_id", bucket_of(buckets=self.buckets).alias("bucket")).distinct()
        touched = sorted(r.bucket for r in page_rows.select("bucket").distinct().collect())  # at most one for each bucket
        if not touched:
            return
        new = written(segments(pages, target).select("page_id", *self.columns), "new-versions")
        stamped = new.withColumns({"batch": F.lit(number).cast("long"), "bucket": bucket_of(buckets=self.buckets)})
        known = self.before(self.table(stamped.schema, touched), number)
        sink(fresh(new, known.filter("seg_id is not null").select(new.columns)), number)
        # A version is marked by a row without a segment, beside those of its segments.
        marks = page_rows.select("page_id", *(F.lit(None).cast(stamped.schema[c].dataType).alias(c) for c in self.columns), F.lit(number).cast("long").alias("batch"), "bucket")
        both = written(known.unionByName(stamped).unionByName(marks), "known-buckets")
        both.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        dropped(new, both)


def kept_up(pages: DataFrame, known: KnownSegments, sink: Callable[[DataFrame, int], None], folder: str):
    """Starts a stream of page versions that keeps `known` up, and hands sink what is new in each batch."""
    return pages.writeStream.foreachBatch(lambda batch, number: known.update(batch, number, sink)).option("checkpointLocation", folder).trigger(availableNow=True).start()
