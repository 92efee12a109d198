"""Sharding (operator 1): global byte-size prefix sums from per-partition totals, cut at equal targets.

Rows are put in order by range (only keys, sizes and checksums move), that order is written down, each partition's totals are added
up, and a row's place in the whole is its partition's offset plus a running sum inside the partition. Equal cuts of the total give
contiguous shards whose sizes differ from the target by less than one document. Only per-partition and per-shard totals are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossmill.llm.shared import documents, dropped_later, written

OVERHEAD = 16


def byte_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", overhead: int = OVERHEAD) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row, in order of doc_id (nulls first), then checksum and size.

    size: UTF-8 bytes of the text plus overhead (null text: overhead alone). A row goes to the shard that holds the middle of its
    bytes. Rows that tie in everything are interchangeable; a key that fills many partitions is split by row position. An empty
    table gives no rows; only the id and text columns are read, so other columns can't clash.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    ordered = sized.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange("doc_id", "text_crc32", "size", "_at")
    ordered = ordered.sortWithinPartitions("doc_id", "text_crc32", "size", "_at").withColumn("_part", F.spark_partition_id()).drop("_at")
    # Each written file is one range in order; the part number is a column, so later reads don't depend on how files are split.
    kept = dropped_later(written(ordered, "shards"))
    run = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = kept.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    offsets = totals.select("_part", F.coalesce(F.sum("_bytes").over(run), F.lit(0)).alias("_before"), F.sum("_bytes").over(Window.partitionBy()).alias("_total"))
    inside = Window.partitionBy("_part").orderBy("doc_id", "text_crc32", "size")
    placed = kept.withColumn("_end", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))).join(F.broadcast(offsets), "_part")
    middle = F.col("_before") + F.col("_end") - F.col("size") / 2
    placed = placed.withColumn("shard", F.least(F.floor(middle * shards / F.col("_total")), F.lit(shards - 1)).cast("int"))
    # The slot: rows of the shard in earlier partitions, plus the place inside this one.
    pairs = placed.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = pairs.select("shard", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_part", "shard").orderBy("doc_id", "text_crc32", "size")
    slotted = placed.withColumn("_k", F.row_number().over(within)).join(F.broadcast(base), ["_part", "shard"])
    return slotted.select("doc_id", "size", "text_crc32", "shard", (F.col("_base") + F.col("_k") - 1).cast("long").alias("slot"))


def op1_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = byte_shards(documents(spark, sf_dir), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


SQL1 = """
with recursive bits as (
  select 0 as k, i as byte, i as c from range(256) r(i)
  union all
  select k + 1, byte, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from bits where k < 8),
crcs as (select list(c order by byte) as t from bits where k = 8),
raw as (select doc_id, strlen(coalesce(text, '')) as n, hex(encode(coalesce(text, ''))) as h from documents),
sized as (
  select doc_id, n + 16 as size,
    xor(list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(h, '..'), lambda x: cast('0x' || x as bigint))), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) as text_crc32
  from raw, crcs),
placed as (select *, sum(size) over (order by doc_id nulls first, text_crc32, size rows unbounded preceding) as upto, sum(size) over () as total from sized),
sharded as (select *, cast(least(floor((upto - size / 2) * 40 / total), 39) as int) as shard from placed)
select doc_id, size, text_crc32, 'bytes' as law, shard, cast(row_number() over (partition by shard order by doc_id nulls first, text_crc32, size) - 1 as bigint) as slot, cast(null as int) as grown_shard
from sharded
"""

QUERIES = {"op1_byte_shards": op1_byte_shards}
SQL = {"op1_byte_shards": SQL1}
