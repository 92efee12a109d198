"""What the corpus operators share: inputs, written intermediate tables, skew-safe lookups, columns that bypass pandas."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.sources.stored import dropped, dropped_later, shared_dir, spread, written  # noqa: F401  (operators take them from here)

#: A key with at least 1/HOT_SHARE of all rows is hot; there are at most HOT_SHARE such keys, so they may be broadcast.
HOT_SHARE = 512


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def dealt_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, over all cores where the table has fewer splits than there are cores; for operators that heed no order of rows."""
    return spread(documents(spark, sf_dir))


#: Bytes of texts that a slice holds, if it is more than one row: arrays made of a slice take some tens of times as much.
SLICE_BYTES = 2 << 20


def slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most `rows` rows and, as to its column `text`, about SLICE_BYTES or a single row."""
    at = batch.schema.get_field_index("text")
    sizes = None if at < 0 else np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < batch.num_rows:
        end = min(begin + rows, batch.num_rows)
        if sizes is not None:
            before = sizes[begin - 1] if begin else 0
            end = max(begin + 1, min(end, int(np.searchsorted(sizes, before + SLICE_BYTES, "right"))))
        yield batch.slice(begin, end - begin)
        begin = end


def per_batch(df: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table], schema: str, rows: int = 500) -> DataFrame:
    """Runs make over slices of Arrow batches, so a worker holds little in Python objects at a time, however long texts are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, rows):
                out = make(part)
                if isinstance(out, pa.Table):
                    yield from out.to_batches()
                else:
                    yield out
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Returns what a task has freed to the system: workers are kept for later tasks, beside which their memory counts."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def utf8(text: str | None) -> bytes:
    """UTF-8 of a text; null counts as empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def attach(df: DataFrame, table: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Left join of df with table, which has one row per key and in `weight` the number of df's rows with that key.

    Keys with at least total/HOT_SHARE rows (at most HOT_SHARE of them, hence a bounded broadcast) are looked up map-side;
    only the others are shuffled. Rows without a match get nulls.
    """
    least = max(2, total // HOT_SHARE)
    hot = table.filter(F.col(weight) >= least)
    cold = table.filter(F.col(weight) < least)
    names = [c for c in table.columns if c != key]
    mark = F.lit(True).alias("_hot")
    near = df.join(F.broadcast(hot.select("*", mark)), key, "left")
    found = near.filter("_hot").drop("_hot")
    rest = near.filter("_hot is null").drop("_hot", *names)
    return found.unionByName(rest.join(cold, key, "left"))


def hex_sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def most_frequent(counts: DataFrame, key: str, most: int, name: str) -> list:
    """The most frequent keys of counts (key, n): all those at or above a frequency level, the lowest that leaves at most `most` keys.

    A level is a 32nd of a doubling, so a histogram of a few hundred rows and at most `most` keys come to the driver.
    """
    level = F.floor(F.log2("n") * 32)
    table = written(counts.withColumn("level", level), name)
    total, least = 0, None
    for row in sorted(table.groupBy("level").agg(F.count("*").alias("keys")).collect(), reverse=True):
        total += row["keys"]
        if total > most:
            break
        least = row.level
    found = [] if least is None else [r[0] for r in table.filter(F.col("level") >= least).select(key).collect()]
    dropped(table)
    return sorted(found)


#: Words of a bit table that says which keys may be in a set; its size is fixed, a full one only filters less.
FILTER_WORDS = 1 << 19


def bit_of(*names: str) -> tuple[Column, Column]:
    """(number of the word, the one bit in it) of the key columns' hash in a bit table."""
    h = F.xxhash64(*names)
    bit = F.pmod(F.shiftright(h, 40), F.lit(64)).cast("int")
    return F.pmod(h, F.lit(FILTER_WORDS)).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), bit)


def bit_table(keys: DataFrame, *names: str) -> DataFrame:
    """(w, bits): the words of a bit table of the key columns' hashes, at most FILTER_WORDS rows."""
    word, bit = bit_of(*names)
    return keys.select(word.alias("w"), bit.alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits"))


def may_hold(keys: DataFrame, *names: str) -> np.ndarray:
    """A bit table of the key columns' hashes: FILTER_WORDS 64-bit words (4 MB), whatever the number of rows."""
    rows = bit_table(keys, *names).toArrow()
    table = np.zeros(FILTER_WORDS, np.int64)
    table[rows.column("w").to_numpy()] = rows.column("bits").to_numpy()
    return table


def parted(df: DataFrame, keys: DataFrame, *names: str) -> tuple[DataFrame, DataFrame]:
    """(rows of df whose key is surely not in keys, the others), by a bit table, before any shuffle; both have df's columns."""
    sent = df.sparkSession.sparkContext.broadcast(may_hold(keys, *names))
    hashed = df.withColumn("_h", F.xxhash64(*names))
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)

    def part(inside: bool) -> DataFrame:
        def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
            h = batch.column("_h").to_numpy()
            hit = (sent.value[h % FILTER_WORDS] >> ((h >> np.int64(40)) % 64)) & 1 == 1
            return batch.filter(pa.array(hit == inside)).drop_columns(["_h"])

        return per_batch(hashed, keep, schema, 10_000)

    return part(False), part(True)


def told_apart(df: DataFrame, keys: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """As parted(), for one key and without Python workers: the bit table's words are looked up in a bounded broadcast."""
    word, bit = bit_of(name)
    own = F.broadcast(bit_table(keys, name).withColumnsRenamed({"w": "_w", "bits": "_bits"}))
    looked = df.withColumns({"_w": word, "_bit": bit}).join(own, "_w", "left")
    inside = F.coalesce(F.col("_bits"), F.lit(0)).bitwiseAND(F.col("_bit")) != 0
    return looked.filter(~inside).select(df.columns), looked.filter(inside).select(df.columns)
