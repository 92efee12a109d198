"""Target-distribution importance resampling (operator 11): array-scored weights and a distributed radix selection.

Features are runs of 1 to 3 words in BUCKETS buckets of their CRC-32. A bucket's gain is the scaled log ratio of its smoothed share in
the target texts and in all rows; a row's weight is the sum of its features' gains, found by arrays in Arrow batches, and its score
adds Gumbel noise from its id, so that the highest scores are a draw without replacement. The k-th highest of the composite keys
(score, id) is found digit by digit: each round counts the rows that still may be the k-th by their next digit. Only the rows drawn are
then sorted by range and ranked.

What comes to the driver is one number a bucket and a bounded histogram a round. A null text has no words, hence weight 0; a null id
hashes as the empty string and ranks behind other ids of its score; rows with equal scores and ids are told apart by their number of
features, beyond which they are interchangeable; an empty table or target gives no draw or gains of the raw corpus alone; only the id
and text columns are read, so others can't clash.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.llm.shared import dealt_documents, dropped_later, hex_sha256, per_batch, written

BUCKETS, SEED, SHARE, LEAST_WORDS = 10_000, 42, 5, 20
#: Bits of a digit: a round's histogram has at most 2^DIGIT rows.
DIGIT = 16

_byte = np.arange(256)
#: Bytes that belong to words, and each byte in lower case.
IN_WORD = (_byte >= 0x80) | ((_byte >= 0x30) & (_byte <= 0x39)) | ((_byte >= 0x61) & (_byte <= 0x7A))
LOWER = np.where((_byte >= 0x41) & (_byte <= 0x5A), _byte + 32, _byte).astype(np.uint8)


def byte_table() -> np.ndarray:
    """The CRC-32 register after one byte, from the reflected polynomial."""
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, crc >> 1 ^ np.uint32(0xEDB88320), crc >> 1)
    return crc.astype(np.uint32)


TABLE = byte_table()
#: Words of up to SHORT bytes are hashed side by side; longer ones alone.
SHORT = 64


def zero_byte(crc: np.ndarray) -> np.ndarray:
    return TABLE[crc & 255] ^ crc >> np.uint32(8)


def looked_up(table: np.ndarray, crc: np.ndarray, row: np.ndarray | int = 0) -> np.ndarray:
    """A linear map of 32 bits, given by its values at each byte in each of the four places; row chooses among maps."""
    at = row * 1024
    flat = table.reshape(-1)
    return flat[at + (crc & 255)] ^ flat[at + 256 + (crc >> np.uint32(8) & 255)] ^ flat[at + 512 + (crc >> np.uint32(16) & 255)] ^ flat[at + 768 + (crc >> np.uint32(24))]


def shift_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """The maps of 0 to SHORT - 1 zero bytes, and those of SHORT times each power of two."""
    now = (np.arange(256, dtype=np.uint32)[None] << np.array([[0], [8], [16], [24]], np.uint32)).astype(np.uint32)
    small = []
    for _ in range(SHORT):
        small.append(now)
        now = zero_byte(now)
    powers = [now]
    for _ in range(25):
        powers.append(looked_up(powers[-1], powers[-1]))
    return np.stack(small), powers


SHIFTS, POWERS = shift_tables()


def shifted(crc: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The checksum's part in that of a text to which `sizes` bytes are appended: crc(a + b) = shifted(crc(a), len(b)) ^ crc(b)."""
    out = looked_up(SHIFTS, crc, sizes % SHORT)
    for k, table in enumerate(POWERS):
        more = np.flatnonzero(sizes // SHORT >> k & 1)
        if more.size:
            out[more] = looked_up(table, out[more])
        elif not (sizes // SHORT >> k).any():
            break
    return out


SPACE = np.uint32(zlib.crc32(b" "))


def word_checksums(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of each word: the k-th bytes of all short words at a time, longest words first."""
    out = np.zeros(len(starts), np.uint32)
    order = np.argsort(-np.minimum(sizes, SHORT + 1), kind="stable")
    long = int(np.count_nonzero(sizes > SHORT))
    for k in order[:long].tolist():
        out[k] = zlib.crc32(data[starts[k] : starts[k] + sizes[k]].tobytes())
    order = order[long:]
    live = np.searchsorted(-sizes[order], -np.arange(SHORT), "left")  # words with more than k bytes
    crc, at = np.full(len(order), 0xFFFFFFFF, np.uint32), starts[order]
    for k in range(SHORT):
        n = live[k]
        if not n:
            break
        crc[:n] = TABLE[(crc[:n] ^ data[at[:n] + k]) & 255] ^ crc[:n] >> np.uint32(8)
    out[order] = ~crc
    return out


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of every feature of all texts, its text's number, words of each text)."""
    raw = pc.fill_null(texts, "").cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    if not len(raw) or ends[-1] == ends[0]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(raw), np.int64)
    data = LOWER[np.frombuffer(raw.buffers()[2], np.uint8)[ends[0] : ends[-1]]]
    ends = ends - ends[0]
    inside = IN_WORD[data]
    edge = np.zeros(len(data) + 1, bool)  # a word neither begins before its text nor ends behind it
    edge[ends] = True
    before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1]
    after = np.concatenate([inside[1:], [False]]) & ~edge[1:]
    starts = np.flatnonzero(inside & ~before)
    sizes = np.flatnonzero(inside & ~after) + 1 - starts
    doc = np.searchsorted(ends, starts, "right") - 1
    one = word_checksums(data, starts, sizes)
    two = shifted(zero_byte(one[:-1]) ^ SPACE, sizes[1:]) ^ one[1:]
    three = shifted(zero_byte(two[:-1]) ^ SPACE, sizes[2:]) ^ one[2:]
    pairs, triples = doc[:-1] == doc[1:], doc[:-2] == doc[2:]
    buckets = np.concatenate([one, two[pairs], three[triples]]) % BUCKETS
    return buckets.astype(np.int64), np.concatenate([doc, doc[:-1][pairs], doc[:-2][triples]]), np.bincount(doc, minlength=len(raw))


def bucket_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How often each bucket occurs in all rows. A task adds up its own texts, so a row per bucket and task is shuffled."""

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                total += np.bincount(features(batch.slice(at, 200).column("text"))[0], minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["b", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[rows.column("b").to_numpy()] = rows.column("n").to_numpy()
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    all_raw, all_target = (float(x.sum() + BUCKETS) for x in (raw, target))
    return np.array([math.floor(1000 * math.log((t + 1.0) * all_raw / ((s + 1.0) * all_target))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features and weight of every row."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        buckets, doc, words = features(batch.column("text"))
        total = np.bincount(doc, gain[buckets], len(words)).astype(np.int64)  # sums of integers, far below 2^53
        n = words + np.maximum(words - 1, 0) + np.maximum(words - 2, 0)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(n, pa.int64()), pa.array(total, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return per_batch(rows, make, "doc_id long, n_words long, n_features long, weight long", 200)


def noise(id_col: str, seed: int) -> Column:
    """Gumbel noise in thousandths, from the hash of seed and id."""
    h = F.conv(F.substring(hex_sha256(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def kth_key(rows: DataFrame, fields: list[Column], k: int) -> Column:
    """True for the k first rows in ascending order of the fields (longs), and for those equal to the last of them in all fields.

    A radix selection from the highest digit down. A round counts the open rows by their next digit and takes the digit in which the
    k-th row lies: rows below are in, rows above are out, and the round's own stay open, until all of these are in.
    """
    below, open_ = F.lit(False), F.lit(True)
    for field in fields:
        least, most, n = rows.filter(open_).agg(F.min(field), F.max(field), F.count("*")).first()
        if n == k:
            return below | open_
        bits = ((least ^ most) & (1 << 64) - 1).bit_length()
        for place in range(-(-bits // DIGIT) - 1, -1, -1):
            # With its sign bit flipped a long has the order of its bits; those above `bits` are the same in all open rows.
            digit = F.shiftrightunsigned(field.bitwiseXOR(F.lit(-(1 << 63))), place * DIGIT).bitwiseAND((1 << DIGIT) - 1)
            counts = sorted(tuple(r) for r in rows.filter(open_).groupBy(digit.alias("d")).count().collect())
            for value, count in counts:
                if k <= count:
                    break
                k -= count
            below, open_ = below | (open_ & (digit < value)), open_ & (digit == value)
            if k == count:
                return below | open_
    return below | open_


def ranked(rows: DataFrame, fields: list[Column], most: int) -> DataFrame:
    """rows in ascending order of the fields with `rank` from 1; ranks above `most` are null. Rows move once, in ranges of the fields;
    their number in a range is written with them, and the ranges' sizes alone give what precedes each."""
    order = [f.alias(f"_f{k}") for k, f in enumerate(fields)]
    names = [f"_f{k}" for k in range(len(fields))]
    dealt = rows.select("*", *order).withColumn("_tie", F.monotonically_increasing_id())
    kept = dealt.repartitionByRange(*names, "_tie").sortWithinPartitions(*names, "_tie").withColumn("_at", F.monotonically_increasing_id()).drop(*names, "_tie")
    kept = dropped_later(written(kept, "drawn"))
    part = F.shiftright("_at", 33).alias("_part")
    sizes = sorted(tuple(r) for r in kept.groupBy(part).count().collect())
    offsets, done = [], 0
    for p, n in sizes:
        offsets.append((p, done))
        done += n
    table = rows.sparkSession.createDataFrame(offsets, "_part long, _before long")
    rank = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    placed = kept.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(table), "_part")
    return placed.withColumn("rank", F.when(rank <= most, rank)).select(*rows.columns, "rank")


def resampled(docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row: of the N rows with at least `least_words` words, the floor(share*N/100)
    highest scores are ranked."""
    gain = gains(bucket_counts(docs), bucket_counts(target))
    scored = weighted(docs, gain).withColumn("score", F.col("weight") + noise("doc_id", seed))
    scored = dropped_later(written(scored, "scored"))
    enough = F.col("n_words") >= least_words
    k = share * scored.filter(enough).count() // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    if not k:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    id_ = F.coalesce("doc_id", F.lit(0).cast("long"))
    fields = [F.bitwise_not("score"), F.col("doc_id").isNull().cast("long"), id_, F.bitwise_not("n_features")]
    drawn = enough & kth_key(scored.filter(enough).select("doc_id", "n_features", "score"), fields, k)
    rest = scored.filter(~drawn).select(*columns, F.lit(None).cast("long").alias("rank"))
    return rest.unionByName(ranked(scored.filter(drawn).select(*columns), fields, k))


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = dealt_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return resampled(docs.select("doc_id", "text"), target.select("text"))


SQL11 = r"""
with recursive bits as (
  select 0 as k, i as byte, i as c from range(256) r(i)
  union all
  select k + 1, byte, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from bits where k < 8),
crcs as (select list(c order by byte) as t from bits where k = 8),
texts as (select 0 as target, doc_id, text from documents union all select 1, item_id, text from benchmark),
words as (
  select target, doc_id, row_number() over () as row_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from texts),
features as (
  select row_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) as f
  from words),
counted as (select row_id, f, count(*) as n from features group by row_id, f),
forms as (select distinct f from counted),
coded as (
  select f, xor(list_reduce(list_concat([4294967295], list_transform(range(0, strlen(f)), lambda i: cast('0x' || substr(hex(encode(f)), 2 * i + 1, 2) as bigint))), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 as b
  from forms, crcs),
placed as (select target, counted.row_id, b, sum(n) as n from counted join coded using (f) join words using (row_id) group by all),
buckets as (select b, sum(case when target = 0 then n else 0 end) as s, sum(case when target = 1 then n else 0 end) as t from placed group by b),
totals as (select sum(s) as all_s, sum(t) as all_t from buckets),
gains as (select b, cast(floor(1000 * ln((t + 1)::double * (all_s + 10000)::double / ((s + 1)::double * (all_t + 10000)::double))) as bigint) as gain from buckets, totals),
weighed as (select row_id, sum(n) as n_features, sum(n * gain) as weight from placed join gains using (b) where target = 0 group by row_id),
scored as (
  select words.doc_id, len(w) as n_words, cast(coalesce(n_features, 0) as bigint) as n_features, cast(coalesce(weight, 0) as bigint) as weight,
    cast(coalesce(weight, 0) + floor(-1000 * ln(-ln((cast('0x' || substr(sha256('42:' || coalesce(cast(words.doc_id as varchar), '')), 1, 8) as bigint) + 0.5::double) / 4294967296::double))) as bigint) as score
  from words left join weighed using (row_id) where target = 0),
ranked as (select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id) as r, count(*) filter (n_words >= 20) over () as n from scored)
select doc_id, n_features, weight, score, case when n_words >= 20 and r <= 5 * n // 100 then r end as rank from ranked
"""

QUERIES = {"op11_importance_resample": op11_importance_resample}
SQL = {"op11_importance_resample": SQL11}
