"""Toxicity (operator 12): a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct n-grams of SIZES characters inside the words of a text, with a blank before and behind each word, hashed into
BUCKETS. On labelled rows each bucket gets a log ratio of its smoothed shares of toxic and of clean texts; a logistic regression is
fitted to features of that size, so that a text's score is a sum of products of ratio and coefficient, looked up by array in Arrow
batches. Both are fitted to at most MAX_FITTED labelled rows of each kind, chosen by hash; rows for which held_out() holds are never
among them. The fit's steps are taken on the driver (L-BFGS over the buckets that LEAST_ROWS rows have), the gradients come from tasks,
each of which sends the sum over its rows.

A null text counts as empty and gets the score of the model's constant alone. Ids may be null or repeat: every row is scored alone, a
null id is neither labelled nor held out, and of rows that share a labelled id one is fitted to. An id with several labels is toxic if
any says so. Without labels of both kinds every score is the toxic share of those there are, 0 without any. An empty table gives an
empty one; columns of any name are kept in `row`.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.llm.shared import dealt_documents, dropped, per_batch, written

BITS, SIZES = 18, (3, 4, 5, 6)
BUCKETS = 1 << BITS
MAX_FITTED, SMOOTHING, LEAST_ROWS = 4_000, 1.0, 5
#: Of the regression: the squared penalty, how much more a toxic row counts, its rounds and the gain at which it ends.
PENALTY, TOXIC_COUNTS, ROUNDS, LEAST_GAIN = 3e-3, 4.0, 50, 1e-5
THRESHOLD = 0.3

BASE, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


#: Characters that are worked on at a time; longer texts are cut at blanks, which no n-gram goes across.
PIECE = 1 << 20


def pieces(texts: pa.Array) -> Iterator[tuple[list[str], list[int]]]:
    """Texts in lower case, with blanks for what isn't a letter or digit and one before and behind, and the texts' numbers, in groups of
    about PIECE characters; a word is never cut."""
    group, owner, size = [], [], 0
    for k, text in enumerate(pc.utf8_lower(pc.replace_substring_regex(pc.fill_null(texts, ""), r"[^\pL\pN]+", " ")).to_pylist()):
        at = 0
        while at < len(text) or not at:
            cut = text.find(" ", at + PIECE) if len(text) - at > PIECE else -1
            end = len(text) if cut < 0 else cut
            group.append(f" {text[at:end]} ")
            owner.append(k)
            size, at = size + end - at, max(end, 1)
            if size >= PIECE:
                yield group, owner
                group, owner, size = [], [], 0
    yield group, owner


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every distinct n-gram of each text, the text's number)."""
    keys = [distinct_keys(*group) for group in pieces(texts)]
    key = keys[0] if len(keys) == 1 else np.unique(np.concatenate(keys))  # a text may go on in the next group
    return key % BUCKETS, key // BUCKETS


def distinct_keys(group: list[str], owner: list[int]) -> np.ndarray:
    """number * BUCKETS + bucket of every distinct n-gram of the numbered texts."""
    code = np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    blank = np.concatenate([[0], np.cumsum(code == 32)])
    text = np.repeat(np.array(owner, np.int64), [len(p) for p in group])
    found, h = [], code
    for n in range(2, max(SIZES) + 1):
        if len(code) < n:
            break
        h = h[:-1] * BASE + code[n - 1 :]
        if n in SIZES:
            # Words and the blanks around them: no blank inside. Neighbouring texts are told apart by two blanks.
            at = np.flatnonzero(blank[n - 1 : len(code)] == blank[1 : len(code) - n + 2])
            mixed = (h[at] ^ h[at] >> np.uint64(32)) * SPREAD + np.uint64(n)
            found.append(text[at] * BUCKETS + ((mixed ^ mixed >> np.uint64(29)) * SPREAD >> np.uint64(64 - BITS)).astype(np.int64))
    if not found:
        return np.zeros(0, np.int64)
    key = np.concatenate(found)
    # Distinct ones: of equal keys only the last written place holds its own number; keys that meet by chance are sorted out below.
    slot = np.empty(1 << max(10, (2 * len(key) - 1).bit_length()), np.int32)
    place = (key.astype(np.uint64) * BASE >> np.uint64(65 - len(slot).bit_length())).astype(np.int64)
    slot[place] = np.arange(len(key), dtype=np.int32)
    kept = slot[place]
    return np.concatenate([key[kept == np.arange(len(key))], np.unique(key[key != key[kept]])])


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are for judging the classifier: a fourth, by the checksum of the id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fitted_ids(labels: DataFrame, most: int = MAX_FITTED) -> tuple[DataFrame, dict[int, float]]:
    """(doc_id, toxic) of the labelled rows to fit, at most about `most` of each kind, and for each kind the rows that one stands for."""
    known = labels.filter("doc_id is not null and toxic is not null").filter(~held_out()).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    total = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    aim = (0.95 if most >= 10_000 else 0.9) * most
    shares = {k: 1.0 if n <= most else aim / n for k, n in total.items()}
    limit = F.lit(0)
    for k, share in shares.items():
        limit = F.when(F.col("toxic") == k, int(10**9 * share)).otherwise(limit)
    return known.filter(F.pmod(F.xxhash64("doc_id", F.lit("fitted")), F.lit(10**9)) < limit), {k: n / max(1.0, n * shares[k]) for k, n in total.items()}


def featured(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(toxic, grams) of the labelled rows to fit, one per id: that with the smallest checksum of its text."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, owner = grams(batch.column("text"))
        order = np.lexsort((found, owner))
        ends = np.searchsorted(owner[order], np.arange(batch.num_rows + 1))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found[order], pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), batch.column("h"), lists], ["doc_id", "toxic", "h", "grams"])

    own = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = per_batch(own.select("doc_id", "toxic", "h", "text"), make, "doc_id long, toxic int, h long, grams array<int>", 200)
    return rows.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min_by("grams", "h").alias("grams")).select("toxic", "grams")


def log_count_ratios(rows: DataFrame) -> np.ndarray:
    """For each bucket the log ratio of its shares of the features of toxic and of clean rows; 0 where fewer than LEAST_ROWS rows have it."""
    counted = rows.select("toxic", F.explode("grams").alias("b")).groupBy("b").agg(F.sum("toxic").alias("p"), F.count("*").alias("n")).toArrow()
    b, p, n = (counted.column(c).to_numpy() for c in ("b", "p", "n"))
    clean = n - p
    ratio = np.log((p + SMOOTHING) / (p.sum() + SMOOTHING * BUCKETS)) - np.log((clean + SMOOTHING) / (clean.sum() + SMOOTHING * BUCKETS))
    out = np.zeros(BUCKETS)
    out[b] = np.where(n >= LEAST_ROWS, ratio, 0.0)
    return out


def minimized(at: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, memory: int = 8) -> np.ndarray:
    """The least value of a smooth convex function, which gives (value, gradient), by limited-memory BFGS steps."""
    steps: deque[tuple[np.ndarray, np.ndarray]] = deque(maxlen=memory)
    value, slope = at(x)
    for _ in range(ROUNDS):
        way, parts = slope.copy(), []
        for dx, dg in reversed(steps):
            parts.append((dx @ way) / (dg @ dx))
            way -= parts[-1] * dg
        if steps:
            dx, dg = steps[-1]
            way *= (dx @ dg) / (dg @ dg)
        else:
            way /= max(1.0, float(np.linalg.norm(slope)))
        for (dx, dg), part in zip(steps, reversed(parts), strict=True):
            way += dx * (part - (dg @ way) / (dg @ dx))
        length, down = 1.0, float(slope @ way)
        while True:
            there, following = at(x - length * way)
            if there <= value - 1e-4 * length * down or length < 1e-6:
                break
            length /= 2
        gain, dx, dg = value - there, -length * way, following - slope
        if gain <= 0:
            break
        x, value, slope = x + dx, there, following
        if gain < LEAST_GAIN:
            break
        if dx @ dg > 1e-12:
            steps.append((dx, dg))
    return x


def gradient(rows: DataFrame, weights: np.ndarray, constant: float, counts: tuple[float, float]) -> tuple[float, np.ndarray, float]:
    """(logistic loss, its gradient by bucket and by the constant) of all rows, which count as `counts` says for clean and toxic ones.

    Every task sends the sums over its own rows.
    """
    sent = rows.sparkSession.sparkContext.broadcast(weights)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, by_constant, by_bucket = 0.0, 0.0, np.zeros(BUCKETS)
        for batch in batches:
            sizes = pc.list_value_length(batch.column("grams")).to_numpy(zero_copy_only=False)
            found, owner = batch.column("grams").flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), sizes)
            toxic = batch.column("toxic").to_numpy()
            count = np.where(toxic == 1, counts[1], counts[0])
            x = np.bincount(owner, sent.value[found], batch.num_rows) + constant
            loss += float(count @ (np.logaddexp(0, x) - toxic * x))
            wrong = count * (probability(x) - toxic)
            by_constant += float(wrong.sum())
            by_bucket += np.bincount(found, wrong[owner], BUCKETS)
        some = np.flatnonzero(by_bucket)
        numbers = pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), pa.array(some, pa.int32()))
        values = pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), pa.array(by_bucket[some]))
        yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([by_constant]), numbers, values], ["loss", "c", "b", "g"])

    parts = rows.mapInArrow(sums, "loss double, c double, b array<int>, g array<double>").toArrow()
    sent.unpersist()
    numbers, values = (pc.list_flatten(parts.column(c)).to_numpy() for c in ("b", "g"))
    return float(pc.sum(parts.column("loss")).as_py()), np.bincount(numbers, values, BUCKETS), float(pc.sum(parts.column("c")).as_py())


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_FITTED) -> tuple[np.ndarray, float]:
    """(weight of each bucket, constant). The features of the rows to fit are written once; each step of the regression is a job over them."""
    ids, stand = fitted_ids(labels, most)
    rows = written(featured(docs, ids), "featured")
    found = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(found) < 2:
        dropped(rows)
        return np.zeros(BUCKETS), math.inf if found.get(1) else -math.inf
    ratios = log_count_ratios(rows)
    kept = np.flatnonzero(ratios)
    counts = (stand[0], stand[1] * TOXIC_COUNTS)
    total = found[0] * counts[0] + found[1] * counts[1]

    def objective(x: np.ndarray) -> tuple[float, np.ndarray]:
        weights = np.zeros(BUCKETS)
        weights[kept] = x[:-1] * ratios[kept]
        loss, by_bucket, by_constant = gradient(rows, weights, float(x[-1]), (counts[0] / total, counts[1] / total))
        return loss + PENALTY / 2 * float(x[:-1] @ x[:-1]), np.append(by_bucket[kept] * ratios[kept] + PENALTY * x[:-1], by_constant)

    start = np.zeros(len(kept) + 1)
    start[-1] = math.log(found[1] * counts[1] / (found[0] * counts[0]))
    x = minimized(objective, start)
    dropped(rows)
    weights = np.zeros(BUCKETS)
    weights[kept] = x[:-1] * ratios[kept]
    return weights, float(x[-1])


def probability(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-x))


def scored(docs: DataFrame, weights: np.ndarray, constant: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (all columns of docs) and score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))
    work = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    schema = f"row {work.schema['row'].dataType.simpleString()}, score double"

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, owner = grams(batch.column("text"))
        total = np.bincount(owner, sent.value[found], batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.round(probability(total + constant), 6))], ["row", "score"])

    return per_batch(work, make, schema, 200)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """row (all columns of docs), score (0 to 1) and predicted (1 from the threshold on) of every row."""
    weights, constant = fit(docs, labels)
    return scored(docs, weights, constant).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = dealt_documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = toxicity(docs, labels.select("doc_id", "toxic"))
    return found.select("row.doc_id", held_out("row.doc_id").alias("held_out"), "score", "predicted")


QUERIES = {"op12_toxicity": op12_toxicity}
SQL: dict[str, str] = {}
