"""Substring deduplication (operator 5) by level-wise doubling of repeated word windows.

Windows of START words that occur again anywhere are extended to twice that length, and so on up to LENGTH words; only what is repeated
at one level is looked at on the next, and the loop ends early where nothing is. Below the last level a window of LENGTH words is
represented by its least-hashed inner window, the same one in every copy, so a fraction of the positions is counted. On the last level,
all but the first occurrence of a window (by doc_id, then position) mark their words as removed.

Documents with the same words as an earlier one need no windows: their first copy holds all of them. Occurrences are shuffled by hash;
repeats within a task's batch are settled there, so a hot window sends one row per batch. Lower levels compare windows by 64-bit hashes,
where a chance match only costs work; the last one by 128 bits.

Null texts have no words. Null ids come last; rows that share an id are ordered by a hash of their words, and rows equal in both are
one document. An empty table gives an empty one; cut_repeats keeps columns of any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.llm.shared import attach, dealt_documents, dropped, dropped_later, parted, per_batch, utf8, written
from glossmill.llm.shingles import fives, joined, mixed, word_hashes

LENGTH, START = 20, 5
LAST_ID = 2**63 - 1


def sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick (minimum or maximum) over each run of `width` values."""
    out, size = values, 1
    while 2 * size <= width:
        out, size = pick(out[: len(out) - size], out[size:]), 2 * size
    return pick(out[: len(values) - width + 1], out[width - size : width - size + len(values) - width + 1])


def widths() -> list[int]:
    """The levels: START, doubled up to LENGTH."""
    out = [START]
    while out[-1] < LENGTH:
        out.append(2 * out[-1])
    return out


class Windows:
    """The windows of a batch of texts, at every level."""

    def __init__(self, texts: list[bytes]) -> None:
        self.words, self.counts = word_hashes(texts)
        self.starts = np.cumsum(self.counts) - self.counts
        n = len(self.words)
        self.text = np.repeat(np.arange(len(texts)), self.counts)
        self.valid = self.text[: n - LENGTH + 1] == self.text[LENGTH - 1 :] if n >= LENGTH else np.zeros(0, bool)
        self.made: dict[int, np.ndarray] = {}

    def of(self, width: int) -> np.ndarray:
        """Hashes of the windows of `width` words from each position on, made of two of half the width."""
        if width not in self.made:
            half = self.of(width // 2) if width > START else None
            self.made[width] = doubled(half, width // 2) if half is not None else first_windows(self.words)
        return self.made[width]

    def check(self) -> np.ndarray:
        """Second hashes of the windows of LENGTH words."""
        out = first_windows(mixed(self.words ^ np.uint64(0x5851F42D4C957F2D)))
        for width in widths()[:-1]:
            out = doubled(out, width)
        return out

    def least(self, width: int) -> np.ndarray:
        """For each window of LENGTH words the least hash of its inner windows."""
        return sliding(self.of(width), LENGTH - width + 1, np.minimum) if len(self.valid) else np.zeros(0, np.uint64)

    def live(self, width: int, at: np.ndarray) -> np.ndarray:
        """Windows of LENGTH words that the inner windows at some positions stand for."""
        return self.valid & np.isin(self.least(width), np.unique(self.of(width)[at])) if len(self.valid) else self.valid

    def anchors(self, width: int, live: np.ndarray) -> np.ndarray:
        """Positions of inner windows that stand for some live window of LENGTH words."""
        if not len(live):
            return np.zeros(0, np.int64)
        reach = LENGTH - width
        none = np.zeros(reach, np.uint64)
        low = np.concatenate([none, np.where(live, self.least(width), 0), none])
        return np.flatnonzero(sliding(low, reach + 1, np.maximum) == self.of(width)) if reach else np.flatnonzero(live)

    def within(self, positions: np.ndarray) -> np.ndarray:
        return positions - self.starts[self.text[positions]]


def first_windows(words: np.ndarray) -> np.ndarray:
    five = fives(words)
    return five if START == 5 else doubled(five, 5)


def doubled(half: np.ndarray, width: int) -> np.ndarray:
    return joined(half[:-width], half[width:]) if len(half) > width else np.zeros(0, np.uint64)


SCHEMA = "key long, check long, doc long, tie long, pos int, state int"
#: State of an occurrence: alone in its batch, one of a repeated window that stands for the batch, settled there.
ALONE, STANDS, SETTLED = 0, 1, 2


def occurrences(hashes: np.ndarray, check: np.ndarray, doc: np.ndarray, tie: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """Rows of SCHEMA; the first of equal windows stands for the others, which are dealt out evenly."""
    order = np.lexsort((pos, tie, doc, check, hashes))
    h, check, doc, tie, pos = (x[order] for x in (hashes, check, doc, tie, pos))
    if len(h):  # equal rows are one document
        new = np.concatenate([[True], np.logical_or.reduce([x[1:] != x[:-1] for x in (h, check, doc, tie, pos)])])
        h, check, doc, tie, pos = (x[new] for x in (h, check, doc, tie, pos))
    same = (h[1:] == h[:-1]) & (check[1:] == check[:-1])
    first = np.concatenate([[True], ~same]) if len(h) else np.zeros(0, bool)
    again = np.concatenate([same, [False]]) if len(h) else np.zeros(0, bool)
    state = np.where(first, np.where(again, STANDS, ALONE), SETTLED).astype(np.int32)
    key = np.where(first, h.view(np.int64), h.view(np.int64) ^ (doc * 0x9E3779B1 + pos))
    columns = (key, check.view(np.int64), doc, tie, pos.astype(np.int32), state)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], SCHEMA.replace(" long", "").replace(" int", "").split(", "))


def picker(spare_first: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over rows in the order of windows: (doc, tie, pos) of those of repeated windows, or of all but each window's first one.

    Of the window that may go on in the next batch a single live row is carried over, however often the window occurs.
    """

    def groups(part: pa.Table, rows: np.ndarray) -> np.ndarray:
        """Where, among some rows, those of another window begin."""
        key, check = (part.column(c).to_numpy()[rows] for c in ("key", "check"))
        return np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (check[1:] != check[:-1])])) if len(rows) else np.zeros(0, np.int64)

    def places(part: pa.Table, keep: np.ndarray) -> pa.RecordBatch:
        rows = np.flatnonzero(keep)
        return pa.RecordBatch.from_arrays([pa.array(part.column(c).to_numpy()[rows]) for c in ("doc", "tie", "pos")], ["doc", "tie", "pos"])

    def later(part: pa.Table) -> np.ndarray:
        """All but each window's first occurrence; rows equal to it, of the same document, stay with it."""
        state = part.column("state").to_numpy()
        live = np.flatnonzero(state != SETTLED)
        starts = groups(part, live)
        keep = np.ones(len(state), bool)
        if len(live):
            place = [part.column(c).to_numpy()[live] for c in ("doc", "tie", "pos")]
            keep[live] = np.logical_or.reduce([p != np.repeat(p[starts], np.diff(starts, append=len(live))) for p in place])
        return keep

    def again(part: pa.Table, known: bool) -> np.ndarray:
        """Occurrences of windows that are repeated in part, or stand for such; known: the first row's window is."""
        state = part.column("state").to_numpy()
        keep = state == SETTLED
        live = np.flatnonzero(~keep)
        if len(live):
            starts, stands = groups(part, live), state[live] == STANDS
            stands[0] |= known
            sizes = np.diff(starts, append=len(live))
            keep[live] = np.repeat((sizes > 1) | np.logical_or.reduceat(stands, starts), sizes)
        return keep

    def pick_later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            if held.num_rows:
                tail = held.slice(int(groups(held, np.arange(held.num_rows))[-1]))
                yield places(held, later(held))
                live = np.flatnonzero(tail.column("state").to_numpy() != SETTLED)
                held = tail.slice(int(live[0]), 1) if live.size else None

    def pick_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried, known = None, False
        for batch in batches:
            part = pa.Table.from_batches([batch])
            if carried is not None:
                part = pa.concat_tables([carried, part]).combine_chunks()
            keep = again(part, known)
            live = np.flatnonzero(part.column("state").to_numpy() != SETTLED)
            done = known and carried is not None  # the first row has been given out
            if live.size:
                carried, known = part.slice(int(live[-1]), 1), bool(keep[live[-1]])
            if done:
                keep[0] = False
            yield places(part, keep)

    return pick_later if spare_first else pick_again


def settled(rows: DataFrame, spare_first: bool) -> DataFrame:
    """(doc, tie, pos) of the occurrences of repeated windows, without each window's first one where spare_first."""
    order = ["key", "check", "doc", "tie", "pos"] if spare_first else ["key", "check"]
    return rows.repartition("key").sortWithinPartitions(*order).mapInArrow(picker(spare_first), "doc long, tie long, pos int")


def chosen(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc, tie, text) of the documents in keys (doc, tie, ...), joined with keys; most others are dropped before the shuffle."""
    return parted(docs.select("doc", "tie", "text"), keys, "doc", "tie")[1].join(keys, ["doc", "tie"])


def as_binary(texts: pa.Array) -> list[bytes]:
    return [utf8(t) for t in texts.to_pylist()]


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, cut): one row for each of docs with doc_id, doc, tie, n_words, whole_sha256 and fate, and what is left of cut documents.

    fate: 'kept' whole, 'cut' (then cut has a row with doc, tie, n_removed, kept_sha256 and, if asked for, text) or 'removed' wholly.
    doc and tie identify a document; see keyed().
    """
    plain = keyed(docs, id_col, text_col)

    def describe(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = as_binary(batch.column("text"))
        words = [r.split() for r in raw]
        sha = [hashlib.sha256(b" ".join(w)) for w in words]
        made = [pa.array(map(len, words), pa.int64()), pa.array([x.digest()[:16] for x in sha], pa.binary()), pa.array([x.hexdigest() for x in sha])]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "doc", "tie")), *made], ["doc_id", "doc", "tie", "n_words", "fp", "whole_sha256"])

    kind = plain.schema["doc_id"].dataType.simpleString()
    rows = written(per_batch(plain, describe, f"doc_id {kind}, doc long, tie long, n_words long, fp binary, whole_sha256 string"), "substrings-rows")
    copies = rows.groupBy("fp").agg(F.min(F.struct("doc", "tie")).alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    marked = attach(rows, copies, "fp", "copies", rows.count())
    later = F.col("first").isNotNull() & ((F.col("first.doc") != F.col("doc")) | (F.col("first.tie") != F.col("tie")))
    marked = dropped_later(written(marked.select("doc_id", "doc", "tie", "n_words", "whole_sha256", (later & (F.col("n_words") >= LENGTH)).alias("later")), "substrings-marked"))
    dropped(rows)

    def level(width: int, before: int | None) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        """Occurrences of a level's windows; from the second level on, of those that places of the level before stand for."""

        def found(batch: pa.RecordBatch) -> pa.RecordBatch:
            w = Windows(as_binary(batch.column("text")))
            live = w.valid
            if before is not None:
                places = batch.column("places")
                owner = np.repeat(np.arange(batch.num_rows), np.array([len(p) for p in places], np.int64))
                live = w.live(before, places.flatten().to_numpy() + w.starts[owner])
            at = w.anchors(width, live)
            check = w.check()[at] if width == LENGTH and len(at) else np.zeros(len(at), np.uint64)
            doc, tie = (batch.column(c).to_numpy()[w.text[at]] for c in ("doc", "tie"))
            return occurrences(w.of(width)[at] if len(at) else np.zeros(0, np.uint64), check, doc, tie, w.within(at))

        return found

    gone = marked.filter("later").select("doc", "tie")
    places, before, texts_of = None, None, plain.select("doc", "tie", "text")
    for width in widths():
        repeated = settled(per_batch(texts_of, level(width, before), SCHEMA), spare_first=width == LENGTH)
        own = repeated.groupBy("doc", "tie").agg(F.collect_set("pos").alias("places"))  # at most a document's own positions
        now = written(own if width == LENGTH else own.join(gone, ["doc", "tie"], "left_anti"), f"substrings-{width}")
        if places is not None:
            dropped(places)
        places, before = now, width
        if width < LENGTH:
            if not places.limit(1).count():
                break
            texts_of = chosen(plain, places)
    marks = dropped_later(places)  # none at the last level where an earlier one ended the loop

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        removed, sha, left = [], [], []
        for text, places in zip(batch.column("text").to_pylist(), batch.column("places"), strict=True):
            words = utf8(text).split()
            at = places.values.to_numpy()
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + LENGTH, -1)
            gone = np.cumsum(edge[:-1]) > 0
            removed.append(int(gone.sum()))
            kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
            sha.append(hashlib.sha256(kept).hexdigest())
            left.append(without(text, gone) if texts else None)
        arrays = [batch.column("doc"), batch.column("tie"), pa.array(removed, pa.int64()), pa.array(sha), pa.array(left, pa.string())]
        return pa.RecordBatch.from_arrays(arrays, ["doc", "tie", "n_removed", "kept_sha256", "text"])

    done = per_batch(chosen(plain, marks), cut, "doc long, tie long, n_removed long, kept_sha256 string, text string").dropDuplicates(["doc", "tie"])
    fate = F.when(F.col("later"), "removed").when(F.col("hit"), "cut").otherwise("kept").alias("fate")
    fates = marked.join(marks.select("doc", "tie", F.lit(True).alias("hit")), ["doc", "tie"], "left").select(*marked.columns[:-1], fate)
    return fates, done


def without(text: str, gone: np.ndarray) -> str:
    """The text less its removed words; each kept word keeps the blanks before it."""
    import re

    pieces = re.findall("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+", text)
    return "".join(p for p, g in zip(pieces, gone.tolist(), strict=True) if not g).strip(" \t\n\x0b\f\r")


def keyed(docs: DataFrame, id_col: str, text_col: str, whole: bool = False) -> DataFrame:
    """doc_id, doc, tie, text, and row with all columns if `whole`.

    doc is the id (the largest long for null), and tie 0, or a hash of the words where ids repeat or are null.
    """
    row = [F.struct("*").alias("row")] if whole else []
    plain = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("doc"), F.col(text_col).alias("text"), *row)
    if plain.groupBy("doc").count().filter(f"count > 1 or doc = {LAST_ID}").limit(1).count():
        words = F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+", " ")
        tie = F.xxhash64(F.btrim(words))
    else:
        tie = F.lit(0).cast("long")
    return plain.select("doc_id", "doc", tie.alias("tie"), "text", *(["row"] if whole else []))


def cut_repeats(docs: DataFrame) -> DataFrame:
    """docs (with doc_id, text, n_chars) with repeated passages cut out of the texts; documents that lose every word go."""
    rows, cut = dedup(docs, texts=True)
    change = dropped_later(written(rows.filter("fate <> 'kept'").select("doc", "tie").distinct().join(cut.select("doc", "tie", F.col("text").alias("cut")), ["doc", "tie"], "left"), "substrings-change"))
    joined = keyed(docs, "doc_id", "text", whole=True).join(change.withColumn("hit", F.lit(True)), ["doc", "tie"], "left")
    left = joined.filter("hit is null or cut <> ''")  # a document removed wholly has no cut text
    changed = F.col("hit").isNotNull()
    new = {"text": F.when(changed, F.col("cut")).otherwise(F.col("row.text")), "n_chars": F.when(changed, F.length("cut").cast("long")).otherwise(F.col("row.n_chars"))}
    return left.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, cut = dedup(dealt_documents(spark, sf_dir))
    both = rows.join(cut.select("doc", "tie", "n_removed", "kept_sha256"), ["doc", "tie"], "left")
    removed = F.when(F.col("fate") == "removed", F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    sha = F.when(F.col("fate") == "removed", F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "whole_sha256"))
    return both.select("doc_id", "n_words", removed.alias("n_removed"), sha.alias("kept_sha256"))


QUERIES = {"op5_substring_dedup": op5_substring_dedup}
SQL = {
    "op5_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
  windows AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') AS s FROM d, LATERAL (SELECT unnest(range(1, len(w) - 18)) AS i)),
  later AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
  gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
  words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
  kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
  cut AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(cut.n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN cut USING (doc_id)""",
}
