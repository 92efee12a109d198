"""Packing (operator 10): order-preserving dynamic programming over each partition's stream of tokens.

Every task turns its documents into ids, in order, and cuts the stream into sequences of at most `limit` ids. A cut may fall at a
document's end (free), at a sentence's end or, where neither comes in time, anywhere; the sum of padding and of the penalties for
cut documents is least. With f(j) the least cost up to boundary j at position p(j),

    f(j) = penalty(j) + limit - p(j) + min over i with p(j) - p(i) <= limit of (f(i) + p(i)),

so a monotone queue of f(i) + p(i) gives each step in constant time. Nothing is shuffled: a partition's last sequence is the only
one that ends early for it. Sequence ids carry the partition's number, so a task that runs again makes the same ids.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.llm.bpe import MAX_CACHED, tokenizer, tokenizer_path, words_of
from glossmill.llm.merges import Merger, coded
from glossmill.llm.shared import documents, give_back, slices

SENTENCE_PENALTY, WORD_PENALTY = 8, 64
BLOCK_IDS = 1 << 20


def cuts(positions: np.ndarray, penalties: np.ndarray, limit: int) -> list[int]:
    """Indices of the boundaries at which to cut, the last one included. positions rise by at most limit, from 0 excluded."""
    at, cost = [0, *positions.tolist()], [0, *penalties.tolist()]
    value = [0] * len(at)  # f(i) + p(i)
    back = [0] * len(at)
    queue: deque[int] = deque([0])
    for j in range(1, len(at)):
        while at[j] - at[queue[0]] > limit:
            queue.popleft()
        back[j] = best = queue[0]
        v = value[j] = value[best] + limit + cost[j]
        while queue and value[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    out, j = [], len(at) - 1
    while j:
        out.append(j - 1)
        j = back[j]
    return out[::-1]


def boundaries(ids: np.ndarray, ends: np.ndarray, sentence_end: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Where cuts may fall (after so many ids) and their penalties; ends: of the documents."""
    inner = np.flatnonzero(sentence_end[ids]) + 1
    inner = inner[~np.isin(inner, ends)]
    at = np.concatenate([ends, inner])
    cost = np.concatenate([np.zeros(len(ends), np.int64), np.full(len(inner), SENTENCE_PENALTY)])
    order = np.argsort(at, kind="stable")
    at, cost = at[order], cost[order]
    step = limit // 8
    gaps = np.diff(at, prepend=0)
    wide = np.flatnonzero(gaps > step)
    if wide.size:  # long stretches without a boundary can be cut every `step` ids
        extra = np.concatenate([np.arange(at[k] - gaps[k] + step, at[k], step) for k in wide])
        at = np.concatenate([at, extra])
        cost = np.concatenate([cost, np.full(len(extra), WORD_PENALTY)])
        order = np.argsort(at, kind="stable")
        at, cost = at[order], cost[order]
    return at, cost


class Ids:
    """Little-endian ids of whole texts, word by word from a bounded cache, or from the tokenizer where special tokens may occur."""

    def __init__(self, path: str) -> None:
        self.tokenizer = tokenizer(path)
        self.merger = Merger(self.tokenizer)
        self.cache: dict[str, bytes] = {}
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.sentence_end = np.zeros(max(names.values()) + 2, bool)
        self.sentence_end[[i for t, i in names.items() if t.removesuffix("</w>")[-1:] in (".", "!", "?")]] = True

    def of(self, texts: list[str]) -> list[bytes]:
        split = [words_of(self.tokenizer, t) for t in texts]
        wanted = set().union(*(words for words in split if words))
        if len(self.cache) > MAX_CACHED:
            self.cache.clear()
        new = list(wanted.difference(self.cache))
        words, ids, ends = coded(self.merger, self.tokenizer, new)
        raw = ids.astype("<u4").tobytes()
        ends = [4 * e for e in ends]
        self.cache.update(zip(words, map(raw.__getitem__, map(slice, [0, *ends], ends)), strict=True))
        return [
            np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if words is None else b"".join(map(self.cache.__getitem__, words))
            for t, words in zip(texts, split, strict=True)
        ]


_ids: dict[str, Ids] = {}


class Stream:
    """Documents of one partition on their way into sequences."""

    def __init__(self, limit: int, sentence_end: np.ndarray, first: int) -> None:
        self.limit, self.sentence_end, self.sequence = limit, sentence_end, first
        self.docs: list[tuple[int, int, int]] = []  # row number, ids before these, ids in all
        self.data: list[bytes] = []
        self.size = 0

    def add(self, row: int, data: bytes) -> None:
        self.docs.append((row, 0, len(data) // 4))
        self.data.append(data)
        self.size += len(data) // 4

    def flush(self, whole: bool) -> list[tuple[int, int, int, int, int, int, int]]:
        """Pieces of all sequences but the last, which stays for what follows; of all where `whole`."""
        if not self.docs:
            return []
        raw = b"".join(self.data)
        ids = np.frombuffer(raw, "<u4")
        ends = np.cumsum([len(d) // 4 for d in self.data])
        at, cost = boundaries(ids, ends, self.sentence_end, self.limit)
        stops = at[cuts(at, cost, self.limit)]
        if not whole:
            stops = stops[:-1]
        if not len(stops):
            return []
        upto = stops[-1]
        edges = np.unique(np.concatenate([ends[ends < upto], stops]))
        begins = np.concatenate([[0], edges[:-1]])
        which, seq = np.searchsorted(ends, begins, side="right"), np.searchsorted(stops, begins, side="right")
        seq_begin = np.concatenate([[0], stops[:-1]])
        out = []
        for b, e, d, q in zip(begins.tolist(), edges.tolist(), which.tolist(), seq.tolist(), strict=True):
            row, before, total = self.docs[d]
            doc_begin = int(ends[d]) - len(self.data[d]) // 4
            out.append((row, before + b - doc_begin, e - b, zlib.crc32(memoryview(raw)[4 * b : 4 * e]), total, self.sequence + q, b - int(seq_begin[q])))
        self.sequence += len(stops)
        keep = int(np.searchsorted(ends, upto, side="right"))
        docs, data = self.docs[keep:], self.data[keep:]
        if docs and (cut := int(upto - (ends[keep] - len(data[0]) // 4))):
            docs[0] = (docs[0][0], docs[0][1] + cut, docs[0][2])
            data[0] = data[0][4 * cut :]
        self.docs, self.data, self.size = docs, data, sum(map(len, data)) // 4
        return out


def pack(docs: DataFrame, path: str, limit: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all documents, each followed by end_id.

    Null or empty texts make a document of end_id alone. Ids may be null or repeat: each row is a document. Memory is bounded by
    BLOCK_IDS ids and the longest document.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    last = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _ids.setdefault(path, Ids(path)) if path not in _ids else _ids[path]
        stream = Stream(limit, coder.sentence_end, TaskContext.get().partitionId() << 33)
        keys: list = []

        def out(whole: bool) -> pa.RecordBatch:
            pieces = stream.flush(whole)
            columns = [pa.array([keys[p[0]] for p in pieces], kind)] + [pa.array([p[k] for p in pieces], pa.int64()) for k in range(1, 7)]
            kept = [keys[d[0]] for d in stream.docs]
            stream.docs = [(k, *d[1:]) for k, d in enumerate(stream.docs)]
            keys[:] = kept
            return pa.RecordBatch.from_arrays(columns, names)

        kind = pa.int64()
        for batch in batches:
            kind = batch.column(0).type
            for part in slices(batch, 200):
                for key, data in zip(part.column(0).to_pylist(), coder.of([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    keys.append(key)
                    stream.add(len(keys) - 1, data + last)
                if stream.size > BLOCK_IDS:
                    yield out(False)
        yield out(True)
        give_back()

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in names[1:]))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


QUERIES = {"op10_packing": op10_packing}
SQL: dict[str, str] = {}
