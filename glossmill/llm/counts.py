"""Token counts (operator 8): a map-side two-tier lookup of pre-token lengths.

Tier one is a compact hash table of the whole table's most frequent pre-tokens and their lengths in tokens, broadcast (max_pieces
bounds it). Tier two is each worker's cache, filled by exact merging. Pre-tokens are never shuffled, but for tasks' counts of them.

Texts are split into pre-tokens by a pattern where it is known to split as the tokenizer does, and by the tokenizer's own splitter
where a text has other characters; only texts with a string that may be a special token go through the tokenizer whole.

Null texts count as empty; ids may be null or repeat (equal rows get equal results); an empty table gives an empty one; only the id and
text columns are read, so other columns can't clash.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.llm.bpe import DIGITS, LETTERS, MAX_CACHED, MAX_PIECE, ODD, SPECIAL, frequent, library_pieces, tokenizer, tokenizer_path
from glossmill.llm.merges import Merger, coded
from glossmill.llm.shared import dealt_documents, per_batch, utf8

PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{DIGITS}]+| ?[^\\s{LETTERS}{DIGITS}]+|\\s+(?!\\S)|\\s+")


def pieces_of(own, text: str) -> list[str] | None:
    """The pre-tokens of a text, or None where special tokens may need the tokenizer itself."""
    if SPECIAL in text:
        return None
    return library_pieces(own, text) if ODD.search(text) else PIECE.findall(text)


def fingerprints(pieces: list[str]) -> np.ndarray:
    """A 64-bit hash of each piece's UTF-8, all pieces at once."""
    raw = [p.encode() for p in pieces]
    size = np.array([len(r) for r in raw], dtype=np.int64)
    data = np.frombuffer(b"".join(raw), "u1").astype(np.uint64)
    begin = np.cumsum(size) - size
    out = np.full(len(raw), 0xCBF29CE484222325, np.uint64)
    live, depth = np.arange(len(raw)), 0
    while (live := live[size[live] > depth]).size:
        out[live] = (out[live] ^ data[begin[live] + depth]) * np.uint64(0x100000001B3)
        depth += 1
    return out ^ out >> np.uint64(29)


class Lengths:
    """An open-addressing table from pieces to lengths. Slots hold a piece's number; its bytes are compared, so a hit is never wrong."""

    def __init__(self, pieces: list[str], lengths: list[int]) -> None:
        bits = max(4, int(np.ceil(np.log2(2 * len(pieces) + 1))))
        self.mask = (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        self.pieces = pieces
        self.lengths = np.array(lengths, np.uint16)
        for k, h in enumerate((fingerprints(pieces) & np.uint64(self.mask)).tolist()):
            while self.slots[h] >= 0:
                h = (h + 1) & self.mask
            self.slots[h] = k

    def find(self, pieces: list[str]) -> list[int]:
        """Lengths, 0 for those that it doesn't hold."""
        out = []
        for piece, h in zip(pieces, (fingerprints(pieces) & np.uint64(self.mask)).tolist(), strict=True):
            while (k := self.slots[h]) >= 0 and self.pieces[k] != piece:
                h = (h + 1) & self.mask
            out.append(int(self.lengths[k]) if k >= 0 else 0)
        return out


class Counter:
    def __init__(self, path: str, table: Lengths | None) -> None:
        self.tokenizer, self.table, self.cache = tokenizer(path), table, {}
        self.merger = Merger(self.tokenizer)

    def count(self, texts: list[str]) -> list[int]:
        split = [pieces_of(self.tokenizer, t) for t in texts]
        wanted = set().union(*(pieces for pieces in split if pieces))
        if len(self.cache) > MAX_CACHED:
            self.cache.clear()
        new = list(wanted.difference(self.cache))
        short, rest = [p for p in new if len(p) <= MAX_PIECE], [p for p in new if len(p) > MAX_PIECE]
        known = self.table.find(short) if self.table else [0] * len(short)
        self.cache.update((p, n) for p, n in zip(short, known, strict=True) if n)
        rest += [p for p, n in zip(short, known, strict=True) if not n]
        done, _, ends = coded(self.merger, self.tokenizer, rest)
        self.cache.update(zip(done, np.diff(ends, prepend=0).tolist(), strict=True))
        return [len(self.tokenizer.encode(t, add_special_tokens=False).ids) if p is None else sum(map(self.cache.__getitem__, p)) for t, p in zip(texts, split, strict=True)]


_counters: dict = {}


def token_counts(docs: DataFrame, path: str, max_pieces: int = 65_536, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every whole text (null: no tokens)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    own = tokenizer(path)
    pieces, _, ends = coded(Merger(own), own, frequent(rows, lambda text: pieces_of(tokenizer(path), text), max_pieces))
    table = Lengths(pieces, np.diff(ends, prepend=0).tolist())
    name = uuid.uuid4().hex
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        if (path, name) not in _counters:
            _counters.clear()
            _counters[path, name] = Counter(path, sent.value)
        texts = batch.column("text").to_pylist()
        n = _counters[path, name].count([t or "" for t in texts])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(utf8(t)) for t in texts], pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    counted = per_batch(rows, make, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(dealt_documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


QUERIES = {"op8_token_counts": op8_token_counts}
SQL: dict[str, str] = {}
