"""Byte-pair merging of many words at once: exact merge order, one array step for all words of a length.

A word's symbols stay in a row of a matrix with links to the neighbours still alive; each step merges the lowest-ranked pair (the
leftmost of equals) of every row. Ranks sit in an open-addressing table keyed by both symbols.
"""

from __future__ import annotations

import json

import numpy as np

NONE = np.int32(2**31 - 1)
LONGEST = 48


def byte_names() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else the next code from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Merger:
    """Merges words of at most LONGEST bytes as the model of a tokenizers.Tokenizer does; needs every byte in its vocabulary."""

    def __init__(self, tokenizer) -> None:
        model = json.loads(tokenizer.to_str())["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.inner = np.array([vocab[c] for c in byte_names()], np.int32)
        self.last = np.array([vocab[c + end] for c in byte_names()], np.int32)
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        self.bits = int(np.ceil(np.log2(len(keys) + 1))) + 3
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        for rank, (slot, key) in enumerate(zip(self.slot(keys).tolist(), keys.tolist(), strict=True)):
            while self.keys[slot] not in (-1, key):
                slot = (slot + 1) & ((1 << self.bits) - 1)
            if self.keys[slot] == -1:
                self.keys[slot], self.ranks[slot] = key, rank

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) << 32 | b
        slot = self.slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.ranks[slot], NONE)
        on = np.flatnonzero((there != keys) & (there != -1))
        while on.size:
            slot[on] = (slot[on] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[on]]
            hit = there == keys[on]
            out[on[hit]] = self.ranks[slot[on[hit]]]
            on = on[~hit & (there != -1)]
        return out

    def same_length(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of rows of bytes, concatenated, and how many each row has."""
        n, size = raw.shape
        symbols = np.zeros((n, size + 1), np.int32)
        symbols[:, :size] = self.inner[raw]
        symbols[:, size - 1] = self.last[raw[:, -1]]
        after = np.broadcast_to(np.arange(1, size + 2, dtype=np.int32), (n, size + 1)).copy()
        before = after - 2
        ranks = np.full((n, size + 1), NONE, np.int32)
        if size > 1:
            ranks[:, : size - 1] = self.rank(symbols[:, : size - 1].ravel(), symbols[:, 1:size].ravel()).reshape(n, size - 1)
        alive = np.ones((n, size), bool)
        rows = np.arange(n)
        while rows.size:
            at = ranks[rows].argmin(axis=1)
            best = ranks[rows, at]
            going = best < NONE
            rows, at, best = rows[going], at[going], best[going]
            if not rows.size:
                break
            gone = after[rows, at]
            following = after[rows, gone]
            symbols[rows, at] = self.made[best]
            after[rows, at] = following
            before[rows, np.minimum(following, size)] = at
            ranks[rows, gone] = NONE
            alive[rows, gone] = False
            inside = following < size
            ranks[rows, at] = NONE
            ranks[rows[inside], at[inside]] = self.rank(symbols[rows[inside], at[inside]], symbols[rows[inside], following[inside]])
            ahead = before[rows, at]
            some = ahead >= 0
            ranks[rows[some], ahead[some]] = self.rank(symbols[rows[some], ahead[some]], symbols[rows[some], at[some]])
        return symbols[:, :size][alive], alive.sum(axis=1)

    def merge(self, words: list[str]) -> tuple[list[str], np.ndarray, list[int]]:
        """(words by length, all their ids, where each one's end); words are not empty, without NUL, at most LONGEST bytes of UTF-8."""
        if not words:
            return [], np.zeros(0, np.int32), []
        data = np.frombuffer(("\0".join(words) + "\0").encode(), "u1")
        stops = np.flatnonzero(data == 0)
        starts = np.concatenate([[0], stops[:-1] + 1])
        sizes = stops - starts
        order = np.argsort(sizes, kind="stable")
        ids, counts = [], []
        edges = np.flatnonzero(np.diff(sizes[order], prepend=0, append=-1))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            for c in range(a, b, 8192):  # blocks that stay in the processor's cache
                rows = order[c : min(b, c + 8192)]
                own = self.same_length(data[starts[rows][:, None] + np.arange(sizes[rows[0]])])
                ids.append(own[0])
                counts.append(own[1])
        return [words[k] for k in order.tolist()], np.concatenate(ids), np.cumsum(np.concatenate(counts)).tolist()


def coded(merger: Merger, tokenizer, words: list[str]) -> tuple[list[str], np.ndarray, list[int]]:
    """(words, all their ids, where each one's end): short words merged together, long ones by the tokenizer's model."""
    long = [w for w in words if "\0" in w or (len(w) > LONGEST // 4 and len(w.encode()) > LONGEST)]
    if long:
        words = list(set(words).difference(long))
    ordered, ids, ends = merger.merge(words)
    if long:
        names = byte_names()
        own = [[t.id for t in tokenizer.model.tokenize("".join(map(names.__getitem__, w.encode())))] for w in long]
        more = len(ids) + np.cumsum([len(x) for x in own])
        ids = np.concatenate([ids, np.array([i for x in own for i in x], np.int32)])
        ordered, ends = ordered + long, ends + more.tolist()
    return ordered, ids, ends
