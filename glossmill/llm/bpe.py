"""BPE encoding and decoding (operator 7) over a minimal acyclic transducer of frequent words.

The most frequent words of the whole table are compiled into a shared-suffix automaton whose arcs carry counts, so that a word's
path adds up to its rank, and ranks point at id sequences. The automaton travels as one bounded byte string (max_words is a
parameter), each worker maps it from a file of its own, and words outside it are merged exactly. The counts only decide which words
are looked up early, never a result.

Texts are split into words by a pattern where all their characters are ones for which it is known to split as the tokenizer does, and
by the tokenizer's own normaliser and splitter otherwise; either way each word goes through the automaton. Only texts with a string
that may be a special token go through the tokenizer whole.

Null texts count as empty; very long texts and words take linear or n log n work; ids may be null or repeat (equal rows get equal
results); an empty table gives an empty one; only the id and text columns are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.llm.merges import Merger, byte_names, coded
from glossmill.llm.shared import dealt_documents, give_back, most_frequent, per_batch, slices

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Characters other than those for which the patterns below split as the tokenizers do, and what special tokens begin with.
ODD = re.compile("[^\t-\r -~¡-įı-ſ‐-‧‰-⁞]")
SPECIAL = "<|"
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ſ"
DIGITS = "0-9²³¹¼½¾"
WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^\\s{LETTERS}{DIGITS}]+")
MAX_CACHED = 400_000
#: Characters of the longest pieces that are counted for a table of frequent ones.
MAX_PIECE = 64

_tokenizers: dict = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer(path: str):
    """The library's tokenizer, once per worker process."""
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.no_truncation()
        made.no_padding()
        _tokenizers[path] = made
    return _tokenizers[path]


#: Byte-level splitters write each byte as a printable stand-in; this writes it back.
PLAIN = str.maketrans({name: chr(byte) for byte, name in enumerate(byte_names())})


def library_pieces(own, text: str) -> list[str]:
    """The pieces that a tokenizer merges one by one, from its own normaliser and splitter."""
    normal = own.normalizer.normalize_str(text) if own.normalizer else text
    return [p.translate(PLAIN).encode("latin-1").decode() for p, _ in own.pre_tokenizer.pre_tokenize_str(normal)]


def words_of(own, text: str) -> list[str] | None:
    """The lower-cased words that the tokenizer merges one by one, or None where special tokens may need the tokenizer itself."""
    if SPECIAL in text:
        return None
    return library_pieces(own, text) if ODD.search(text) else WORD.findall(text.lower())


def frequent(df: DataFrame, split: Callable[[str], list[str] | None], max_pieces: int) -> list[str]:
    """The most frequent pieces of the column `text` over all rows, at most max_pieces of them, of at most MAX_PIECE characters.

    Tasks count the pieces of their own rows, up to MAX_CACHED at a time, and only those counts are shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def given() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["piece", "n"])
            seen.clear()
            return out

        for batch in batches:
            for part in slices(batch, 500):
                own: Counter[str] = Counter()
                for text in part.column("text").to_pylist():
                    own.update(split(text) or ())
                seen.update({p: n for p, n in own.items() if len(p) <= MAX_PIECE})
                if len(seen) > MAX_CACHED:
                    yield given()
        yield given()
        give_back()

    counted = df.select("text").filter("text is not null").mapInArrow(count, "piece string, n long")
    return most_frequent(counted.groupBy("piece").agg(F.sum("n").alias("n")), "piece", max_pieces, "frequent-pieces")


class Lexicon:
    """A minimal acyclic transducer from words to ranks, laid out in arrays that one mapped file holds."""

    def __init__(self, data: memoryview | bytes) -> None:
        head = np.frombuffer(data, "<i8", 6)
        at = head.nbytes
        parts = []
        for n, kind in zip(head, ("<i8", "<i4", "<i4", "u1", "<i8", "<u4"), strict=True):
            parts.append(np.frombuffer(data, kind, n, at))
            at += -(-parts[-1].nbytes // 8) * 8
        self.arcs, self.target, self.skip, self.final, self.starts, self.ids = parts

    @staticmethod
    def compile(words: list[str], ids: list[list[int]]) -> bytes:
        """Builds the automaton from sorted words, sharing equal suffix states as soon as they can't change any more."""
        pairs = sorted((w.encode(), i) for w, i in zip(words, ids, strict=True))
        states: list[list] = [[False, {}]]  # final, arcs: byte -> state
        register: dict[tuple, int] = {}
        path = [0]
        last = b""

        def settle(depth: int) -> None:
            while len(path) - 1 > depth:
                state = path.pop()
                key = (states[state][0], tuple(states[state][1].items()))
                states[path[-1]][1][last[len(path) - 1]] = register.setdefault(key, state)

        for word, _ in pairs:
            shared = 0
            while shared < min(len(word), len(last)) and word[shared] == last[shared]:
                shared += 1
            settle(shared)
            for byte in word[shared:]:
                states.append([False, {}])
                states[path[-1]][1][byte] = len(states) - 1
                path.append(len(states) - 1)
            states[path[-1]][0] = True
            last = word
        settle(0)
        number, order, below = {0: 0}, [0], {}
        for state in order:
            for to in states[state][1].values():
                if to not in number:
                    number[to] = len(order)
                    order.append(to)

        def words_below(state: int) -> int:
            stack = [state]
            while stack:
                top = stack[-1]
                rest = [x for x in states[top][1].values() if x not in below]
                if rest:
                    stack.extend(rest)
                else:
                    below[top] = states[top][0] + sum(below[x] for x in states[top][1].values())
                    stack.pop()
            return below[state]

        words_below(0)
        arcs = []
        for state in order:
            passed = int(states[state][0])
            for byte, to in sorted(states[state][1].items()):
                arcs.append((number[state] << 8 | byte, number[to], passed))
                passed += below[to]
        arcs.sort()
        table = np.array(arcs, dtype=np.int64).reshape(-1, 3)
        flat = [i for _, own in pairs for i in own]
        starts = np.cumsum([0, *(len(own) for _, own in pairs)])
        parts = [
            table[:, 0].astype("<i8"), table[:, 1].astype("<i4"), table[:, 2].astype("<i4"),
            np.array([states[s][0] for s in order], "u1"), starts.astype("<i8"), np.array(flat, "<u4"),
        ]
        body = b"".join(p.tobytes().ljust(-(-p.nbytes // 8) * 8, b"\0") for p in parts)
        return np.array([p.size for p in parts], "<i8").tobytes() + body

    def ranks(self, words: list[str]) -> np.ndarray:
        """The rank of each word, -1 for those outside; all words advance one byte at a time together."""
        raw = [w.encode() for w in words]
        size = np.array([len(r) for r in raw], dtype=np.int64)
        state, rank = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
        if not self.arcs.size or not raw:
            return np.full(len(raw), -1)
        data = np.frombuffer(b"".join(raw), "u1")
        begin = np.cumsum(size) - size
        live = np.arange(len(raw))
        depth = 0
        while (live := live[(size[live] > depth) & (state[live] >= 0)]).size:
            key = state[live] << 8 | data[begin[live] + depth]
            found = np.minimum(np.searchsorted(self.arcs, key), self.arcs.size - 1)
            hit = self.arcs[found] == key
            state[live] = np.where(hit, self.target[found], -1)
            rank[live] += self.skip[found]
            depth += 1
        good = (state >= 0) & (self.final[np.maximum(state, 0)] == 1)
        return np.where(good, rank, -1)

    def ids_of(self, rank: int) -> list[int]:
        return self.ids[self.starts[rank] : self.starts[rank + 1]].tolist()


_mapped: dict[str, Lexicon] = {}


def mapped(data: bytes, name: str) -> Lexicon:
    """The lexicon in this process, over a file that is mapped into memory; the file is unlinked once mapped."""
    if name not in _mapped:
        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            import mmap

            _mapped[name] = Lexicon(memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)))
    return _mapped[name]


class WordCoder:
    """Ids of words as decimal text and tokens, from the lexicon or else from the tokenizer; remembered up to a bound."""

    def __init__(self, path: str, lexicon: Lexicon | None = None) -> None:
        self.tokenizer, self.lexicon = tokenizer(path), lexicon
        self.merger = Merger(self.tokenizer)
        self.decimal: dict[str, str] = {}
        self.tokens: dict[str, str] = {}
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.digits = [str(i) for i in range(max(vocab.values()) + 1)]
        self.names = [""] * len(self.digits)
        for token, i in vocab.items():
            self.names[i] = token

    def learn(self, words: set[str]) -> None:
        new = list(words.difference(self.decimal))
        if not new:
            return
        if len(self.decimal) > MAX_CACHED:
            self.decimal.clear()
            self.tokens.clear()
            new = list(words)
        ranks = self.lexicon.ranks(new) if self.lexicon else np.full(len(new), -1)
        unseen = [w for w, r in zip(new, ranks.tolist(), strict=True) if r < 0]
        words, ids, ends = coded(self.merger, self.tokenizer, unseen)
        self.put(words, ids.tolist(), ends)
        for w, r in zip(new, ranks.tolist(), strict=True):
            if r >= 0:
                ids = self.lexicon.ids_of(r)
                self.put([w], ids, [len(ids)])

    def put(self, words: list[str], ids, ends: list[int]) -> None:
        """Remembers words whose ids are concatenated."""
        digits = list(map(self.digits.__getitem__, ids))
        names = list(map(self.names.__getitem__, ids))
        parts = list(map(slice, [0, *ends[:-1]], ends))
        self.decimal.update(zip(words, map(" ".join, map(digits.__getitem__, parts)), strict=True))
        self.tokens.update(zip(words, map(" ".join, map(names.__getitem__, parts)), strict=True))

    def code(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(number of ids, ids in decimal joined by spaces, decoded text) of each text."""
        split = [words_of(self.tokenizer, t) for t in texts]
        self.learn(set().union(*(words for words in split if words)))
        out = []
        for text, words in zip(texts, split, strict=True):
            if words is None:
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
                out.append((len(ids), " ".join(map(str, ids)), self.tokenizer.decode(ids, skip_special_tokens=False)))
            else:
                decimal = " ".join(map(self.decimal.__getitem__, words))
                out.append((decimal.count(" ") + 1 if decimal else 0, decimal, " ".join(map(self.tokens.__getitem__, words))))
        return out


_coders: dict[tuple[str, str], WordCoder] = {}


def bpe_codes(docs: DataFrame, path: str, max_words: int = 65_536, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (decimal, joined by spaces) and decoded of every whole text.

    The lexicon holds at most max_words words (a few MB); it is the only thing sent to all workers.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    own = tokenizer(path)
    words, ids, ends = coded(Merger(own), own, frequent(rows, lambda text: words_of(tokenizer(path), text), max_words))
    data = Lexicon.compile(words, [x.tolist() for x in np.split(ids, ends[:-1])] if words else [])
    name = hashlib.sha256(data).hexdigest()
    sent = docs.sparkSession.sparkContext.broadcast(data)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        if (path, name) not in _coders:
            _coders.clear()
            _coders[path, name] = WordCoder(path, mapped(sent.value, name))
        done = _coders[path, name].code([t or "" for t in batch.column("text").to_pylist()])
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string()), pa.array([d[2] for d in done], pa.string())],
            ["doc_id", "n_tokens", "ids", "decoded"],
        )

    return per_batch(rows, make, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids string, decoded string")


def op7_bpe_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_codes(dealt_documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op7_bpe_codes": op7_bpe_codes}
SQL: dict[str, str] = {}
