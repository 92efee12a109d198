"""64-bit hashes of word windows for many texts at once, in numpy. Words are runs of anything but space and \\t to \\r."""

from __future__ import annotations

import numpy as np

_random = np.random.Generator(np.random.PCG64(20_240_229))
#: A random 64-bit value for each byte, and odd multipliers.
TABLE = _random.integers(0, 2**64, 256, dtype=np.uint64)
BASE, LEFT, RIGHT, WHOLE = (int(x) | 1 for x in _random.integers(0, 2**63, 4))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of all texts in order, number of words of each text)."""
    split = [t.split() for t in texts]
    counts = np.array([len(s) for s in split], np.int64)
    data = np.frombuffer(b" ".join([w for s in split for w in s]) + b" ", "u1")
    if not counts.sum():
        return np.zeros(0, np.uint64), counts
    stops = np.flatnonzero(data == 32)
    starts = np.concatenate([[0], stops[:-1] + 1])
    out = np.zeros(len(stops), np.uint64)
    sizes = stops - starts
    # Horner's rule over the k-th byte of all words that have one; words are short, so few rounds do nearly all.
    live, depth = np.arange(len(stops)), 0
    while live.size:
        out[live] = out[live] * np.uint64(BASE) + TABLE[data[starts[live] + depth]]
        depth += 1
        live = live[sizes[live] > depth]
        if depth == 24 and live.size:  # the few long words
            for k in live.tolist():
                h = int(out[k])
                for b in data[starts[k] + depth : stops[k]].tolist():
                    h = (h * BASE + int(TABLE[b])) & 0xFFFFFFFFFFFFFFFF
                out[k] = h
            break
    return mixed(out), counts


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of windows made of two adjacent ones of equal length."""
    return mixed(left * np.uint64(LEFT) + right * np.uint64(RIGHT))


def fives(words: np.ndarray) -> np.ndarray:
    """Hash of the window of five words from each position on (texts not told apart)."""
    if len(words) < 5:
        return np.zeros(0, np.uint64)
    two = joined(words[:-1], words[1:])
    four = joined(two[:-2], two[2:])
    return joined(four[:-1], words[4:])


def whole(words: np.ndarray) -> int:
    """Hash of a short sequence as one shingle."""
    h = len(words)
    for w in words.tolist():
        h = (h * WHOLE + w) & 0xFFFFFFFFFFFFFFFF
    return h


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Each text's sorted distinct 5-word shingles; of fewer words, the whole sequence as one; without words, none."""
    words, counts = word_hashes(texts)
    windows = fives(words)
    out, at = [], 0
    for n in counts.tolist():
        if n >= 5:
            own = np.sort(windows[at : at + n - 4])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        else:
            out.append(np.array([whole(words[at : at + n])] if n else [], np.uint64))
        at += n
    return out
