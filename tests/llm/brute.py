"""Plain restatements of what the queries return, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
DATA = "/root/testdata/sf0.001"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def components(rows: list[tuple]) -> list[tuple]:
    """(doc_id, n_shingles, component_id) of (doc_id, text) rows, all pairs compared."""
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    root = list(range(len(rows)))

    def find(k: int) -> int:
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least: dict[int, int] = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)]


def without_repeats(rows: list[tuple], length: int = 20) -> list[tuple]:
    """(doc_id, n_words, n_removed, kept_sha256); rows of distinct ids."""
    seen: set = set()
    out = []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            window = tuple(w[k : k + length])
            if window in seen:
                gone[k : k + length] = [True] * length
            seen.add(window)
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return sum(d[::2] + [2 * c - 9 * (c > 4) for c in d[1::2]]) % 10 == 0


PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(d := re.sub("[ -]", "", m)) <= 19 and luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def mod97(text: str) -> bool:
    plain = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def more_personal(text: str | None, lengths: dict[str, int]) -> list[tuple]:
    """All spans (start, kind, end), base and added ones, by start and kind."""
    text = text or ""
    base = [(m.start(), k, m.end()) for k, (_, p, good) in enumerate(PII) for m in re.finditer(p, text) if good(m[0])]
    ibans = "|".join(f"{c}[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for c, n in lengths.items())
    added = []
    for rank, pattern, words in [
        (4, f"(?<![A-Za-z0-9])(?:{ibans})(?![A-Za-z0-9])", None),
        (5, r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "ssn|social security|national id|identity"),
        (6, r"(?<![0-9+.-])[2-9][0-9]{2}[.-][0-9]{3}[.-][0-9]{4}(?![0-9.-])", "phone|tel|call|mobil|fax"),
    ]:
        last = 0
        for m in re.finditer(pattern, text):
            before = text[max(last, m.start() - 40) : m.start()].lower()
            if mod97(m[0]) if words is None else re.search(words, before):
                added.append((m.start(), rank, m.end()))
            last = m.end()
    free = [x for x in added if not any(a < x[2] and x[0] < b for a, _, b in base)]
    names = ["email", "ip", "card", "phone", "iban", "national_id", "local_phone"]
    return [(a, names[k], b) for a, k, b in sorted(base + free)]


def redacted(text: str | None, spans: list[tuple]) -> str | None:
    if not spans:
        return text
    out, at = [], 0
    for a, kind, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def personal(text: str | None) -> tuple:
    """(counts by kind, hash of the base spans)."""
    spans = sorted((m.start(), k, m.end()) for k, (_, p, good) in enumerate(PII) for m in re.finditer(p, text or "") if good(m[0]))
    n = Counter(k for _, k, _ in spans)
    return *(n[k] for k in range(4)), sha(",".join(f"{PII[k][0]}:{a}:{b}" for a, k, b in spans))


def quality(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    w = WORD.findall(text or "")
    windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    n = Counter(windows)
    covered = {p for k, x in enumerate(windows) if n[x] > 1 for p in range(k, k + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def xx(data: bytes, seed: int = 42) -> int:
    import xxhash

    h = xxhash.xxh64_intdigest(data, seed=seed & (2**64 - 1))
    return h - 2**64 if h >> 63 else h


def log_ratio_scores(rows: list[tuple], trusted: set, buckets: int) -> list[float]:
    """Mean log ratio of the words and word pairs of each (doc_id, text)."""
    import math

    grams = []
    for _, text in rows:
        own = [xx(w.encode()) for w in WORD.findall(text or "")]
        pairs = [xx(b.to_bytes(8, "little", signed=True), xx(a.to_bytes(8, "little", signed=True))) for a, b in zip(own, own[1:])]
        grams.append([h % buckets for h in own + pairs])
    raw, target = Counter(), Counter()
    for (i, _), own in zip(rows, grams, strict=True):
        raw.update(own)
        if i in trusted:
            target.update(own)
    n, m = raw.total(), target.total()
    ratio = lambda b: round(math.log((target[b] + 1) / (m + buckets)) - math.log((raw[b] + 1) / (n + buckets)), 6) if m else 0.0
    return [sum(map(ratio, own)) / len(own) if own else 0.0 for own in grams]


ASSIGN = re.compile(r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def secret_base(text: str | None) -> tuple:
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    n = Counter(k for _, k, _ in spans)
    names = ("assign", "access", "hex")
    return *(n[k] for k in range(3)), sha(",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(spans)))


def media_row(text: str | None) -> tuple:
    """What op9 returns for a text but its id: sizes and sums of the payload and of the stored PGM, and the feature, cell by cell."""
    import io
    import zlib

    import numpy as np

    raw = (text or "").encode()
    payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
    stored = b"P5\n64 %d\n255\n" % (len(payload) // 64) + payload
    grid = np.frombuffer(payload, "u1").reshape(-1, 64).astype(float)

    def mean(top: float, bottom: float, left: float, right: float) -> float:
        """Mean over a rectangle with fractional edges."""
        rows = np.clip(np.minimum(np.arange(len(grid)) + 1, bottom) - np.maximum(np.arange(len(grid)), top), 0, None)
        columns = np.clip(np.minimum(np.arange(64) + 1, right) - np.maximum(np.arange(64), left), 0, None)
        return float(rows @ grid @ columns) / ((bottom - top) * (right - left))

    def tile(height: int, width: int) -> list[list[float]]:
        h, w = len(grid) / height, 64 / width
        return [[mean(a * h, (a + 1) * h, b * w, (b + 1) * w) for b in range(width)] for a in range(height)]

    marks = "".join("1" if round(a, 6) < round(b, 6) else "0" for row in tile(8, 9) for a, b in zip(row, row[1:]))
    out = io.BytesIO()
    np.save(out, np.round(np.array(tile(16, 16))).astype("u1"))
    feature = f"{int(marks, 2):016x}:{zlib.crc32(out.getvalue())}"
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature
