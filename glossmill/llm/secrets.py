"""Secret scans (operator 6): patterns, and a battery of randomness tests under length-aware false-discovery control.

Tokens of at least LONG characters that no pattern explains are tested in their inferred encoding (shorter ones can't reach
significance): chi-squared uniformity of the alphabet, runs of character classes, serial correlation. Each test is read twice.

* As a draw from the alphabet: the three p-values are joined by Fisher's method. A token that fails is no candidate; its long parts
  between =, / or - and _ are tested in its place.
* As ordinary text: the chance that text with the corpus's own rate of class switches, repeats of characters and serial correlation
  (measured over all rows) looks as random. Bounds of Chernoff and Hoeffding, in logarithms, give each test's p-value at any length;
  Bonferroni's rule joins the three, which depend on each other.

Benjamini-Hochberg's rule on the second, joined p-value, per length class and over the whole corpus, makes findings of candidates. It
needs a fixed number of counts only. Work is linear in a text, whatever its tokens' lengths.

Null texts count as empty; ids may be null or repeat (equal rows get equal results); an empty table gives an empty one; only the id and
text columns are read, so other columns can't clash.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.llm.shared import dealt_documents, dropped_later, per_batch, utf8, written

# Kinds in order and their patterns.
KINDS = ("assign", "access", "hex", "random")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile("(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile("AKIA[A-Z0-9]{14,}")
HEX = re.compile("[0-9a-f]{16,}")
LONG = 20
TOKEN = re.compile(f"[A-Za-z0-9+/_=-]{{{LONG},}}")
#: Parts of a token that isn't random as a whole: between inner =, then between /, then between - and _.
PARTS = tuple(re.compile(p) for p in ("[^=]+(?:=+$)?", "[^/]+", "[^_-]+"))
#: Alphabets by encoding, the narrowest first.
ENCODINGS = (("hex", re.compile("[0-9a-f]+|[0-9A-F]+"), 16), ("lower", re.compile("[a-z]+"), 26), ("upper", re.compile("[A-Z]+"), 26), ("base32", re.compile("[A-Z2-7]+=*"), 32), ("base36", re.compile("[0-9a-z]+|[0-9A-Z]+"), 36), ("letters", re.compile("[A-Za-z]+"), 52), ("alphanumeric", re.compile("[A-Za-z0-9]+"), 62), ("base64", re.compile("[A-Za-z0-9+/]+=*"), 64), ("base64url", re.compile("[A-Za-z0-9_-]+=*"), 64))
#: Least joint p of a candidate and the false-discovery rate.
PASSES, RATE = 0.01, 0.01
#: The least rate of class switches that ordinary long tokens are taken to have; rates before any text is seen, and the weight of those
#: in neighbours and in couples of characters, which only tells in tables of a few pages.
LEAST_SWITCHES, REPEATS, SERIAL = 0.1, 0.07, 0.0
PRIOR, PRIOR_COUPLES = 1e5, 1e7
#: P-values are counted in BINS steps of an eighth of a decade.
BINS, STEPS = 2_400, 8
SIZES = 8

#: Class of each byte: digit, lower, upper, sign of a token; anything else ends a token.
CLASS = np.full(256, 4, np.uint8)
for _first, _last, _class in (("0", "9", 0), ("a", "z", 1), ("A", "Z", 2)):
    CLASS[ord(_first) : ord(_last) + 1] = _class
CLASS[list(b"+/_=-")] = 3


def normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi_tail(x: float, k: int) -> float:
    """Upper tail of chi-squared with k degrees of freedom (Wilson and Hilferty)."""
    return 0.5 * math.erfc(((max(x, 0.0) / k) ** (1 / 3) - 1 + 2 / (9 * k)) / math.sqrt(4 / (9 * k)))


@dataclass
class Verdict:
    """What the tests say of a token: the joint p of a draw from the alphabet, and the measures that ordinary text is held against."""

    encoding: str
    joint: float
    n: int
    switches: int
    repeats: float
    serial: float


def battery(token: str) -> Verdict | None:
    """The tests on one token; None where no encoding fits or fewer than 16 characters are left without padding."""
    found = next(((name, size) for name, pattern, size in ENCODINGS if pattern.fullmatch(token)), None)
    codes = np.frombuffer(token.rstrip("=").encode("ascii"), np.uint8)
    n = len(codes)
    if found is None or n < 16:
        return None
    name, size = found
    squares = float((np.bincount(codes).astype(np.float64) ** 2).sum())
    uniform = chi_tail(squares * size / n - n, size - 1)
    classes = CLASS[codes]
    switches = int(np.count_nonzero(classes[1:] != classes[:-1]))
    same = float(((np.bincount(classes, minlength=4) / n) ** 2).sum())
    spread = max(1e-9, (n - 1) * same * (1 - same))
    run_p = normal_tail((switches - (n - 1) * (1 - same)) / math.sqrt(spread))
    apart = codes - codes.mean()
    serial = float((apart[1:] * apart[:-1]).sum() / max(float((apart**2).sum()), 1e-9))
    x = -sum(math.log(max(p, 1e-300)) for p in (uniform, run_p, normal_tail(serial * math.sqrt(n))))
    joint = math.exp(-x) * (1 + x + x * x / 2)  # Fisher's method: chi-squared tail with six degrees of freedom
    return Verdict(name, joint, n, switches, (squares - n) / (n * (n - 1)), serial)


def tested(token: str, at: int = 0, cuts: tuple[re.Pattern, ...] = PARTS) -> list[tuple[int, str, Verdict | None]]:
    """(start, text, verdict) of a token and, while it isn't random, of its long parts, cut at ever more characters."""
    own = battery(token)
    out = [(at, token, own)]
    if own and own.joint >= PASSES:
        return out
    for k, cut in enumerate(cuts):
        parts = list(cut.finditer(token))
        if len(parts) > 1 or (parts and parts[0][0] != token):
            return out + [x for m in parts if len(m[0]) >= LONG for x in tested(m[0], at + m.start(), cuts[k + 1 :])]
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank, end) sorted; leftmost non-overlapping per kind, failing matches dropped."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def length_class(n: int) -> int:
    """Two classes a doubling from LONG on; the last is open."""
    return min(SIZES - 1, int(math.log2(n / LONG) * 2))


MEASURES = ("pairs", "switched", "couples", "twins", "sx", "sy", "sxx", "syy", "sxy")


def ordinary(text: bytes) -> list[float]:
    """MEASURES of a text: its pairs of neighbouring token characters, how many switch class, all couples of its token characters, how
    many are equal, and the sums that the neighbours' serial correlation needs."""
    codes = np.frombuffer(text, np.uint8)
    kind = CLASS[codes]
    counts = np.bincount(codes[kind < 4], minlength=1).astype(np.float64)
    n = counts.sum()
    near = np.flatnonzero((kind[1:] < 4) & (kind[:-1] < 4))
    x, y = codes[near].astype(np.float64), codes[near + 1].astype(np.float64)
    return [len(near), np.count_nonzero(kind[near] != kind[near + 1]), n * (n - 1), (counts**2).sum() - n, x.sum(), y.sum(), x @ x, y @ y, x @ y]


PLACE = "start: int, end: int, rank: int"
PART = f"{PLACE}, size: int, random: boolean, n: int, switches: int, repeats: double, serial: double"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and tokens (arrays of PLACE and PART; random: whether the token is a candidate), and MEASURES per row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    span = [("start", pa.int32()), ("end", pa.int32()), ("rank", pa.int32())]
    token = [*span, ("size", pa.int32()), ("random", pa.bool_()), ("n", pa.int32()), ("switches", pa.int32()), ("repeats", pa.float64()), ("serial", pa.float64())]

    def own(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
        starts = [a for a, _, _ in base]
        reach = [0, *accumulate((b for _, _, b in base), max)]  # how far the spans up to each one go
        out = []
        for m in TOKEN.finditer(text):
            if reach[bisect_left(starts, m.end())] > m.start():
                continue
            for at, part, v in tested(m[0], m.start()):
                seen = (bool(v.joint >= PASSES), v.n, v.switches, v.repeats, v.serial) if v else (False, len(part), 0, 1.0, 1.0)
                out.append(dict(zip([k for k, _ in token], (at, at + len(part), 3, length_class(len(part)), *seen), strict=True)))
        return out

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        bases = [base_spans(t) for t in texts]
        listed = [[{"start": a, "end": b, "rank": k} for a, k, b in base] for base in bases]
        tokens = [own(t, base) for t, base in zip(texts, bases, strict=True)]
        measures = np.array([ordinary(utf8(t)) for t in texts], np.float64).reshape(-1, len(MEASURES))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(listed, pa.list_(pa.struct(span))), pa.array(tokens, pa.list_(pa.struct(token))), *(pa.array(measures[:, k]) for k in range(len(MEASURES)))],
            ["doc_id", "base", "tokens", *MEASURES],
        )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return per_batch(rows, make, f"doc_id {kind}, base array<struct<{PLACE}>>, tokens array<struct<{PART}>>, {', '.join(f'{m} double' for m in MEASURES)}")


def ordinary_rates(scanned: DataFrame) -> tuple[float, float, float]:
    """Of the corpus's text: share of neighbours that switch class, share of equal couples, serial correlation."""
    t = scanned.agg(*(F.coalesce(F.sum(m), F.lit(0.0)).alias(m) for m in MEASURES)).first()
    pairs = max(t.pairs, 1.0)
    below = (t.sxx - t.sx**2 / pairs) * (t.syy - t.sy**2 / pairs)
    serial = (t.sxy - t.sx * t.sy / pairs) / math.sqrt(below) if below > 0 else SERIAL
    switches = (t.switched + PRIOR * LEAST_SWITCHES) / (t.pairs + PRIOR)
    repeats = (t.twins + PRIOR_COUPLES * REPEATS) / (t.couples + PRIOR_COUPLES)
    return max(LEAST_SWITCHES, switches), repeats, (serial * t.pairs + SERIAL * PRIOR) / (t.pairs + PRIOR)


def level(t: Column, switches: float, repeats: float, serial: float) -> Column:
    """-log10 of a token's joined p-value as ordinary text, in STEPS a decade, rounded down."""

    def apart(share: Column, rate: float) -> Column:  # Kullback and Leibler's divergence of two coins
        term = lambda x, r: F.when(x > 0, x * F.log(x / r)).otherwise(0.0)
        return term(share, rate) + term(1 - share, 1 - rate)

    share = t["switches"] / F.greatest(t["n"] - 1, F.lit(1))
    runs = F.when(share > switches, (t["n"] - 1) * apart(share, switches)).otherwise(0.0)
    twins = F.when(t["repeats"] < repeats, F.floor(t["n"] / 2) * apart(t["repeats"], repeats)).otherwise(0.0)
    steady = F.when(t["serial"] < serial, t["n"] * F.pow(serial - t["serial"], F.lit(2)) / 2).otherwise(0.0)
    joined = F.greatest(runs, twins, steady) - math.log(3)
    return F.least(F.lit(BINS - 1), F.floor(F.greatest(joined, F.lit(0.0)) * (STEPS / math.log(10))).cast("int"))


def least_levels(tokens: DataFrame) -> dict[int, int]:
    """For each size class of tokens (size, level, random), the least level at which RATE bounds the share of false findings among all
    of that class's tokens."""
    counts = tokens.groupBy("size", "level").agg(F.count("*").alias("n"), F.count_if("random").alias("found")).collect()  # at most SIZES x BINS rows
    out = {}
    for size in {r["size"] for r in counts}:
        own = sorted((r for r in counts if r["size"] == size), key=lambda r: -r.level)
        total, found = sum(r.n for r in own), 0
        for r in own:
            found += r.found
            if r.level and total * 10.0 ** (-r.level / STEPS) <= RATE * found:
                out[size] = r.level
    return out


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and all: arrays of (start, end, rank) of the patterns' spans and of every finding, in order; rank: of KINDS."""
    scanned = dropped_later(written(scan(docs, id_col, text_col), "secrets"))
    rates = ordinary_rates(scanned)
    tokens = scanned.select(F.explode("tokens").alias("t")).select("t.size", "t.random", level(F.col("t"), *rates).alias("level"))
    levels = least_levels(tokens)
    needed = F.array(*(F.lit(levels.get(k, BINS)) for k in range(SIZES)))
    found = F.transform(F.filter("tokens", lambda t: t["random"] & (level(t, *rates) >= F.get(needed, t["size"]))), lambda t: F.struct(t["start"], t["end"], t["rank"]))
    order = F.transform(F.array_sort(F.transform(F.concat("base", found), lambda s: F.struct(s["start"], s["rank"], s["end"]))), lambda s: F.struct(s["start"], s["end"], s["rank"]))
    return scanned.select("doc_id", "base", order.alias("all"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*(F.lit(k) for k in KINDS))

    def listed(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))))

    def number(rank: int):
        return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long").alias(f"n_{KINDS[rank]}")

    found = secrets(dealt_documents(spark, sf_dir))
    return found.select("doc_id", number(0), number(1), number(2), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("all")).alias("spans"))


QUERIES = {"op6_secret_scan": op6_secret_scan}
SQL: dict[str, str] = {}
