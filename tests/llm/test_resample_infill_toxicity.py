"""Operators 11 to 13 against brute force and held-out labels, with nulls, empty and long texts, repeated rows and empty tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from glossmill.llm import infill, resample, toxicity

LOWER = {c: c + 32 for c in range(65, 91)}


def query(name):
    return next(q for n, q in __spark_entry__.queries().items() if n.startswith(name))


def drawn(rows, target, share=5, least=20):
    """doc_id, n_features, weight, score, rank by the contract's words."""

    def runs(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        return len(w), [" ".join(w[k : k + n]) for n in (1, 2, 3) for k in range(len(w) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    own = [(i, *runs(t)) for i, t in rows]
    s, t = Counter(bucket(f) for _, _, fs in own for f in fs), Counter(bucket(f) for x in target for f in runs(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000))))
    out = []
    for i, n, fs in own:
        weight = sum(gain(bucket(f)) for f in fs)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    enough = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[1]))
    k = share * len(enough) // 100
    return Counter([(*r[:4], n + 1 if n < k else None) for n, r in enumerate(enough)] + [(*r[:4], None) for r in out if r[4] < least])


def test_op11_by_the_contract(spark, rows, folder):
    target = ["one two three four five", "p1 p2 p3 the the", None]
    spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string").write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
    assert Counter(tuple(r) for r in query("op11_")(spark, folder).collect()) == drawn(rows, target)


@pytest.mark.parametrize("share", [0, 1, 30, 99, 100])
def test_op11_ties_repeats_and_null_ids(spark, rows, docs, empty, share):
    table = [*rows, *((k % 7 - 3, " ".join(["same words here"] * 9)) for k in range(60)), *((None, rows[8][1]) for _ in range(40)), (2**63 - 1, rows[8][1]), (-(2**63), rows[11][1])]
    df = spark.createDataFrame(table, "doc_id long, text string")
    target = spark.createDataFrame([("same words",), ("w1x1 w2x2",)], "text string")
    assert Counter(tuple(r) for r in resample.resampled(df, target, share).collect()) == drawn(table, ["same words", "w1x1 w2x2"], share)
    if share == 30:
        assert resample.resampled(empty, target, share).count() == 0
        assert Counter(tuple(r) for r in resample.resampled(docs, target, share).collect()) == drawn(rows, ["same words", "w1x1 w2x2"], share)


def test_op11_checksums_of_any_length():
    texts = ["", "A", "é b c", "x" * 63 + " " + "y" * 64 + " " + "z" * 65, "q" * 200_000 + " r", "日本 語, ½!a", "a.b c\x00d"]
    buckets, doc, words = resample.features(pa.array([*texts, None])[1:])
    found = [Counter() for _ in words]
    for b, d in zip(buckets.tolist(), doc.tolist(), strict=True):
        found[d][b] += 1
    for k, text in enumerate([*texts[1:], ""]):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))
        assert words[k] == len(w)
        assert found[k] == Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1))


def test_op11_radix_selection(spark):
    random = np.random.default_rng(7)
    for values in (random.integers(-(2**63), 2**63 - 1, 500), random.integers(-3, 3, 500), np.repeat(5, 50), np.array([-(2**63), 2**63 - 1, 0])):
        df = spark.createDataFrame([(int(v), k) for k, v in enumerate(values)], "v long, k long")
        order = sorted((int(v), k) for k, v in enumerate(values))
        for k in {1, len(values) // 2, len(values) - 1, len(values)}:
            chosen = df.filter(resample.kth_key(df, [F.col("v"), F.col("k")], k)).collect()
            assert sorted((r.v, r.k) for r in chosen) == order[:k]


UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def filled(i, text):
    text = text or ""
    u, hexed = UNIT.findall(text), hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hexed[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(u)
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return i, n, "plain", None, None, brute.sha(text), brute.sha(text)
    p, m, s = "".join(u[:lo]), "".join(u[lo:hi]), "".join(u[hi:])
    form = "spm" if h4 % 100 < 80 else "psm"
    return i, n, form, len(p), len(m), brute.sha(f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"), brute.sha(text)


def test_op13_by_the_contract(spark, rows, folder):
    assert Counter(tuple(r) for r in query("op13_")(spark, folder).collect()) == Counter(filled(i, t) for i, t in rows)


def test_op13_odd_texts(spark, docs, empty):
    texts = [None, "", " ", "a", " a", "a ", "\x1f", "\x1e", "\x1ed\x1fe \x1e\x1e \x1f\x1f", "has <P> in it", "near < P> <", "<<S", "S> M> P>", "$0 $1 \\ \\1", "😀 é x   y", "\x1c\x1d\x85 z", "x\r\ny\x0b", "<P", "<S", "<M" * 3, "\x1f " * 400]
    table = [(i, t) for i in (None, *range(40)) for t in texts] + [(5, "twice"), (5, "twice")]
    made = infill.fill_in_middle(spark.createDataFrame(table, "doc_id long, text string"))
    made = made.select("row.*", "n", "form", "prefix", "middle", "suffix", "output", infill.restored(F.col("output"), F.col("form")).alias("again")).collect()
    assert len(made) == len(table) and {r.form for r in made} == {"plain", "spm", "psm"}
    for r in made:
        assert r.again == (r.text or "")
        assert (r.doc_id, r.n, r.form, None if r.prefix is None else len(r.prefix), None if r.middle is None else len(r.middle), brute.sha(r.output), brute.sha(r.again)) == filled(r.doc_id, r.text)
        assert r.form == "plain" or r.prefix + r.middle + r.suffix == r.text
    assert infill.fill_in_middle(docs).select("row.*").columns == docs.columns
    assert infill.fill_in_middle(empty).count() == 0


def test_op12_on_held_out_rows(spark):
    """The given tables; the rows held out are those of the contract and their labels aren't read."""
    folder = "/root/testdata/sf0.01"
    found = query("op12_")(spark, folder).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas().set_index("doc_id")
    assert len(found) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in found.held_out.items())
    assert found.score.between(0, 1).all() and ((found.score >= 0.3) == (found.predicted == 1)).all()
    both = labels.join(found)
    both = both[both.held_out]
    hits = int(((both.predicted == 1) & (both.toxic == 1)).sum())
    assert hits >= 0.5 * both.toxic.sum()
    assert int(((both.predicted == 1) & (both.toxic == 0)).sum()) <= 0.05 * (both.toxic == 0).sum()


BAD, GOOD = "you are an idiot and a scum here", "a calm walk in the quiet green park"


def test_op12_odd_rows(spark, empty):
    table = [(k, f"{BAD if k % 2 else GOOD} {k * 37 % 11} or more") for k in range(160)]
    docs = spark.createDataFrame([*table, (None, BAD), (None, None), (900, ""), (901, GOOD + " 😀" * 5000), (1, table[1][1]), (1, "other")], "doc_id long, text string").withColumn("toxic", F.lit("mine")).withColumn("score", F.lit(1))
    labels = spark.createDataFrame([(k, k % 2) for k, _ in table if k < 120] + [(None, 1), (3, 1), (3, 0), (130, None)], "doc_id long, toxic int")
    found = toxicity.toxicity(docs, labels)
    assert found.select("row.*").columns == docs.columns
    for r in found.select("row.doc_id", "row.text", "score", "predicted").collect():
        if r.text and r.text != "other":
            assert r.predicted == ("idiot" in r.text), (r.doc_id, r.score)
    assert len({r.score for r in found.filter("coalesce(row.text, '') = ''").collect()}) == 1
    assert toxicity.toxicity(empty, labels).count() == 0
    for kind, score in ((0, 0.0), (1, 1.0), (None, 0.0)):
        alone = labels.filter(F.lit(False) if kind is None else F.col("toxic") == kind)
        assert {r.score for r in toxicity.toxicity(docs, alone).select("score").collect()} == {score}


def test_op12_rows_held_out_say_nothing(spark):
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 4 == 2]
    docs = spark.createDataFrame([(k, f"{BAD if k % 2 else GOOD} {k % 13}") for k in range(120)] + [(k, "zzzquark only") for k in held], "doc_id long, text string")
    labels = [(k, k % 2) for k in range(120) if k not in held]
    one, other = (spark.createDataFrame([*labels, *((k, v) for k in held)], "doc_id long, toxic int") for v in (0, 1))
    a, b = (Counter((r.row.doc_id, r.score) for r in toxicity.toxicity(docs, x).collect()) for x in (one, other))
    assert a == b


def test_op12_grams_are_distinct_and_whole():
    texts = ["Abc, abc ABC", "", None, "é" * 5, "ab"]
    found, owner = toxicity.grams(pa.array(texts))
    assert len(set(zip(owner.tolist(), found.tolist(), strict=True))) == len(found)
    counts = Counter(owner.tolist())
    word = lambda n: sum(max(0, n + 2 - k + 1) for k in toxicity.SIZES)
    assert counts[0] == word(3) and counts[4] == word(2) and counts[1] == counts[2] == 0
    assert counts[3] == len({("é" * 5).join("  ")[i : i + k] for k in toxicity.SIZES for i in range(8 - k)})


def test_op12_long_texts_in_pieces(monkeypatch):
    """Pieces of any size give the n-grams of whole texts; words are never cut."""
    texts = pa.array(["some words, some more WORDS é " * 40, "", None, "x" * 700 + " y", "tail", " lead"])
    whole = [sorted(zip(*(x.tolist() for x in toxicity.grams(texts)), strict=True))]
    for size in (1, 10, 64, 1_000):
        monkeypatch.setattr(toxicity, "PIECE", size)
        assert sorted(zip(*(x.tolist() for x in toxicity.grams(texts)), strict=True)) == whole[0]
    assert {o for _, o in whole[0]} == {0, 3, 4, 5}


def test_op12_the_step_finds_the_least_value():
    a = np.diag([1.0, 50.0, 0.2]) + 0.1
    b = np.array([1.0, -2.0, 3.0])
    x = toxicity.minimized(lambda x: (float(x @ a @ x / 2 - b @ x), a @ x - b), np.zeros(3))
    assert np.allclose(x, np.linalg.solve(a, b), atol=0.05)
