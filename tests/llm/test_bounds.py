"""Bounds of the corpus operators: what may grow with one id, one piece, one window or one sample."""

from __future__ import annotations

import math
import random
import time
from collections import Counter

import brute
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glossmill.llm import bpe, counts, media, quality, shared, substrings
from glossmill.llm.bpe import tokenizer, tokenizer_path


def test_op4_an_id_that_repeats_sends_one_score(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "threshold", lambda scores: seen.append(len(scores)) or 0.0)
    docs = spark.range(5_000).select(F.lit(26).cast("long").alias("doc_id"), F.concat(F.lit("junk # % "), F.col("id").cast("string")).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(k, f"good words number {k}") for k in range(20)], docs.schema))
    labels = spark.createDataFrame([(26, 0, 0)] + [(k, 1, 0) for k in range(20)], "doc_id long, quality int, toxic int")
    assert quality.judge(docs, labels).count() == 5_020
    assert seen[0] <= 21


def test_op4_all_labelled_rows_are_fitted_to(spark, monkeypatch):
    ids = spark.range(33_000).select(F.col("id").alias("doc_id"), (F.col("id") < 30_000).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    good = quality.labelled_ids(ids, True)
    trusted, held = (good.filter(keep).count() for keep in (~quality.held_out(), quality.held_out()))
    assert trusted > 20_000 and held > 1_000
    assert (quality.trusted_ids(ids).count(), quality.judged_ids(ids).count()) == (trusted, held + 3_000)
    seen = []
    monkeypatch.setattr(quality, "threshold", lambda scores: seen.extend(scores) or 0.0)
    text = F.concat(F.when(F.col("id") < 30_000, F.lit("good words number ")).otherwise(F.lit("junk # % ")), (F.col("id") % 97).cast("string"))
    docs = spark.range(33_000).select(F.col("id").alias("doc_id"), text.alias("text"))
    quality.judge(docs, ids)
    assert {kind: sum(n for _, g, n in seen if g is kind) for kind in (True, False)} == {True: held, False: 3_000}
    # Both counts of a feature are those of the whole table: "good" is in all good rows, the trusted ones among them.
    ratios = quality.log_ratios(docs, ids).first().ratios
    bucket = spark.range(1).select(F.pmod(F.xxhash64(F.lit("good")), F.lit(quality.BUCKETS))).first()[0]
    assert ratios[bucket] == pytest.approx(math.log((trusted + 1) / (7 * trusted + quality.BUCKETS)) - math.log(30_001 / (7 * 33_000 + quality.BUCKETS)))


@pytest.mark.parametrize("seed", range(4))
def test_op4_cuts_have_the_same_threshold(spark, seed):
    own = random.Random(seed)
    spread = (0.004, 0.05, 2.0, 0.0)[seed]
    rows = [(round(own.gauss(0.3 * spread if g else 0, spread), 6 if seed else 3), g) for g in (own.random() < 0.3 for _ in range(1_500))]
    steps = spark.createDataFrame(rows, "score double, good boolean").groupBy("score").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    good = sum(g for _, g in rows)
    found = [(r.score, kind, n) for r in quality.cuts(steps, good, len(rows) - good).collect() for kind, n in ((True, r.good), (False, r.bad)) if n]
    assert quality.threshold(found) == quality.threshold(rows)
    assert len(found) <= 6 * len({math.floor(s * quality.BINS) for s, _ in rows})


@pytest.mark.parametrize("words", [1, 8, shared.FILTER_WORDS])
def test_rows_told_apart_by_a_bit_table(spark, monkeypatch, words):
    """A full table only tells less apart: no row is lost, and none with a key in the set is among the others."""
    monkeypatch.setattr(shared, "FILTER_WORDS", words)
    rows = spark.createDataFrame([(k if k % 7 else None, f"t{k}") for k in range(-300, 300)], "doc_id long, w string")
    keys = spark.range(0, 300, 3).select(F.col("id").alias("doc_id"))
    others, likely = (sorted((r.doc_id or 0, r.w) for r in part.collect()) for part in shared.told_apart(rows, keys, "doc_id"))
    assert sorted(others + likely) == sorted((k if k % 7 else 0, f"t{k}") for k in range(-300, 300))
    assert not any(k > 0 and k % 3 == 0 for k, _ in others)
    assert len(others) > 450 if words == shared.FILTER_WORDS > 8 else True


def test_op7_op8_frequent_pieces_are_counted_over_all_rows(spark, monkeypatch):
    """Also those of long texts, of more rows than any sample had, and of tasks that give out their counts many times."""
    rows = [(k, " ".join(f"w{k * j % 211}" for j in range(12))) for k in range(6_000)] + [(None, "longest " * 9_000), (1, None), (2, ""), (3, "x" * 65 + " y" * 65)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (0, 1, 40, 1_000):
        if most == 1_000:
            monkeypatch.setattr(bpe, "MAX_CACHED", 50)
        own = Counter(p for _, t in rows for p in (t or "").split() if len(p) <= 64)
        found = bpe.frequent(df, str.split, most)
        assert found == sorted(found) and len(found) <= most and (most < 1_000 or set(found) == set(own))
        least = min((own[p] for p in found), default=0)
        # What is left out is less frequent, or as frequent within the level at which the number is met.
        assert all(own[p] <= least for p in own.keys() - set(found)) if found else most <= 1
    assert "longest" in bpe.frequent(df, str.split, 40)


def test_op8_one_long_piece_takes_seconds():
    path = tokenizer_path("byte_bpe_50k.json")
    counter = counts.Counter(path, counts.Lengths(["a", " the"], [1, 1]))
    text = "ab" * 1_000_000
    began = time.time()
    assert counter.count([text[:3_000] + " the a"]) == [len(tokenizer(path).encode(text[:3_000] + " the a", add_special_tokens=False).ids)]
    n = counter.count([text])
    assert time.time() - began < 60 and n[0] > 1_000


@pytest.mark.parametrize("data", [b"P2 1 1 255 " + b"9" * 30, b"P2 1 1 " + b"9" * 30 + b" 1", b"P5 " + b"9" * 20 + b" 1 255\n0", b"P6 1 1 255\n", b"BM" + b"\xff" * 60])
def test_op9_media_out_of_range_give_nulls(spark, data):
    row = media.media_columns(spark.createDataFrame([(1, data)], "k int, media binary")).first()
    assert row.row.k == 1 and row.tile is None and row.dhash is None


@pytest.mark.parametrize("cut", [1, 2, 3, 7, 100])
def test_op5_a_window_over_many_batches_carries_one_row(spark, cut):
    """Windows in batches of any size come out as in one; SETTLED rows and those that stand for others are given out once."""
    states = {"new": 0, "stands": substrings.STANDS, "settled": substrings.SETTLED}
    rows = [(k // 23 if k < 69 else k, 0, k, 0, k, list(states.values())[k % 3] if k % 5 == 0 else 0) for k in range(100)]
    names = ["key", "check", "doc", "tie", "pos", "state"]
    batch = pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows])
    live = Counter((r[0], r[1]) for r in rows if r[5] != substrings.SETTLED)
    stands = {(r[0], r[1]) for r in rows if r[5] == substrings.STANDS}
    wanted = [r[2] for r in rows if r[5] == substrings.SETTLED or live[r[:2]] > 1 or r[:2] in stands]
    picked = substrings.picker(False)(batch.slice(at, cut) for at in range(0, 100, cut))
    assert sorted(d for b in picked for d in b.column("doc").to_pylist()) == wanted
    firsts = {}
    for r in rows:
        if r[5] != substrings.SETTLED:
            firsts.setdefault(r[:2], r[2])
    later = [r[2] for r in rows if r[5] == substrings.SETTLED or firsts[r[:2]] != r[2]]
    picked = substrings.picker(True)(batch.slice(at, cut) for at in range(0, 100, cut))
    assert sorted(d for b in picked for d in b.column("doc").to_pylist()) == later


def test_op5_whole_documents_go_by_their_words(spark):
    one = " ".join(f"w{k}" for k in range(30))
    rows = [(2, one), (1, f" {one}\n"), (3, one.replace("w29", "W29")), (4, None), (5, "")]
    found = {r.doc_id: r.fate for r in substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string"))[0].collect()}
    assert found == {1: "kept", 2: "removed", 3: "cut", 4: "kept", 5: "kept"}
    assert brute.without_repeats(rows)[1][2] == 30
