"""The pipeline's stages, one by one, against brute force."""

from __future__ import annotations

import random

import brute
from pyspark.sql import functions as F

import corpus_pipeline
from glossmill.llm import quality
from glossmill.llm.shared import documents, written


def test_stages(spark, folder):
    docs = documents(spark, folder)
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = written(stage(spark, docs, folder), name)
        if name == "packing":
            assert {r.doc_id for r in docs.collect()} == set(before)
            break
        assert docs.columns == columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
        if name == "quality_rules":
            assert not any(brute.quality(t)[5] for t in kept[name].values())
        if name == "jaccard_join":
            classes = brute.components(list(before.items()))
            assert set(kept[name]) == {c for _, _, c in classes}
        if name == "substring_dedup":
            whole = {r[0]: r for r in brute.without_repeats(list(before.items()))}
            assert {i: brute.sha(" ".join(brute.WORD.findall(t))) for i, t in kept[name].items()} == {i: r[3] for i, r in whole.items() if r[2] < r[1]}
        if name == "personal_data":
            assert set(kept[name]) == set(before)
            assert not any(brute.personal(t)[:4] != (0, 0, 0, 0) for t in kept[name].values())


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_stages_on_odd_rows(spark, tmp_path):
    """Without labels, which decide nothing here: null and repeated ids, repeated rows, null, empty and short texts, and columns whose names stages use themselves."""
    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    one, two = (" ".join(f"{c}{k}" for k in range(60)) for c in "ov")
    rows = [(None, one), (None, one), (7, f"{one} a tail of words"), (7, None), (8, ""), (9, "short"), (9, f"{two} call 555-123-4567"), (9, f"{two} call 555-123-4567")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit("mine") for c in ("row", "kept", "score", "fate", "cut", "hit", "doc", "tie", "fp", "n", "th", "id", "home", "pii", "words")})
    columns, left = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, folder), name)
        assert docs.columns == columns
        left[name] = sorted((r.doc_id or 0, r.text) for r in docs.collect())
    assert left["quality_rules"] == sorted((i or 0, t) for i, t in rows if t and len(t.split()) > 9)
    assert left["jaccard_join"] == left["substring_dedup"] == [(7, f"{one} a tail of words"), (9, f"{two} call 555-123-4567")]
    assert left["personal_data"] == [(7, f"{one} a tail of words"), (9, f"{two} call [LOCAL_PHONE]")]
    assert docs.filter("hit = 'mine' and pii = 'mine' and row = 'mine'").count() == 2
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).groupBy("doc_id").count().count() == 2


def test_quality_rules_heed_all_labelled_rows(spark, tmp_path):
    """The stage's verdicts are those of the threshold over every judged row: scores of good and bad rows overlap, so fewer rows cut elsewhere."""
    folder, own = str(tmp_path), random.Random(3)
    rows = [(k, " ".join(f"{'g' if own.random() < share else 'b'}{own.randrange(300)}" for _ in range(12))) for k in range(8_000) for share in (0.7 if k < 6_000 else 0.4,)]
    spark.createDataFrame([(k, int(k < 6_000), 0) for k, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    held = {r.doc_id for r in labels.filter("quality = 1").filter(quality.held_out()).collect()}
    score = {r.row.doc_id: r.score for r in quality.judge(docs, labels).collect()}
    least = quality.threshold([(s, i < 6_000) for i, s in score.items() if i >= 6_000 or i in held])
    assert len(held) > 1_000
    assert {r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, folder).collect()} == {i for i, s in score.items() if s >= least}


def test_quality_rules_count_all_trusted_rows(spark, tmp_path):
    """The stage's verdicts are those of brute force over the whole tables, where over 20,000 rows are trusted and few are judged."""
    folder, own = str(tmp_path), random.Random(5)
    held = [r.doc_id for r in spark.range(27_000).withColumnRenamed("id", "doc_id").filter(quality.held_out()).collect()]
    trusted, good, bad = set(range(27_000)).difference(held), set(held[:500]), set(held[500:1_000])
    words = lambda share: " ".join(f"{'g' if own.random() < share else 'b'}{own.randrange(300)}" for _ in range(12))
    rows = [(k, words(0.4 if k in bad else 0.7)) for k in range(27_000)]
    marks = [(k, int(k not in bad), 0) for k in sorted(trusted | good | bad)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    scores = [round(s, 6) for s in brute.log_ratio_scores(rows, trusted, quality.BUCKETS)]
    least = quality.threshold([(s, k in good) for (k, _), s in zip(rows, scores, strict=True) if k in good | bad])
    found = {r.doc_id for r in corpus_pipeline.quality_rules(spark, spark.createDataFrame(rows, "doc_id long, text string"), folder).collect()}
    assert len(trusted) > 20_000
    assert found == {k for (k, _), s in zip(rows, scores, strict=True) if s >= least}
