"""Quality rules (operator 4): hashed n-gram log-likelihood ratio of trusted-target and raw-corpus multinomials.

DataFrame functions only. Features are words and pairs of adjacent words, hashed into BUCKETS. The raw multinomial counts all rows of
the corpus; the target one counts all trusted rows (labelled good, but for one in HELD_OUT by hash). A document's score is its mean log
ratio per feature; it is kept at a threshold or more if no base rule rejects it. The threshold is fitted to all labelled rows that the
target hasn't seen, bad ones and held-out good ones: the one that rejects most bad ones, where a good one lost counts LOSS times.
Windows of five words are compared by 64-bit hashes.

Null texts have no words, hence fail the base rule; ids may be null or repeat, as each row is judged alone (a null id is never
trusted); an empty table gives an empty one; without trusted rows all ratios are 0, and without held-out rows of both kinds LEAST is
the threshold; columns of any name are kept in `row`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossmill.llm import columns
from glossmill.llm.shared import dealt_documents, dropped, told_apart, written

BUCKETS = 1 << 14
#: One in HELD_OUT good rows is kept from the multinomials for the threshold.
HELD_OUT, LOSS, LEAST = 5, 10, -0.5
#: Bins of scores, which have six decimals, in a unit: a bin has at most 10,000 of them, and all scores lie within a few dozen units.
BINS = 100


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """row (all columns of docs), _hashes (of the words), and the base measures n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    work = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("_text")).withColumn("_words", columns.words(F.col("_text")))
    work = work.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    five = [F.col("_hashes")] * 5
    window = F.transform(F.sequence(F.lit(0), F.size("_hashes") - 5), lambda i: F.xxhash64(*(F.get(h, i + k) for k, h in enumerate(five))))
    work = work.withColumn("_windows", F.when(F.size("_hashes") >= 5, window).otherwise(F.array().cast("array<bigint>")))
    pairs = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    work = work.withColumn("_sorted", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), pairs))
    same = lambda x, k: F.coalesce(x["h"] == F.get("_sorted", k)["h"], F.lit(False))
    twice = F.filter("_sorted", lambda x, k: same(x, k - 1) | same(x, k + 1))
    work = work.withColumn("_at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.zip_with("_at", F.slice("_at", 2, F.size("_at")), lambda a, b: F.least(F.lit(5), F.coalesce(b - a, F.lit(5))))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    work = work.withColumn("_lines", F.when(F.contains(text, F.lit("\n")), lines).otherwise(F.array().cast("array<string>")))
    return work.select(
        "row",
        "_hashes",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "_words")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_at").isNull(), 0).otherwise(F.aggregate(covered, F.lit(0), lambda a, b: a + b)).cast("long").alias("n_repeat_words"),
    )


def features(hashes: Column) -> Column:
    """Buckets of all words and of all pairs of adjacent words, from the words' hashes; `hashes` is a column of its own."""
    bucket = lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int")
    pairs = F.zip_with(F.slice(hashes, 1, F.greatest(F.size(hashes) - 1, F.lit(0))), F.slice(hashes, 2, F.size(hashes)), lambda a, b: bucket(F.xxhash64(a, b)))
    return F.concat(F.transform(hashes, bucket), pairs)


def labelled_ids(labels: DataFrame, good: bool) -> DataFrame:
    """Ids of rows labelled good and not toxic, or bad. Null ids are left out."""
    rule = "quality = 1 and coalesce(toxic, 0) = 0" if good else "quality = 0"
    return labels.filter(f"{rule} and doc_id is not null").select("doc_id").distinct()


def held_out() -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(HELD_OUT)) == 0


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labelled_ids(labels, True).filter(~held_out())


def judged_ids(labels: DataFrame) -> DataFrame:
    """(doc_id, good) of the rows that the threshold is fitted to."""
    good = labelled_ids(labels, True).filter(held_out())
    bad = labelled_ids(labels, False)
    return good.withColumn("good", F.lit(True)).unionByName(bad.withColumn("good", F.lit(False)))


def log_ratios(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row, `ratios`: for each bucket the log ratio of its smoothed share in the target and in the raw corpus (0 without target).

    Only texts that may be trusted, by a bit table of ids, are shuffled for the join (where Spark plans a shuffle at all).
    """
    trusted = trusted_ids(labels)
    others, likely = told_apart(docs.select("doc_id", "text"), trusted, "doc_id")
    own = likely.join(trusted.withColumn("_good", F.lit(1)), "doc_id", "left").select("_good", "text")
    marked = others.select(F.lit(None).cast("int").alias("_good"), "text").unionByName(own).select("_good", columns.words(F.col("text")).alias("words"))
    hashed = marked.select(F.coalesce("_good", F.lit(0)).alias("good"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    grams = hashed.select("good", F.explode(features(F.col("hashes"))).alias("b"))
    counts = grams.groupBy("b").agg(F.count("*").alias("raw"), F.sum("good").alias("target"))
    both = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left").na.fill(0)
    rows = both.agg(F.array_sort(F.collect_list(F.struct("b", "raw", "target"))).alias("rows"), F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target"))
    ratio = lambda r: F.log((r["target"] + 1) / (F.col("all_target") + BUCKETS)) - F.log((r["raw"] + 1) / (F.col("all_raw") + BUCKETS))
    return rows.select(F.transform("rows", lambda r: F.when(F.col("all_target") == 0, 0.0).otherwise(ratio(r))).alias("ratios"))


def score(hashes: Column, grams: Column, ratios: Column) -> Column:
    """Mean log ratio of a document's features; 0 without words."""
    total = F.aggregate(grams, F.lit(0.0), lambda a, b: a + F.get(ratios, b))
    return F.when(F.size(hashes) > 0, F.round(total / F.size(grams), 6)).otherwise(0.0)


def threshold(scores: list[tuple]) -> float:
    """The score from which on documents are kept, from (score, good) or (score, good, how many) of held-out rows: in the middle of the
    best gap, the lowest of equals."""
    scores = sorted((s, g, *(n or [1])) for s, g, *n in scores)
    good, bad = (sum(n for _, g, n in scores if g is kind) for kind in (True, False))
    if not good or not bad:
        return LEAST
    value, best, least = 0, 0, scores[0][0]
    for (s, g, n), (following, *_) in zip(scores, [*scores[1:], (scores[-1][0] + 1,)], strict=True):
        value += -LOSS * n * bad if g else n * good
        if value > best and following > s:
            best, least = value, (s + following) / 2
    return least


def cuts(steps: DataFrame, good: int, bad: int) -> DataFrame:
    """steps (score, good, bad: how many) with at most three rows for each bin of scores, which have the same threshold.

    A bin's best cut is the same whatever lies before the bin. Its first score, the rest up to the cut and the rest beyond it stand
    for all: any other cut is worse than that one, or equal and above it.
    """
    gain = F.col("bad").cast("decimal(19,0)") * F.lit(good) - F.col("good").cast("decimal(19,0)") * F.lit(LOSS * bad)
    whole = Window.partitionBy("bin")
    valued = steps.withColumn("bin", F.floor(F.col("score") * BINS)).withColumn("value", F.sum(gain).over(whole.orderBy("score")))
    best = -F.max(F.struct("value", (-F.col("score")).alias("s"))).over(whole)["s"]
    marked = valued.select("bin", "score", "good", "bad", best.alias("best"), F.min("score").over(whole).alias("first"))
    part = F.when(F.col("score") == F.col("first"), 0).when(F.col("score") <= F.col("best"), 1).otherwise(2)
    sums = marked.groupBy("bin", part.alias("part")).agg(F.min("score").alias("low"), F.max("score").alias("high"), F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    return sums.select(F.when(F.col("part") == 1, F.col("high")).otherwise(F.col("low")).alias("score"), "good", "bad")


def fitted_threshold(docs: DataFrame, labels: DataFrame, ratios: Column) -> float:
    """Each judged id and label has one score, the least of the rows that share the id. Only cuts() of them come to the driver."""
    judged = judged_ids(labels)
    likely = told_apart(docs.select("doc_id", "text"), judged, "doc_id")[1]
    own = likely.join(judged, "doc_id").select("doc_id", "good", columns.words(F.col("text")).alias("words"))
    grams = own.select("doc_id", "good", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes")).withColumn("grams", features(F.col("hashes")))
    scores = grams.select("doc_id", "good", score(F.col("hashes"), F.col("grams"), ratios).alias("score")).groupBy("doc_id", "good").agg(F.min("score").alias("score"))
    steps = written(scores.groupBy("score").agg(F.count_if(F.col("good")).alias("good"), F.count_if(~F.col("good")).alias("bad")), "judged-scores")
    total = steps.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    rows = cuts(steps, total.good or 0, total.bad or 0).collect()
    dropped(steps)
    return threshold([(r.score, kind, n) for r in rows for kind, n in ((True, r.good), (False, r.bad)) if n])


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """row (all columns of docs, with doc_id and text among them), the base measures, score, base_failed and kept.

    The model, BUCKETS numbers in one row, comes to the driver and goes out as one literal.
    """
    model = log_ratios(docs, labels).first().ratios
    ratios = F.split(F.lit(",".join(f"{r:.6f}" for r in model)), ",").cast("array<double>")
    least = fitted_threshold(docs, labels, ratios)
    work = measures(docs).withColumn("_grams", features(F.col("_hashes")))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    work = work.withColumn("base_failed", failed).withColumn("score", score(F.col("_hashes"), F.col("_grams"), ratios))
    # The row number, always true, keeps a filter on `kept` above the work: pushed down, it would repeat each array for each element.
    above = F.monotonically_increasing_id() >= 0
    return work.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= least) & above).drop("_hashes", "_grams")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(dealt_documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


QUERIES = {"op4_quality_rules": op4_quality_rules}
SQL: dict[str, str] = {}
