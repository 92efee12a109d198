"""Ordering, translation, rendering, outages, metrics and streams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from glossmill.operators import attempts, dispatch, metrics, render, translate
from glossmill.operators.extract import segments
from glossmill.streaming import streams


def test_priority_and_new_distances(spark):
    rows = [("A", "main", 5, 1000), ("B", "chrome", 9, 0), ("C", "main", 7, 0), ("D", "main", 1, 400), ("E", "chrome", 0, 2000), ("F", "main", 6, 1100)]
    df = spark.createDataFrame([(1, *r) for r in rows], "page_id long, seg_id string, region string, order int, distance int")
    assert [r.seg_id for r in dispatch.priority(df).orderBy("place").collect()] == list("CBDAFE")
    again = dispatch.ranked_again(df, df.filter("seg_id = 'C'"), df.select("page_id", "seg_id", F.when(F.col("seg_id") == "A", 0).otherwise(5000).alias("distance")))
    assert again.orderBy("place").first().seg_id == "A"
    assert again.count() == 5


def test_eager_and_lazy(spark):
    rows = [(1, k, "main" if k < 15 else "chrome", "pending", f"{k}") for k in range(18)]
    df = spark.createDataFrame(rows, "page_id long, order int, region string, state string, anchor_path string")
    assert sorted(r.order for r in dispatch.eager(df).filter("eager").collect()) == list(range(10))
    assert dispatch.eager(df, 0).filter("eager").count() == 0
    assert {(r.anchor_path, r.tier) for r in dispatch.lazy_tiers(df).collect()} == {(str(k), "main" if k < 15 else "chrome") for k in range(10, 18)}


def test_requests(spark):
    rows = ['{"source":"x"}', '{"id":5,"source":"x"}', '{"id":"a"}', '{"id":"a","source":["x"]}', '{"id":"a","source":"x","from":3,"type":"t"}', '{"id":"a","source":"","from":"fr","to":"de"}', "not json"]
    df = translate.parsed_requests(spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, message string")).orderBy("k")
    got = [(r.id, r.source, r["from"], r.to, r.error) for r in df.collect()]
    assert [g[4] for g in got] == ["missing id", "missing id", "missing source", "missing source", None, None, "missing id"]
    assert got[4][:4] == ("a", "x", "en", "zh-Hant")
    assert got[5][:4] == ("a", "", "fr", "de")
    json = df.select(translate.response(F.col("id"), F.lit(""), F.col("error"))).collect()
    assert [r[0] for r in json][2:5] == ['{"error":"missing source","id":"a"}', '{"error":"missing source","id":"a"}', '{"id":"a","text":""}']
    assert json[0][0] == '{"error":"missing id"}'


def test_state_machine(spark):
    segs = spark.createDataFrame([(1, f"k{k}", "skipped" if k == 5 else "pending", "0") for k in range(6)], "page_id long, seg_id string, state string, anchor_path string")
    answers = spark.createDataFrame([(1, "k0", "T", None), (1, "k1", None, "bad"), (1, "k2", None, None), (1, "k3", "", None), (1, "k5", "T", None)], "page_id long, seg_id string, text string, error string")
    done = translate.applied(segs, answers).orderBy("seg_id")
    assert [(r.state, r.reason, r.draft) for r in done.collect()] == [("drafted", None, "T"), ("failed", "bad", None), ("failed", "no-text", None), ("drafted", None, ""), ("pending", None, None), ("skipped", None, None)]
    assert [r.seg_id for r in translate.shown(done).collect()] == ["k0"]
    assert translate.unmatched(answers.withColumn("page_id", F.lit(2)), segs).count() == 5


def test_pairs_and_engine(spark):
    wanted = spark.createDataFrame([("en", "x", "a"), ("fr", "x", "a"), ("de", "x", "a"), ("it", "x", "a"), ("en", "x", "a")], "`from` string, `to` string, source string")
    pairs = spark.createDataFrame([("en", "x", "installed"), ("fr", "x", "supported"), ("de", "x", "unsupported"), ("it", "x", "undetermined")], "`from` string, `to` string, status string")
    found = {r["from"]: r.pair_error for r in translate.pair_errors(wanted, pairs).collect()}
    assert found == {"en": None, "fr": "not downloaded: fr to x", "de": "unsupported pair: de to x", "it": None}

    def engine(a, b):
        if a == "de":
            raise ValueError("no model")
        return lambda s: s * 2

    made = {r["from"]: (r.text, r.error) for r in translate.by_engine(translate.distinct_work(wanted), engine).collect()}
    assert made == {"en": ("aa", None), "fr": ("aa", None), "de": (None, "no model"), "it": ("aa", None)}


def test_rendered_pages_are_not_collected_again(spark):
    html = '<html lang="zh-CN"><body><p>这是简体中文段落。</p><p>Plain <b>text</b> &amp; more</p><button>送出</button><div>loose <p>inner one</p> tail</div></body></html>'
    pages = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    before = segments(pages)
    drafted = before.withColumns({"state": F.lit("drafted"), "draft": F.concat(F.lit("T:"), "source")})
    done = render.render(pages, drafted)
    rows = {r.page_id: r.html for r in done.collect()}
    assert rows[2] is None
    assert rows[1].count('class="gm-translation"') == 4
    assert rows[1].index("T:tail") < rows[1].index("T:loose")
    after = [(r.source, r.state) for r in segments(done).orderBy("order").collect()]
    assert after == [(r.source, r.state) for r in before.orderBy("order").collect() if r.insert_mode == "after-segment"]
    drifted = drafted.withColumn("replace_snapshot", F.lit("other"))
    assert "data-gm-source" not in render.render(pages, drifted).filter("page_id = 1").first().html


def test_changed_pages(spark, tmp_path):
    old = segments(spark.createDataFrame([(1, "<p>same same</p><p>same same</p><p>old text</p>")], "page_id long, html string"))
    new = [(1, "u", "<p>same same</p><p>new text</p><p>same same</p><p>same same</p>")]
    spark.createDataFrame(new, streams.PAGES).write.parquet(str(tmp_path / "in"))
    got = []
    query = streams.changed_pages(streams.table_stream(spark, str(tmp_path / "in"), streams.PAGES), lambda: old, lambda df, _: got.extend(df.collect()), str(tmp_path / "ck"))
    query.awaitTermination()
    assert sorted((r.source, r.order) for r in got) == [("new text", 1), ("same same", 3)]


LOGS = {1: "TTTT", 2: "TTET", 3: "TCTT", 4: "TTTxS", 5: "TTTxT", 6: "EEEC"}
OUTCOMES = {"T": "timeout", "E": "error", "C": "cancelled", "S": "success"}


def log(spark):
    rows, start = [], dt.datetime(2024, 1, 1)
    for pair, marks in LOGS.items():
        at = start
        for k, m in enumerate(marks):
            at += dt.timedelta(seconds=70 if m == "x" else 5)
            if m != "x":
                rows.append((pair, "translate", 10 * pair + k, at, OUTCOMES[m]))
    return spark.createDataFrame(rows, "pair long, entry string, id long, ts timestamp, outcome string")


def brute(rows, threshold=3, seconds=60):
    """Streaks and cache by id, and the circuit of each key, one attempt after another."""
    streaks, cached, circuits, keys = {}, {}, {}, {}
    for pair, entry, number, at, outcome in sorted(rows, key=lambda r: (r[3], r[2])):
        s = keys.setdefault((pair, entry), [0, 0, None, 0, 0, 0])  # plain streak, streak, until, attempts, rejected, opened
        if outcome != "cancelled":
            s[0] = s[0] + 1 if outcome == "timeout" else 0
            streaks[number] = s[0]
        known = cached.get(pair, {None: False})
        now = True if (entry, outcome) == ("availability", "success") else False if (entry, outcome) == ("translate", "error") else known[None]
        cached[pair] = {**known, number: now, None: now}
        s[3] += 1
        if s[2] is not None and at < s[2]:
            s[4] += 1
        elif outcome == "timeout":
            s[1] += 1
            if s[1] >= threshold:
                s[5], s[2] = s[5] + 1, at + dt.timedelta(seconds=seconds)
        elif outcome in ("success", "error"):
            s[1], s[2] = 0, None
    return streaks, {n: v for own in cached.values() for n, v in own.items() if n is not None}, {k: (s[3], s[4], s[5], s[1]) for k, s in keys.items()}


def test_logs_in_ranges_agree_with_one_by_one(spark):
    """Few pairs, long logs, many ranges: what is carried between ranges is what a single pass carries."""
    import random

    rng, start = random.Random(5), dt.datetime(2024, 1, 1)
    rows = []
    for k in range(1500):
        pair = 1 if k % 3 else rng.randrange(2, 5)
        mostly = "timeout" if k // 300 % 2 else rng.choice(["success", "error", "timeout", "cancelled"])
        rows.append((pair, rng.choice(["translate", "availability"]), k, start + dt.timedelta(seconds=rng.randrange(0, 40_000)), mostly))
    df = spark.createDataFrame(rows, "pair long, entry string, id long, ts timestamp, outcome string").repartition(6)
    streaks, cached, circuits = brute(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert {r.id: r.streak for r in attempts.timeout_streaks(df).collect()} == streaks
        assert {r.id: r.cached for r in attempts.installed(df).collect()} == cached
        assert {(r.pair, r.entry): tuple(r)[2:6] for r in attempts.circuit(df).collect()} == circuits
        assert attempts.in_ranges(df, "pair").filter("pair = 1").select("part").distinct().count() > 3  # the hot pair is dealt
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_circuit_from_any_place(spark):
    """Dense and sparse logs of random outcomes in many small ranges, with ties, attempts without a moment, null keys and any threshold."""
    import random

    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for seed, (threshold, seconds, span) in enumerate([(3, 60, 4_000), (1, 60, 2_000), (2, 900, 3_000), (5, 10, 1_000), (3, 5_000, 3_000)]):
            rng, start = random.Random(seed), dt.datetime(2024, 1, 1)
            rows = [(rng.choice([1, 1, 1, None, 2]), rng.choice(["translate"] * 9 + ["availability"]), k, start + dt.timedelta(seconds=rng.randrange(span)), rng.choice(["timeout"] * rng.choice([2, 9, 30]) + ["success", "error", "cancelled"])) for k in range(600)]
            found = attempts.circuit(spark.createDataFrame(rows, "pair long, entry string, id long, ts timestamp, outcome string").repartition(3), threshold, seconds)
            assert {(r.pair, r.entry): tuple(r)[2:6] for r in found.collect()} == brute(rows, threshold, seconds)[2]
        # Without a moment an attempt is never rejected and its opening rejects nothing.
        odd = [(1, "translate", k, None, "timeout") for k in range(40)] + [(1, "translate", 50 + k, start + dt.timedelta(seconds=k), "success" if k == 30 else "timeout") for k in range(200)]
        assert [tuple(r)[2:] for r in attempts.circuit(spark.createDataFrame(odd, "pair long, entry string, id long, ts timestamp, outcome string")).collect()] == [(240, 59 + 59 + 59 + 19, 38 + 4, 44, start + dt.timedelta(seconds=240))]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_an_outage_takes_a_pass_and_a_join_for_each_doubling(spark, monkeypatch):
    """12 ranges of one outage: the log is read by one job, and four joins put the ranges together."""
    tables = []
    monkeypatch.setattr(attempts, "written", lambda df, name, own=attempts.written: tables.append(name) or own(df, name))
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        long = spark.range(30_000).selectExpr("1L AS pair", "'translate' AS entry", "id", "timestamp_seconds(id * 30) AS ts", "if(id % 20 = 7, 'success', 'timeout') AS outcome")
        found = [tuple(r)[2:6] for r in attempts.circuit(long.repartition(7)).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    start = dt.datetime(1970, 1, 1)
    assert found == [brute([(1, "translate", k, start + dt.timedelta(seconds=30 * k), "success" if k % 20 == 7 else "timeout") for k in range(30_000)])[2][1, "translate"]]
    assert tables == ["places", "runs", "steps", "steps", "steps", "steps", "steps"]


def test_long_circuit(spark):
    long = spark.range(30_000).selectExpr("1L AS pair", "'translate' AS entry", "id", "timestamp_seconds(id * 30) AS ts", "'timeout' AS outcome")
    rows = [tuple(r)[2:6] for r in attempts.circuit(long.repartition(7)).collect()]
    # Each opening, at attempts 2, 4, ... 29,998, rejects the one after it; the streak counts all that aren't rejected.
    assert rows == [(30_000, 14_999, 14_999, 15_001)]
    assert attempts.circuit(long.limit(0)).count() == attempts.timeout_streaks(long.limit(0)).count() == attempts.installed(long.limit(0)).count() == 0


def test_status(spark):
    at = dt.datetime(2024, 1, 1)
    logs = {1: [("availability", "success", "installed"), ("translate", "timeout", None)], 2: [("availability", "success", "supported")], 3: [("availability", "success", "installed"), ("translate", "error", None)], 4: [("availability", "success", "unsupported"), ("availability", "timeout", None)], 5: [("translate", "success", None)]}
    rows = [(p, e, 10 * p + k, at + dt.timedelta(seconds=k), o, r) for p, own in logs.items() for k, (e, o, r) in enumerate(own)]
    df = spark.createDataFrame(rows, "pair long, entry string, id long, ts timestamp, outcome string, result string")
    found = attempts.resolved_status(df, attempts.circuit(df), F.lit(at)).collect()
    # A real error clears what is known; the last answer still stands.
    assert {r.pair: r.status for r in found} == {1: "installed", 2: "supported", 3: "installed", 4: "undetermined", 5: "undetermined"}


def test_languages(spark):
    import pytest

    pairs = spark.createDataFrame([("en", "fr"), ("fr", "de"), (None, "en")], "`from` string, `to` string")
    assert [r.language for r in translate.languages(pairs).collect()] == ["de", "en", "fr"]
    with pytest.raises(Exception, match="no supported languages"):
        translate.languages(pairs.limit(0)).collect()


def test_drift(spark):
    old = segments(spark.createDataFrame([(1, "<p>same</p><p>old text</p><p>was text</p>")], "page_id long, html string"))
    new = segments(spark.createDataFrame([(1, "<p>same</p><p>new text</p><p>was <b>text</b></p>")], "page_id long, html string"))
    assert {r.source: r.drifted for r in render.drift(old, new).collect()} == {"same": False, "old text": True, "was text": True}


def test_buckets(spark, tmp_path):
    from glossmill.sources.stored import write_bucketed

    rows = spark.range(1000).withColumnRenamed("id", "page_id")
    stored = write_bucketed(rows, str(tmp_path / "b"), buckets=8)
    assert stored.select("page_id").distinct().count() == 1000 and stored.select("bucket").distinct().count() == 8


def ended(spark, stream, folder, **kept):
    """All rows of a circuit stream, its end included."""
    closing = streams.with_end(stream, f"{folder}/end")
    circuits = streams.circuit_stream(closing, **kept)
    streams.once(circuits, folder)
    streams.end_stream(stream, f"{folder}/end")
    return streams.once(circuits, folder)


def test_pages_are_dealt_by_bytes(spark):
    """One large page among 10,000 small ones has a task to itself, and the others share the rest evenly."""
    from glossmill.sources.stored import by_bytes, spread

    rows = spark.range(10_001).select(F.col("id").alias("page_id"), F.expr("if(id = 77, repeat('x', 5000000), repeat('y', 1000))").alias("html"))
    parts = by_bytes(rows, "page_id", "html", 8).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.sum(F.length("html")).alias("bytes"), F.max("page_id").alias("top")).collect()
    assert sum(p.n for p in parts) == 10_001 and len(parts) >= 6
    rest = sorted(p.bytes for p in parts)[:-1]
    assert max(p.bytes for p in parts) < 5_100_000 and rest[-1] < 2_000_000 and rest[1] > 1_000_000
    assert by_bytes(rows.limit(0), "page_id", "html", 4).count() == 0 and spread(rows.coalesce(1), "page_id", "html").count() == 10_001


def test_joins_by_page_need_no_exchange(spark):
    """What is stored in page buckets meets without a shuffle: responses, an older version, drifted anchors and the pages themselves."""
    from glossmill.sources.stored import page_buckets, spread

    pages = spark.createDataFrame([(k, f"<p>same same</p><p>words {k}</p><p>same same</p>") for k in range(40)], "page_id long, html string")
    old, new = (page_buckets(segments(p), "segments") for p in (pages, pages.withColumn("html", F.replace("html", F.lit("words"), F.lit("other")))))
    answers = page_buckets(old.select("page_id", "seg_id", F.lit("T").alias("text"), F.lit(None).cast("string").alias("error")), "answers")
    stored = page_buckets(pages, "pages")
    assert spread(stored.repartition(1).limit(0)).count() == 0 and spread(stored) is stored  # few buckets stay as they are
    done = translate.applied(old, answers)
    keep = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        made = {"apply": done.groupBy("page_id", "state").count(), "fresh": render.fresh(new, old), "drift": render.drift(old, new), "render": render.render(stored, done), "unmatched": translate.unmatched(answers, old)}
        for name, df in made.items():
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "SortMergeJoin" in plan, (name, plan)
    finally:
        for c, v in keep.items():
            spark.conf.set(c, v)
    assert made["fresh"].count() == 40 and made["drift"].filter("drifted").count() == 40 and made["unmatched"].count() == 0
    assert made["apply"].filter("state = 'drafted'").agg(F.sum("count")).first()[0] == 120
    assert made["render"].filter("html like '%gm-translation%'").count() == 40


def test_circuit_batch_and_stream_agree(spark, tmp_path):
    found = {r.pair: (r.rejected, r.opened, r.streak) for r in attempts.circuit(log(spark)).collect()}
    assert found == {1: (1, 1, 3), 2: (0, 0, 1), 3: (0, 1, 3), 4: (0, 1, 0), 5: (0, 2, 4), 6: (0, 0, 0)}
    log(spark).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log(spark).schema).parquet(str(tmp_path / "log"))
    rows = ended(spark, stream, str(tmp_path / "out")).groupBy("pair").agg(F.count_if("rejected").alias("rejected"), F.max_by("streak", "id").alias("streak"))
    assert {r.pair: (r.rejected, r.streak) for r in rows.collect()} == {p: (v[0], v[2]) for p, v in found.items()}


def test_circuit_stream_of_shuffled_files_is_in_event_time_order(spark, tmp_path):
    """Six files, each with attempts of the whole time, taken in one batch each: every attempt comes out as if the log had been in order."""
    import random

    rng, start = random.Random(11), dt.datetime(2024, 1, 1)
    rows = [(rng.choice([1, 1, 2]), "translate", k, start + dt.timedelta(seconds=rng.randrange(6_000)), rng.choice(["timeout"] * 8 + ["success", "error", "cancelled"])) for k in range(600)]
    schema = "pair long, entry string, id long, ts timestamp, outcome string"
    for k in range(6):
        spark.createDataFrame(rows[100 * k : 100 * k + 100], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    found = {r.id: (r.rejected, r.streak) for r in ended(spark, stream, str(tmp_path / "out"), late="2 hours").collect()}
    state, expected = {}, {}
    for pair, _, number, at, outcome in sorted(rows, key=lambda r: (r[3], r[2])):
        micros = int((at - start).total_seconds()) * 1_000_000 + 1
        state[pair], rejected = streams.settle(state.get(pair, (0, 0)), micros, outcome)
        expected[number] = (rejected, state[pair][0])
    assert found == expected
    assert sum(r for r, _ in found.values()) == sum(r.rejected for r in attempts.circuit(spark.createDataFrame(rows, schema)).collect())


def test_circuit_stream_counts_late_rows_and_forgets_idle_pairs(spark, tmp_path):
    import pytest

    start, schema = dt.datetime(2024, 1, 1), "pair long, entry string, id long, ts timestamp, outcome string"

    def put(k, pair, minutes):
        spark.createDataFrame([(pair, "translate", k, start + dt.timedelta(minutes=minutes), "timeout")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))

    for k, (pair, minutes) in enumerate([(1, 0), (1, 1), (2, 60), (2, 61)]):
        put(k, pair, minutes)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    circuits = lambda: streams.circuit_stream(stream, late="10 minutes", idle="1 day")
    assert {(r.id, r.streak) for r in streams.once(circuits(), str(tmp_path / "out")).collect()} == {(0, 1), (1, 2)}
    put(4, 2, 4_000)  # more than a day on: both are forgotten
    put(5, 1, 4_001)
    put(6, 2, 9_000)
    assert {(r.id, r.streak) for r in streams.once(circuits(), str(tmp_path / "out")).collect()} == {(0, 1), (1, 2), (2, 1), (3, 2), (4, 1), (5, 1)}
    put(7, 1, 5)
    with pytest.raises(ValueError, match="1 rows came later"):
        streams.once(circuits(), str(tmp_path / "out"))


def test_streaks_and_cache(spark):
    assert {r.pair: r.streak for r in attempts.timeout_streaks(log(spark)).groupBy("pair").agg(F.max_by("streak", "id").alias("streak")).collect()} == {1: 4, 2: 1, 3: 3, 4: 0, 5: 4, 6: 0}
    at = dt.datetime(2024, 1, 1)
    rows = [(1, e, k, at + dt.timedelta(seconds=k), o) for k, (e, o) in enumerate([("availability", "success"), ("translate", "timeout"), ("translate", "cancelled"), ("translate", "error"), ("availability", "timeout")])]
    cached = attempts.installed(spark.createDataFrame(rows, "pair long, entry string, id long, ts timestamp, outcome string")).orderBy("id")
    assert [r.cached for r in cached.collect()] == [True, True, True, False, False]


def test_nearest_ranks_over_many_ranges(spark):
    """Keys over many ranges, with repeated values, nulls, a null key, and a key of one sample, against sorted lists."""
    import math
    import random

    rng = random.Random(3)
    rows = [(rng.choice(["a"] * 6 + ["b", None]), rng.choice([None, 0.5, rng.random(), rng.randrange(40) / 4])) for _ in range(4_000)] + [("one", 7.0), ("none", None)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        quantiles = {"p0": 0.0, "p1": 0.01, "p50": 0.5, "p95": 0.95, "p100": 1.0}
        found = {r.k: tuple(r)[1:] for r in metrics.nearest_ranks(spark.createDataFrame(rows, "k string, v double"), "k", "v", quantiles).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    own = {k: sorted(v for key, v in rows if key == k and v is not None) for k in ("a", "b", None, "one")}
    assert found == {k: tuple(v[max(1, math.ceil(q * len(v))) - 1] for q in quantiles.values()) for k, v in own.items()}
    plan = metrics.nearest_ranks(spark.createDataFrame(rows, "k string, v double"), "k", "v", quantiles)._jdf.queryExecution().toString()
    assert "percentile" not in plan and "collect" not in plan


def test_metrics(spark):
    samples = spark.createDataFrame([("a", float(x)) for x in range(30)] + [("z", 0.0)], "run string, ms double")
    made = {r.run: r for r in metrics.timing_summary(samples, "run", "ms").collect()}
    assert (made["a"].least, made["a"].p50, made["a"].p95, made["a"]["mean"]) == (0.0, 14.0, 28.0, 14.5)
    assert made["z"].cv == 0.0
    rows = [("same", 1.0, 1.0, 0.1, "e"), ("slow", 1.4, 1.0, 0.1, "e"), ("noisy", 9.0, 9.0, 0.2, "e"), ("moved", 9.0, 9.0, 0.1, "f")]
    now = spark.createDataFrame(rows, "run string, p50 double, p95 double, cv double, env string")
    base = spark.createDataFrame([(r[0], 1.0, 1.0, 0.1, "e") for r in rows], now.schema)
    assert {r.run: r.verdict for r in metrics.timing_gate(now, base, "run").collect()} == {"same": "pass", "slow": "fail", "noisy": "not judged", "moved": "not judged"}
    a, b = (spark.createDataFrame(x, "key string, value long") for x in ([("p", 1), ("q", 2)], [("q", 3), ("r", 1), ("p", 1)]))
    assert {r.key for r in metrics.counter_diff(a, b).collect()} == {"q", "r"}


def test_known_table_is_kept_up_exactly_once(spark, tmp_path):
    """Three versions of some pages; a batch run again gives the same, wherever it had failed; pages that lose all text leave no rows."""
    import pytest

    from glossmill.streaming.known import KnownSegments

    def pages(**html):
        return spark.createDataFrame([(int(k[1:]), "u", h) for k, h in html.items()], streams.PAGES)

    known = KnownSegments(spark, str(tmp_path / "known"), buckets=2)
    batches = [pages(p1="<p>one one</p><p>two</p>", p2="<p>same here</p>", p3="<p>third page</p>"), pages(p1="<p>one one</p><p>two</p><p>two</p>", p3=""), pages(p1="<p>two</p><p>new words</p>", p3="<p>third page</p>", p4=None)]
    expected = [{(1, "one one"), (1, "two"), (2, "same here"), (3, "third page")}, {(1, "two")}, {(1, "new words"), (3, "third page")}]
    schema = None
    for n, batch in enumerate(batches):
        got = []
        sink = lambda df, _: got.append(sorted((r.page_id, r.source) for r in df.collect()))  # noqa: B023, E731

        def failing(df, _):
            raise OSError("sink is down")

        with pytest.raises(OSError, match="down"):
            known.update(batch, n, failing)
        tables = []
        for _ in range(2):
            known.update(batch, n, sink)
            table = spark.read.parquet(known.path)
            schema = schema or table.schema
            tables.append(sorted(map(str, table.collect())))
        assert got == [sorted(expected[n])] * 2 and tables[0] == tables[1]
    now = known.before(known.table(schema), 99).filter("seg_id is not null")
    assert sorted((r.page_id, r.source) for r in now.collect()) == [(1, "new words"), (1, "two"), (2, "same here"), (3, "third page")]
    assert max(r["count"] for r in known.table(schema).select("page_id", "batch").distinct().groupBy("page_id").count().collect()) == 2
    plan = known.table(schema, [1])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters:")[1][:60]


def test_memory_under_skew(spark):
    """One text in most requests is looked up without a shuffle; null and long texts, texts that the memory lacks, and further columns."""
    texts = ["Home"] * 900 + ["x" * 2_000] * 60 + [f"text {k}" for k in range(60)] + [None, "Home"]
    rows = [(k, "en" if k % 5 else "fr", "de", t) for k, t in enumerate(texts)]
    wanted = spark.createDataFrame(rows, "n int, `from` string, `to` string, source string")
    known = [(a, "de", t, f"{a}:{t[:9]}") for a in ("en", "fr") for t in ["Home", "x" * 2_000, *(f"text {k}" for k in range(0, 60, 2))] if (a, t) != ("fr", "Home")]
    memory = spark.createDataFrame(known, "`from` string, `to` string, source string, text string")
    book = {k[:3]: k[3] for k in known}
    found = translate.by_memory(wanted, memory)
    assert sorted((r.n, r.text) for r in found.collect()) == [(n, book.get((a, b, t))) for n, a, b, t in rows]
    assert {r.source for r in translate.common_texts(wanted).collect()} == {"Home"}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = translate.by_memory(wanted, memory)._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("BroadcastHashJoin") >= 2 and plan.count("SortMergeJoin [_key") == 1


def test_engine_calls_are_a_log_of_attempts(spark):
    """Timeouts, errors and cancelled calls are told apart; a raised failure is that of all texts of the call; logs feed the other jobs."""

    def engine(a, b):
        if a == "xx":
            raise ValueError("no model")

        def run(texts):
            assert len(texts) <= 4
            if a == "slow":
                raise TimeoutError
            if a == "odd":
                return texts[:-1]
            return [translate.Cancelled("stop") if t == "stop" else RuntimeError("bad") if t == "bad" else t.upper() for t in texts]

        return run

    rows = [("en", "de", t) for t in ["a", "b", "stop", "bad", "c", "d"]] + [("slow", "de", str(k)) for k in range(9)] + [("xx", "de", "a"), ("odd", "de", "a")]
    work = spark.createDataFrame(rows, "`from` string, `to` string, source string")
    answers, log = translate.translated(work, engine, batch=4, salts=3)
    found = {(r["from"], r.source): (r.text, r.error, r.outcome) for r in answers.collect()}
    assert len(found) == len(rows)
    assert found["en", "a"] == ("A", None, "success") and found["en", "stop"] == (None, "stop", "cancelled") and found["en", "bad"] == (None, "bad", "error")
    assert found["slow", "3"] == (None, "TimeoutError", "timeout") and found["xx", "a"] == (None, "no model", "error") and found["odd", "a"][2] == "error"
    assert log.count() == log.select("id").distinct().count() == len(rows)
    assert {r.pair: (r.attempts, r.opened > 0) for r in attempts.circuit(log).collect()} == {"en to de": (6, False), "slow to de": (9, True), "xx to de": (1, False), "odd to de": (1, False)}
    assert attempts.timeout_streaks(log).filter("pair = 'slow to de'").agg(F.max("streak")).first()[0] == 9
    assert translate.translated(work.limit(0), engine)[0].count() == 0
