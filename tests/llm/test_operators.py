"""The ten operators against brute force on small tables, with nulls, empty and long texts, repeated rows and empty tables."""

from __future__ import annotations

import io
import math
import time
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from glossmill.llm import bpe, components, counts, jaccard, media, packing, pii, quality, secrets, sharding, shared, substrings


def tuples(df):
    return [tuple(r) for r in df.collect()]


def query(name):
    return next(q for n, q in __spark_entry__.queries().items() if n.startswith(name))


def test_op1_shards(spark, rows, folder):
    found = query("op1_")(spark, folder).collect()
    texts = dict(rows)
    assert len(found) == len(rows)
    slots = defaultdict(list)
    for r in found:
        raw = shared.utf8(texts[r.doc_id])
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        assert 0 <= r.shard < 40
        slots[r.shard].append((r.slot, r.doc_id))
    assert all(sorted(s)[k][0] == k for s in slots.values() for k in range(len(s)))
    order = [i for s in sorted(slots) for _, i in sorted(slots[s])]
    assert order == sorted(texts)


def test_op1_even_sizes_and_repeats(spark, empty):
    many = spark.createDataFrame([(None if k % 3 else 5, "x" * (k % 7)) for k in range(3000)], "doc_id long, text string")
    found = sharding.byte_shards(many, 10).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("slot").alias("top")).collect()
    assert len(found) == 10
    assert max(r.b for r in found) - min(r.b for r in found) <= 2 * (16 + 6)
    assert all(r.top == r.n - 1 for r in found)
    assert sharding.byte_shards(empty, 4).count() == 0


def test_op2_base_and_more(spark, rows, folder, docs, empty):
    found = {r[0]: r for r in tuples(query("op2_")(spark, folder))}
    assert {i: r[1:6] for i, r in found.items()} == {i: brute.personal(t) for i, t in rows}
    assert found[20][6] == "iban:5:32,national_id:37:48" and "\n" not in found[20][6]
    assert pii.redact(docs).columns == docs.columns
    texts = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert texts[20] == "IBAN [IBAN] ssn [NATIONAL_ID]"
    assert texts[19].count("[EMAIL]") == 3
    assert texts[1] is None and texts[7] == dict(rows)[7]
    assert pii.detect(empty).count() == 0


def test_op2_kinds_that_begin_together_are_in_listed_order(spark):
    texts = ["10.0.0.1@host.com", "+15551234567@carrier.net", "4111111111111111@mail.com"]
    found = pii.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    kinds = [[(s["start"], s["kind"]) for s in r.pii if s["base"]] for r in found]
    assert kinds == [[(0, "email"), (0, "ip")], [(0, "email"), (0, "phone")], [(0, "email"), (0, "card")]]
    for text, r in zip(texts, found, strict=True):
        listed = ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in r.pii if s["base"])
        assert brute.sha(listed) == brute.personal(text)[-1]


PERSONAL = [
    "call 555-123-4567, 555-123-4567 or fax: 555.123.4568; ssn 123-45-6789 and 123-45-6789 a@b.cc",
    "DE89 3704 0044 0532 0130 00 EUR, de89 GB82 WEST 1234 5698 7654 32 and GB82WEST12345698765433 NO9386011117947",
    "é😀 4111111111111111@mail.com phone 4111-1111-1111-1111 10.0.0.1@host.com +15551234567@carrier.net",
    "ssn 123-45-6789@x.yz iban DE89370400440532013000@x.yz", "", None, "a@b.cc", "x a@b.cc", "a@b.cc" * 3, "İ call 555-123-4567",
]


def test_op2_all_spans_and_redacted_texts(spark, rows):
    table = [*rows, *((100 + k, t) for k, t in enumerate(PERSONAL)), (None, PERSONAL[0]), (None, PERSONAL[0])]
    df = spark.createDataFrame(table, "doc_id long, text string")
    wanted = [(i, t, brute.more_personal(t, pii.IBAN_LENGTHS)) for i, t in table]
    found = pii.detect(df).select("doc_id", F.transform("pii", lambda s: F.struct(s["start"], s["kind"], s["end"])).alias("s")).collect()
    assert Counter((r.doc_id, tuple(tuple(s) for s in r.s)) for r in found) == Counter((i, tuple(s)) for i, _, s in wanted)
    assert Counter(tuples(pii.redact(df))) == Counter((i, brute.redacted(t, s)) for i, t, s in wanted)


def test_op2_work_grows_with_the_spans(spark):
    def seconds(n):
        df = spark.createDataFrame([(1, " ".join(f"é user{k}@host{k % 7}.org {k % 255}.1.1.{k % 99} iban DE89 3704 0044 0532 0130 00" for k in range(n)))], "doc_id long, text string")
        df.write.mode("overwrite").parquet(f"{shared.shared_dir(spark)}/many")
        df = spark.read.parquet(f"{shared.shared_dir(spark)}/many")
        began = time.time()
        text = pii.redact(df).first().text
        took = time.time() - began
        assert text.startswith("é [EMAIL] [IP] iban [IBAN] é") and text.count("[EMAIL]") == text.count("[IP]") == text.count("[IBAN]") == n
        return took

    seconds(100)
    small, large = seconds(1_000), seconds(10_000)
    assert large < 40 * max(small, 0.5)


def test_op2_checksums(spark):
    good = spark.createDataFrame([("GB82 WEST 1234 5698 7654 32", True), ("GB82 WEST 1234 5698 7654 33", False)], "t string, ok boolean")
    assert all(r[0] == r[1] for r in good.select("ok", pii.confirmed("iban", F.col("t"))).collect())


def test_op3_components(spark, rows, folder, docs, empty):
    assert Counter(tuples(query("op3_")(spark, folder))) == Counter(brute.components(rows))
    assert jaccard.similar_components(empty).count() == 0


def test_op3_repeated_and_null_ids(spark):
    odd = [(None, "one two"), (None, None), (7, "one two"), (7, "one two"), (7, ""), (3, "a b c d e f"), (None, "a b c d e f"), (9, None)]
    found = jaccard.similar_components(spark.createDataFrame(odd, "doc_id long, text string"))
    assert Counter(tuples(found)) == Counter(brute.components(odd))


@pytest.mark.parametrize("pivots", [0, 3, 40, 1_024])
def test_op3_cells_of_any_number_of_pivots(spark, rows, monkeypatch, pivots):
    monkeypatch.setattr(jaccard, "DOC_PIVOTS", pivots)
    table = [*rows, *families(4, 50), *((5000 + k, t) for k, (_, t) in enumerate(families(5, 20)))]
    found = jaccard.similar_components(spark.createDataFrame(table, "doc_id long, text string"))
    assert Counter(tuples(found)) == Counter(brute.components(table))


def test_op3_cells_have_the_window_and_no_more(spark):
    """A chain of sets, each close to the next: one pivot, and replicas that are close to points of its cell but not to it."""
    chain = [np.arange(3 * k, 3 * k + 60, dtype=np.uint64) for k in range(12)]
    pivots = jaccard.Pivots([chain[0]])
    close = pivots.close(chain)
    for s, own in zip(chain, close, strict=True):
        both = len(np.intersect1d(s, chain[0]))
        d = 1 - both / (120 - both)
        assert own == ([(0, pytest.approx(d))] if d <= 0.4 else [])
    assert pivots.close([]) == [] and jaccard.Pivots([]).close(chain[:2]) == [[], []]
    fp = int(pivots.fp[0])
    table = [(k, *((fp, c[0][1], []) if c and c[0][1] <= 0.2 else (None, None, [(fp, c[0][1])] if c else []))) for k, c in enumerate(close)]
    cells = jaccard.cells(spark.createDataFrame(table, "fp long, home long, away double, shell array<struct<p: long, d: double>>"))
    found = {(r.fp, r.label == fp) for r in cells.collect()}
    core, shell = {k for k, h, *_ in table if h}, {k for k, _, _, s in table if s}
    assert shell and {k for k, inner in found if not inner} == {k for k in shell if close[k][0][1] <= max(close[c][0][1] for c in core) + 0.2 + 1e-9}
    assert {k for k, inner in found if inner} == {c for c in core if close[c][0][1] >= min(close[k][0][1] for k in shell) - 0.2 - 1e-9} < core


def test_op3_null_ids_cost_as_much_as_others(spark):
    def seconds(ids):
        df = spark.createDataFrame([(i, t) for i, (_, t) in zip(ids, families(6, 600), strict=True)], "doc_id long, text string")
        began = time.time()
        assert jaccard.similar_components(df).count() == 600
        return time.time() - began

    seconds(range(600))
    assert max(seconds([None] * 600), seconds([7] * 600)) < 3 * seconds(range(600)) + 5


def test_op3_large_groups_take_pivot_steps(spark, rows, monkeypatch):
    monkeypatch.setattr(jaccard, "DOC_PIVOTS", 5)
    monkeypatch.setattr(jaccard, "GROUP_HASHES", 100)
    chain = [(100 + k, " ".join(f"c{j}" for j in range(3 * k, 3 * k + 60))) for k in range(8)]
    table = [*rows, *chain]
    assert Counter(tuples(jaccard.similar_components(spark.createDataFrame(table, "doc_id long, text string")))) == Counter(brute.components(table))


def families(seed, n):
    """Texts of near copies, more and less alike, of one text, and of others that have only a passage in common."""
    rng = np.random.default_rng(seed)
    base = [f"f{k}" for k in range(80)]
    out = []
    for k in range(n):
        words = base[:]
        for at in rng.choice(80, int(rng.integers(0, 5)), replace=False):
            words[at] = f"x{k}at{at}"
        out.append((1000 + k, " ".join(words if k % 5 else [*base[:9], *(f"y{k}n{j}" for j in range(4))])))
    return out


def test_op3_large_regions_are_dealt(spark, rows, monkeypatch):
    monkeypatch.setattr(jaccard, "DOC_PIVOTS", 0)
    monkeypatch.setattr(jaccard, "REGION_POINTS", 6)
    monkeypatch.setattr(jaccard, "PIVOTS", 3)
    monkeypatch.setattr(jaccard, "CHUNK", 4)
    most, before = [], jaccard.region_edges

    def seen(members):
        most.append(members.groupBy("region").count().agg(F.max("count")).first()[0])
        return before(members)

    monkeypatch.setattr(jaccard, "region_edges", seen)
    table = [*rows, *families(3, 60)]
    assert Counter(tuples(jaccard.similar_components(spark.createDataFrame(table, "doc_id long, text string")))) == Counter(brute.components(table))
    assert most[0] <= 6


def test_op3_rounds_for_a_spread_family_are_few(spark, monkeypatch):
    """Distances spread around the limit: one pivot a step would take about as many steps as sets."""
    monkeypatch.setattr(jaccard, "REGION_POINTS", 50)
    monkeypatch.setattr(jaccard, "GROUP_HASHES", 2_000)
    rng = np.random.default_rng(11)
    bases = [rng.integers(0, 2**63, 200, dtype=np.uint64) for _ in range(3)]
    sets = [np.unique(np.concatenate([bases[k % 3][rng.random(200) > 0.06], rng.integers(0, 2**63, int(rng.integers(4, 16)), dtype=np.uint64)])) for k in range(300)]
    steps, before = [], jaccard.written
    monkeypatch.setattr(jaccard, "written", lambda df, name: steps.append(name) or before(df, name))
    members = spark.createDataFrame([(1, k, len(s), s.tobytes(), k) for k, s in enumerate(sets)], "grp long, fp long, n long, elements binary, label long")
    links = tuples(jaccard.exact_links(members))
    assert sum(name.endswith("-pivots") for name in steps) <= 8

    def roots(pairs):
        root = list(range(len(sets)))
        for a, b in pairs:
            root = [root[b] if r == root[a] else r for r in root]
        return [root.index(r) for r in root]

    close = [(a, b) for a in range(len(sets)) for b in range(a) if jaccard.linked(len(sets[a]), np.array(len(sets[b])), np.array(len(np.intersect1d(sets[a], sets[b]))))]
    assert len(sets) < len(close) < len(sets) * (len(sets) - 1) / 6
    assert len(set(roots(close))) >= 3
    assert roots(links) == roots(close)


def test_op3_regions_hold_all_close_pairs():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(400) > 0.08], rng.integers(0, 2**63, int(rng.integers(0, 60)), dtype=np.uint64)])) for _ in range(40)]
    sets += [np.unique(rng.integers(0, 2**63, int(rng.integers(1, 3000)), dtype=np.uint64)) for _ in range(30)]
    fp = np.arange(len(sets))
    edges = jaccard.leader_edges(fp, np.array([len(s) for s in sets]), [jaccard.sketch(s) for s in sets])
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in edges:
        root[find(a)] = find(b)
    close = [(a, b) for a in range(len(sets)) for b in range(a) if jaccard.linked(len(sets[a]), np.array(len(sets[b])), np.array(len(np.intersect1d(sets[a], sets[b]))))]
    assert close and all(find(a) == find(b) for a, b in close)
    exact = jaccard.join_group(sets)
    assert all(exact[a] == exact[b] for a, b in close)
    assert len(edges) < len(sets)


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(500, 501), (501, 500), (7, 7)]
    found = dict(tuples(components.components(spark.createDataFrame(edges, "a long, b long"), "test")))
    assert found == {**{k: 0 for k in range(1, 41)}, **{k: 100 for k in range(101, 140)}, 501: 500}


def test_op4_measures_and_verdict(spark, rows, folder, empty):
    found = {r[0]: r for r in tuples(query("op4_")(spark, folder))}
    assert {i: r[1:7] for i, r in found.items()} == {i: brute.quality(t) for i, t in rows}
    assert all(not (r[6] and r[7]) for r in found.values())
    assert found[13][7] and found[9][7]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.judge(empty, labels).count() == 0
    plain = quality.judge(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert {r.row.doc_id for r in plain.filter("kept").collect()} == {i for i, t in rows if not brute.quality(t)[5]}


def test_op4_scores(spark, rows):
    table = [*rows, (None, "one two three four five six seven eight nine ten eleven"), (13, "other words " * 3)]
    labels = spark.createDataFrame([(i, 1, int(i == 7)) for i, _ in rows[:26]] + [(27, 0, 0), (28, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(table, "doc_id long, text string")
    for own in (labels, labels.limit(0)):
        trusted = {r.doc_id for r in quality.trusted_ids(own).collect()}
        judged = {r.doc_id: r.good for r in quality.judged_ids(own).collect()}
        assert not trusted & {i for i, g in judged.items() if g} and (trusted | {i for i, g in judged.items() if g}) == ({i for i, _ in rows[:26]} - {7} if own is labels else set())
        wanted = brute.log_ratio_scores(table, trusted, quality.BUCKETS)
        least = quality.threshold([(s, judged[i]) for (i, _), s in zip(table, wanted, strict=True) if i in judged])
        score = {(i, t): s for (i, t), s in zip(table, wanted, strict=True)}
        for r in quality.judge(df, own).select("row.*", "score", "kept", "base_failed").collect():
            assert r.score == pytest.approx(score[r.doc_id, r.text], abs=2e-6)
            assert r.kept == (not r.base_failed and r.score >= least)


def test_op4_threshold():
    assert quality.threshold([]) == quality.threshold([(0.1, True)]) == quality.threshold([(0.1, False)]) == quality.LEAST
    assert quality.threshold([(-1.0, False), (-0.8, False), (-0.2, True), (0.0, True)]) == -0.5
    # One bad row above all good ones isn't worth them; a good row below most bad ones is.
    assert quality.threshold([(-1.0, False), (0.0, True), (0.1, True), (0.3, False)]) == -0.5
    assert quality.threshold([(-2.0, True), *((-1.0 - k / 100, False) for k in range(20)), *((0.1 + k / 100, True) for k in range(300))]) == pytest.approx(-0.45)


def test_clashing_columns(spark, docs):
    clash = docs.withColumns({n: F.lit("mine") for n in ("score", "n_words", "base_failed", "pii", "shard", "fate", "cut", "text_crc32", "n_chars")})
    labels = spark.createDataFrame([(13, 1, 0)], "doc_id long, quality int, toxic int")
    kept = quality.judge(clash, labels).filter("kept").select("row.*")
    assert kept.columns == clash.columns and kept.select("kept", "score").first() == (1, "mine")
    assert pii.redact(clash).select("pii").first()[0] == "mine"
    assert "pii" in pii.detect(clash).columns
    assert substrings.cut_repeats(clash).columns == clash.columns
    assert jaccard.similar_components(clash).count() == sharding.byte_shards(clash, 3).count() == clash.count()


def test_op4_separates_labelled_rows(spark):
    folder = brute.DATA.replace("0.001", "0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    found = query("op4_")(spark, folder).collect()
    good = [r.kept or r.base_failed for r in found if labels.get(r.doc_id) == 1]
    bad = [r.kept for r in found if labels.get(r.doc_id) == 0]
    assert all(good)
    assert sum(bad) <= 0.1 * len(bad)


def test_op5_windows(spark, rows, folder, empty):
    assert Counter(tuples(query("op5_")(spark, folder))) == Counter(brute.without_repeats(rows))
    assert [d.count() for d in substrings.dedup(empty)] == [0, 0]


@pytest.mark.parametrize("start", [5, 10])
def test_op5_levels(spark, rows, monkeypatch, start):
    monkeypatch.setattr(substrings, "START", start)
    names, before = [], substrings.written
    monkeypatch.setattr(substrings, "written", lambda df, name: names.append(name) or before(df, name))
    both, cut = substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {r.doc_id: (r.n_words if r.fate == "removed" else r.n_removed or 0) for r in both.join(cut, ["doc", "tie"], "left").collect()}
    assert found == {r[0]: r[2] for r in brute.without_repeats(rows)}
    assert [n for n in names if n[-1] in "05"] == [f"substrings-{w}" for w in (5, 10, 20) if w >= start]
    names.clear()
    plain = spark.createDataFrame([(k, " ".join(f"u{k}x{j}" for j in range(60))) for k in range(5)], "doc_id long, text string")
    assert substrings.dedup(plain)[1].count() == 0
    assert [n for n in names if n[-1] in "05"] == [f"substrings-{start}"]  # nothing is left for the next level


def test_op5_windows_of_equal_hash_are_told_apart(spark, rows, monkeypatch):
    """With hashes of few bits on the last level, only the second hash decides."""
    monkeypatch.setattr(substrings.Windows, "of", lambda self, width, own=substrings.Windows.of: own(self, width) if width < substrings.LENGTH else own(self, width) & np.uint64(3))
    table = [r for r in rows if r[0] not in (7, 8)] + [(50 + k, " ".join(f"v{k}x{j}" for j in range(40)) + " " + rows[8][1]) for k in range(6)]
    both, cut = substrings.dedup(spark.createDataFrame(table, "doc_id long, text string"))
    found = {r.doc_id: (r.n_words if r.fate == "removed" else r.n_removed or 0) for r in both.join(cut, ["doc", "tie"], "left").collect()}
    assert found == {r[0]: r[2] for r in brute.without_repeats(table)}


def test_op5_repeated_and_null_ids(spark):
    text = " ".join(f"p{k}" for k in range(40))
    odd = [(5, text), (5, text), (None, f"x {text}"), (None, None), (2, "z " + " ".join(f"p{k}" for k in range(5, 30)))]
    rows, cut = substrings.dedup(spark.createDataFrame(odd, "doc_id long, text string"))
    both = rows.join(cut, ["doc", "tie"], "left").select("doc_id", "fate", "n_removed")
    assert Counter(tuples(both)) == Counter([(5, "cut", 25), (5, "cut", 25), (None, "cut", 40), (None, "kept", None), (2, "kept", None)])


def test_op5_texts(spark, rows):
    table = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long")
    found = {r.doc_id: r for r in substrings.cut_repeats(table).collect()}
    removed = {r[0]: r for r in brute.without_repeats(rows)}
    assert set(found) == {i for i, r in removed.items() if r[1] == 0 or r[2] < r[1]}
    for i, r in found.items():
        assert brute.sha(" ".join(brute.WORD.findall(r.text or ""))) == removed[i][3]
        assert r.n_chars == len(r.text or "")


def test_op6_parts_and_single_case_alphabets(spark):
    rng = np.random.default_rng(4)
    base62, base36, letters = (("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")

    def drawn(alphabet, n):
        return "".join(rng.choice(list(alphabet), n))

    found = total = 0
    for alphabet, form in [(base62, "aws_session_access_id={}"), (base62, "sig={}"), (base62, "srv/my_files/{}"), (base36, "{}"), (base36.upper(), "{}"), (letters, "{}"), (letters, "AUTH={}==")]:
        values = [drawn(alphabet, 64) for _ in range(20)]
        rows = [(k, f"see {form.format(v)} here") for k, v in enumerate(values)]
        spans = {r.doc_id: [(s["start"], s["end"]) for s in r["all"]] for r in secrets.secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        good = [any(rows[k][1][a:b].rstrip("=") == v for a, b in spans[k]) for k, v in enumerate(values)]
        assert sum(good) >= 17, form
        found, total = found + sum(good), total + len(good)
    assert found >= 0.92 * total
    words = [(k, "internationalization-of-things=configuration_of_environments/somewhere") for k in range(50)]
    assert all(not r["all"] for r in secrets.secrets(spark.createDataFrame(words, "doc_id long, text string")).collect())


def test_op6_base_and_random(spark, rows, folder, empty):
    found = {r[0]: r for r in tuples(query("op6_")(spark, folder))}
    assert {i: r[1:5] for i, r in found.items()} == {i: brute.secret_base(t) for i, t in rows}
    key = "dGhpcyBpcyBhIHNlY3JldCBrZXkh9aZx8Qw7Lp0Kt3Vb2"
    more = secrets.secrets(spark.createDataFrame([(1, f"see {key} here and internationalization-of-things")], "doc_id long, text string")).first()
    assert [tuple(s) for s in more["all"]] == [(4, 4 + len(key), 3)]
    assert secrets.secrets(empty).count() == 0


def test_op6_tokens_of_any_length(spark):
    rng = np.random.default_rng(8)
    alphabet = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    rows = [(n, f"see {''.join(rng.choice(alphabet, n))} here") for n in (10, 40, 1_100, 100_000, 1_000_000)] + [(0, "x" * 1_000_000), (1, "word-" * 200_000)]
    began = time.time()
    found = {r.doc_id: [(s["start"], s["end"]) for s in r["all"]] for r in secrets.secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert time.time() - began < 60
    assert found == {n: [(4, 4 + n)] if n >= 40 else [] for n, _ in rows}


def test_op6_findings_follow_the_step_up_rule(spark):
    """The histogram's rule against Benjamini and Hochberg's on the p-values themselves."""
    rng = np.random.default_rng(9)
    rows = [(int(size), int(level), bool(keep)) for size, level, keep in zip(rng.integers(0, 3, 400), rng.integers(0, 60, 400), rng.random(400) < 0.6, strict=True)]
    found = secrets.least_levels(spark.createDataFrame(rows, "size int, level int, random boolean"))
    for size in range(3):
        own = sorted(((10.0 ** (-lv / secrets.STEPS), lv) for s, lv, keep in rows if s == size and keep))
        total = sum(s == size for s, _, _ in rows)
        passing = [lv for k, (p, lv) in enumerate(own) if p <= secrets.RATE * (k + 1) / total]
        assert found.get(size) == (min(passing) if passing else None)


def test_op6_battery_and_bounds(spark):
    """Random tokens pass the battery at the rate that it states; the p-values as ordinary text bound exact tails."""
    rng = np.random.default_rng(10)
    drawn = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz234567".upper()), 48)) for _ in range(400)]
    assert sum(secrets.battery(t).joint >= secrets.PASSES for t in drawn) >= 0.97 * 400
    assert not any(secrets.battery("configuration" * k).joint >= secrets.PASSES for k in (3, 30))
    n, rate = 40, 0.1
    rows = [(n, k, 1.0, 1.0) for k in range(5, n)]
    t = F.struct("n", "switches", "repeats", "serial")
    levels = spark.createDataFrame(rows, "n int, switches int, repeats double, serial double").select("switches", secrets.level(t, rate, 0.07, 0.0).alias("level")).collect()
    for r in levels:
        tail = sum(math.comb(n - 1, k) * rate**k * (1 - rate) ** (n - 1 - k) for k in range(r.switches, n))
        assert tail <= 10.0 ** (-r.level / secrets.STEPS) * 1.0001


def test_op6_repeated_null_and_clashing(spark, docs):
    rows = [(None, "deadbeefdeadbeef00"), (None, "deadbeefdeadbeef00"), (None, None), (3, "")]
    found = secrets.secrets(spark.createDataFrame(rows, "doc_id long, text string").withColumn("tokens", F.lit("mine")))
    assert Counter((r.doc_id, tuple(tuple(s) for s in r["all"])) for r in found.collect()) == Counter({(None, ((0, 18, 2),)): 2, (None, ()): 1, (3, ()): 1})
    assert secrets.secrets(docs).count() == docs.count()


@pytest.fixture(scope="module")
def word_bpe():
    return bpe.tokenizer(bpe.tokenizer_path("word_bpe_49k.json"))


def test_op7_codes(spark, rows, folder, empty, word_bpe):
    found = {r[0]: r[1:] for r in tuples(query("op7_")(spark, folder))}
    for i, text in rows:
        ids = word_bpe.encode(text or "", add_special_tokens=False).ids
        assert found[i] == (len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(word_bpe.decode(ids, skip_special_tokens=False)))
    assert bpe.bpe_codes(empty, bpe.tokenizer_path("word_bpe_49k.json")).count() == 0


def test_op7_lexicon(word_bpe):
    words = sorted({f"{a}{b}" for a in ("walk", "talk", "stalk", "é", "x") for b in ("", "s", "ing", "ed")})
    made = bpe.Lexicon(bpe.Lexicon.compile(words, [[k, k + 1] for k in range(len(words))]))
    by_bytes = sorted(words, key=lambda w: w.encode())
    assert made.ranks(by_bytes).tolist() == list(range(len(words)))
    assert made.ranks(["", "wal", "walker", "zz", "st"]).tolist() == [-1] * 5
    assert made.ids_of(3) == [words.index(by_bytes[3]), words.index(by_bytes[3]) + 1]
    assert len(made.final) < sum(len(w) for w in words) / 2  # suffixes are shared
    assert bpe.Lexicon(bpe.Lexicon.compile([], [])).ranks(["a"]).tolist() == [-1]


def test_op8_counts(spark, rows, folder, empty):
    own = bpe.tokenizer(bpe.tokenizer_path("byte_bpe_50k.json"))
    found = {r[0]: r[1:] for r in tuples(query("op8_")(spark, folder))}
    for i, text in rows:
        n = len(own.encode(text or "", add_special_tokens=False).ids)
        assert found[i] == (len(shared.utf8(text)), n, n > 1024)
    table = counts.Lengths(["a", " the", "é"], [1, 2, 3])
    assert table.find([" the", "zz", "é", "a", ""]) == [2, 0, 3, 1, 0]
    assert counts.token_counts(empty, bpe.tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_op9_media(spark, rows, folder, empty):
    found = {r[0]: r for r in tuples(query("op9_")(spark, folder))}
    for i, text in rows:
        assert found[i][1:] == brute.media_row(text), i
    assert found[7][5:] == found[8][5:]
    assert media.text_media(empty).count() == 0


def test_op9_formats(spark):
    grey = np.arange(35, dtype=np.uint8).reshape(5, 7)
    plain = lambda data: media.decode(data).samples.tolist()
    assert plain(media.encode_pgm(grey)) == plain(media.encode_bmp(grey)) == grey.tolist()
    assert plain(b"P1 # bits\n3 2\n1 0 1\n0 1 0") == [[0, 1, 0], [1, 0, 1]]
    assert plain(b"P4\n3 1\n\xa0") == [[0, 1, 0]]
    assert plain(b"P3 1 1 255 9 8 7") == [[[9, 8, 7]]]
    assert plain(b"P6 1 1 255\n\x09\x08\x07") == [[[9, 8, 7]]]
    # Depths: full brightness is 255 whatever its sample.
    assert media.decode(b"P5 2 1 65535\n\xff\xff\x9c\x40").grey().round(3).tolist() == [[255.0, round(40_000 * 255 / 65_535, 3)]]
    assert media.decode(b"P2 2 1 15 15 3").grey().tolist() == [[255.0, 51.0]]
    assert media.decode(b"P1 2 1 0 1").grey().tolist() == [[255.0, 0.0]]
    tile = np.load(io.BytesIO(media.npy_tile(media.decode(b"P2 1 1 1000 500"), 2)))
    assert tile.tolist() == [[128, 128], [128, 128]]
    coloured = bytearray(media.encode_bmp(np.array([[0, 1]], np.uint8)))
    coloured[54:62] = b"\x03\x02\x01\x00\x06\x05\x04\x00"
    assert plain(bytes(coloured)) == [[[1, 2, 3], [4, 5, 6]]]
    assert media.area_resize(grey, 5, 7) == pytest.approx(grey)
    assert media.area_resize(grey, 1, 1)[0, 0] == pytest.approx(grey.mean())
    bad = [b"no media", None, b"", b"P2 1 1 255 300", b"P5 0 0 255\n", b"P2 2 2 9 1 2 3", b"P5 9 9 255\nxx", b"P2 1 1 9 -1", b"P5 99999999999 1 255\n", b"P2 1 1 0 0", b"BM" + bytes(60), b"P5 # x", b"P2 1 1 255 x"]
    df = spark.createDataFrame([(1, media.encode_bmp(grey), "mine"), *((k + 2, x, "mine") for k, x in enumerate(bad))], "id long, media binary, dhash string")
    found = {r["row"]["id"]: (r.height, r.width, r.dhash, r["row"]["dhash"]) for r in media.media_columns(df).collect()}
    assert found == {1: (5, 7, media.difference_hash(media.Image(grey, 255)), "mine"), **{k + 2: (None, None, None, "mine") for k in range(len(bad))}}


def test_repeated_null_and_clashing_rows_of_map_side_operators(spark, docs):
    """Operators 7 to 10 read ids and texts alone: other columns can't clash, null and repeated ids are rows like others."""
    word, byte = (bpe.tokenizer_path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    odd = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, None), (3, ""), (3, "日本 語")], "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("n_tokens", "ids", "tokens", "payload", "start", "media", "base")})
    for make in (lambda d: bpe.bpe_codes(d, word), lambda d: counts.token_counts(d, byte), media.text_media, lambda d: packing.pack(d, word), secrets.secrets):
        found = Counter(tuple(map(str, (r.doc_id, r[1]))) for r in make(odd).collect())
        assert sum(found.values()) == 5 and sorted(n for (i, _), n in found.items() if i == "None") in ([2], [1, 1])
        assert make(docs).count() >= docs.count()


@pytest.mark.parametrize("name", ["op1_", "op2_", "op3_", "op4_", "op5_", "op6_", "op7_", "op8_", "op9_", "op10_", "pipeline"])
def test_queries_on_empty_tables(spark, tmp_path_factory, name):
    path = tmp_path_factory.mktemp("empty")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    assert query(name)(spark, str(path)).count() == 0


ALPHABET = "ab 日本é'\n\t1２Ⅷ😀́ПпİßﬁΣ-.,!<|>\0"


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_op7_op8_random_texts(spark, name):
    """Texts of any characters take the word path and agree with the library."""
    rng = np.random.default_rng(12)
    texts = ["".join(rng.choice(list(ALPHABET), int(rng.integers(0, 60)))) for _ in range(400)] + ["漢字" * 300, "ё" * 100, "a\0b" * 40]
    own = bpe.tokenizer(bpe.tokenizer_path(name))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in (bpe.bpe_codes if "word" in name else counts.token_counts)(rows, bpe.tokenizer_path(name)).collect()}
    for k, text in enumerate(texts):
        ids = own.encode(text, add_special_tokens=False).ids
        assert found[k].n_tokens == len(ids)
        if "word" in name:
            assert (found[k].ids, found[k].decoded) == (" ".join(map(str, ids)), own.decode(ids, skip_special_tokens=False))
    assert all((bpe.words_of if "word" in name else counts.pieces_of)(own, t) is not None for t in texts if "<|" not in t)


def test_op10_pieces(spark, rows, folder, empty, word_bpe):
    found = query("op10_")(spark, folder).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    total = 0
    for i, text in rows:
        ids = np.array([*word_bpe.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        total += len(ids)
        at = 0
        for p in sorted(pieces[i], key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    assert packing.pack(empty, bpe.tokenizer_path("word_bpe_49k.json")).count() == 0


def test_op10_cuts_are_optimal():
    rng = np.random.default_rng(3)
    for _ in range(30):
        at = np.unique(rng.integers(1, 60, 12))
        gaps = np.diff(at, prepend=0)
        limit = int(max(gaps.max(), 10))
        cost = rng.integers(0, 9, len(at))
        best = {0: 0}
        places = [0, *at.tolist()]
        for j in range(1, len(places)):
            best[j] = min(best[i] + limit - (places[j] - places[i]) + int(cost[j - 1]) for i in range(j) if places[j] - places[i] <= limit)
        got = packing.cuts(at, cost, limit)
        value = sum(limit - (b - a) for a, b in zip([0, *at[got][:-1]], at[got], strict=True)) + int(cost[got].sum())
        assert value == best[len(at)] and got[-1] == len(at) - 1


def test_hot_keys_are_attached(spark):
    df = spark.createDataFrame([("hot" if k % 3 == 0 else f"k{k}", k) for k in range(900)], "key string, v int")
    table = df.groupBy("key").agg(F.count("*").alias("n"), F.min("v").alias("least")).filter("key <> 'k1'")
    found = shared.attach(df, table, "key", "n", 900)
    assert found.count() == 900
    assert found.filter("key = 'hot'").select("least").distinct().collect()[0][0] == 0
    assert found.filter("least is null").collect()[0].key == "k1"
