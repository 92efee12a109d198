"""The registered queries: each applies one operator to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.functions import lang, text
from glossmill.operators import attempts as at
from glossmill.operators import dispatch, extract, metrics, render, translate
from glossmill.sources.pages import pages, table, text_inputs
from glossmill.sources.stored import dropped_later, page_buckets, passing_folder, spread, write_bucketed, written
from glossmill.streaming import streams
from glossmill.streaming.known import KnownSegments, kept_up

# Fixed small dimension tables, given in the queries and their oracles alike.
TAGS = ["zh-Hant", "zh_TW", "zh-HK", "zh-Hans", "zh-CN", "zh-SG", "zh", "zh-XX", "zh-Latn-TW", "zh-x-tw", "ja", "en-US", "yue-HK", "", "fr"]
TARGETS = ["zh-Hant", "zh-Hans", "fr", "en"]
PAIRS = [("en", "zh-Hant", "installed"), ("fr", "zh-Hant", "supported"), ("de", "zh-Hant", "unsupported")]
SCREEN = 768


def segments_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.segments(pages(spark, sf_dir))


def stored_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments, written once, in page buckets, for queries that read them more than once or join them by page."""
    return page_buckets(segments_of(spark, sf_dir), "segments")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments_of(spark, sf_dir).select("page_id", "seg_id", "order", "region", "source", "state", "skip_reason", "insert_mode", "char_count")


def page_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.counters(segments_of(spark, sf_dir), "page_id")


def corpus_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.counter_rows(segments_of(spark, sf_dir))


def skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments_of(spark, sf_dir).filter("state = 'skipped'").groupBy("page_lang", "skip_reason").agg(F.count("*").alias("n"))


def counter_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = stored_segments(spark, sf_dir)
    return metrics.counter_diff(metrics.counter_rows(every.filter("page_lang = 'en'")), metrics.counter_rows(every.filter("page_lang = 'fr'")))


def two_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of two runs over the pages; the second meets longer texts on every other page."""
    longer = pages(spark, sf_dir).withColumn("html", F.when(F.col("page_id") % 2 == 0, F.regexp_replace("html", " the ", " those ")).otherwise(F.col("html")))
    runs = [metrics.counters(extract.segments(p), "page_id").withColumn("run", F.lit(k)) for k, p in enumerate((pages(spark, sf_dir), longer))]
    return runs[0].unionByName(runs[1])


def counter_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.variants(two_runs(spark, sf_dir), "page_id")


def counter_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of the pages with longer texts against the pages', and whether runs over a page vary."""
    every = dropped_later(written(two_runs(spark, sf_dir), "runs"))
    rows = lambda k: metrics.counter_totals(every.filter(F.col("run") == k).drop("run", "page_id"))
    return metrics.counter_check(rows(1), rows(0), metrics.variants(every, "page_id"))


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", text.normalized(F.col("text")).alias("normalized"), text.utf16_length(F.col("text")).alias("units"))


def worth_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spread(table(spark, sf_dir, "documents")).select("doc_id", F.explode(F.split("text", "\n| \\| ", -1)).alias("line"))
    reason = text.skip_reason(text.gate_text(F.col("line")), F.lit(True))
    return lines.select("doc_id", F.coalesce(reason, F.lit("worth")).alias("reason")).groupBy("doc_id", "reason").agg(F.count("*").alias("n"))


def gate_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", text.skip_reason(text.gate_text(F.col("url")), F.lit(False)).alias("reason"))


def page_lang_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's tag, and the tags of a fixed list, against every target."""
    own = extract.node_tables(pages(spark, sf_dir)).select("page_id", F.array_append(F.array(*map(F.lit, TAGS)), F.col("page_lang")).alias("tags"))
    rows = own.select("page_id", F.explode("tags").alias("tag")).select("page_id", "tag", F.explode(F.array(*map(F.lit, TARGETS))).alias("target"))
    gate = lang.page_is_target(F.col("tag"), F.lit(""), F.col("target"))
    return rows.groupBy("tag", "target", lang.zh_variant(F.col("tag")).alias("variant"), gate.alias("gate"), lang.already_target(F.col("tag"), F.col("target")).alias("own")).agg(F.count("*").alias("n"))


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with a plain geometry: 60 pixels each, below each other, seen from two screens down."""
    top = F.col("order") * 60 - 2 * SCREEN
    rows = segments_of(spark, sf_dir).select("page_id", "order", "seg_id", "region", "state", "anchor_path", top.alias("top"), (top + 40).alias("bottom"), F.lit(SCREEN).alias("height"))
    return rows.withColumn("distance", dispatch.distance(F.col("top"), F.col("bottom"), F.col("height")))


def dispatch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dispatch.priority(dispatch.open_segments(placed(spark, sf_dir))).select("page_id", "order", "region", "distance", "place")


def eager_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dispatch.eager(segments_of(spark, sf_dir)).filter("eager").select("page_id", "order", "source")


def lazy_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dispatch.lazy_tiers(segments_of(spark, sf_dir)).groupBy("page_id", "tier").agg(F.count("*").alias("blocks"), F.sum("n_segments").alias("n_segments"))


def admitted_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dispatch.admitted(placed(spark, sf_dir).withColumn("tier", F.col("region"))).groupBy("page_id", "tier").agg(F.count("*").alias("n"))


def resorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eager segments are sent; the rest is ranked anew from the top of the page."""
    rows = dropped_later(written(dispatch.open_segments(placed(spark, sf_dir)), "open"))
    sent = dispatch.eager(rows).filter("eager")
    fresh = rows.select("page_id", "seg_id", (F.col("order") * 60).alias("distance"))
    return dispatch.ranked_again(rows, sent, fresh).select("page_id", "order", "distance", "place")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as messages; ids, sources and targets come in right and wrong JSON types."""
    c = table(spark, sf_dir, "conversations")
    id_ = F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    full = F.to_json(F.struct(id_.alias("id"), F.col("text").alias("source"), F.col("role").alias("from"), F.lit("translate").alias("type")))
    number = F.to_json(F.struct(F.col("conv_id").alias("id"), F.col("text").alias("source")))
    lists = F.to_json(F.struct(id_.alias("id"), F.array("text").alias("source"), F.col("turn").alias("to")))
    return c.select("conv_id", "turn", F.when(F.col("turn") == 0, full).when(F.col("turn") == 1, number).when(F.col("turn") == 2, lists).otherwise(F.to_json(F.struct(id_.alias("id"), F.col("text").alias("source")))).alias("message"))


def parse_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return translate.parsed_requests(requests(spark, sf_dir)).drop("message")


def echoed():
    """A stand-in translation."""
    return F.concat(F.lit("~"), "source")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = translate.parsed_requests(requests(spark, sf_dir))
    return rows.select("conv_id", "turn", translate.response(F.col("id"), echoed(), F.col("error")).alias("response"), translate.cli_json(F.col("source"), F.col("to"), echoed()).alias("cli"))


def pair_precheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = spark.createDataFrame(PAIRS, "`from` string, `to` string, status string")
    checked = translate.pair_errors(translate.requests_of(segments_of(spark, sf_dir)), pairs)
    return checked.groupBy("from", "to", "pair_error").agg(F.count("*").alias("n"))


def engine_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs as an engine knows them, and what that means for their requests."""

    def status(a: str, b: str) -> str:
        return {"en": "installed", "fr": "supported", "es": "unsupported"}[a]  # no answer for others

    wanted = dropped_later(written(translate.requests_of(segments_of(spark, sf_dir)), "requests"))
    known = translate.engine_status(wanted, status)
    return translate.pair_errors(wanted, known.select("*", F.col("status").alias("known"))).groupBy("from", "to", "known", "pair_error").agg(F.count("*").alias("n"))


def memory(work: DataFrame) -> DataFrame:
    """A translation memory that knows texts of at most 80 characters; those that end in a full stop have an empty translation."""
    return work.filter(F.length("source") <= 80).select("from", "to", "source", F.when(F.col("source").endswith("."), "").otherwise(echoed()).alias("text"))


def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = stored_segments(spark, sf_dir)
    wanted = translate.requests_of(every)
    found = translate.by_memory(wanted, memory(translate.distinct_work(wanted)))
    responses = found.select("page_id", "seg_id", "text", F.when(F.length("source") > 400, "too long").alias("error"))
    return translate.applied(every, page_buckets(responses, "responses"))


def distinct_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return translate.distinct_work(translate.requests_of(segments_of(spark, sf_dir)))


def apply_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answered(spark, sf_dir).groupBy("page_id", "state", "reason").agg(F.count("*").alias("n"))


def bilingual_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return translate.bilingual_pairs(answered(spark, sf_dir))


def unmatched_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses that match no segment: every third one echoes an id that was never sent."""
    every = stored_segments(spark, sf_dir)
    odd = F.col("order") % 3 == 2
    sent = every.select("page_id", F.when(odd, F.concat("seg_id", F.lit("?"))).otherwise(F.col("seg_id")).alias("seg_id"), "source")
    return translate.unmatched(sent, every).select("page_id", "seg_id", "source")


def bridge_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = translate.requests_of(segments_of(spark, sf_dir))
    return wanted.select("page_id", translate.request_message(F.col("seg_id"), F.col("source"), F.col("from"), F.col("to")).alias("message"))


def engine_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    def engine(a: str, b: str):
        def run(source: str) -> str:
            if a == "de":
                raise ValueError("no model")
            return f"{b}:{source[::-1]}"

        return run

    return translate.by_engine(translate.distinct_work(translate.requests_of(segments_of(spark, sf_dir))), engine)


def engine_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an engine did with the distinct texts, by language pair, and what the job on logs makes of its attempts.

    The engine has no model for one language; it runs out of time on texts of 100 characters and more, and is told to stop at digits.
    """

    def engine(a: str, b: str):
        def run(texts: list[str]) -> list:
            if a == "de":
                raise ValueError("no model")
            stopped = lambda t: translate.Cancelled("stopped") if t[:1].isdigit() else None
            return [stopped(t) or (TimeoutError("too slow") if len(t) >= 100 else f"{b}:{t}") for t in texts]

        return run

    answers, log = translate.translated(translate.distinct_work(translate.requests_of(segments_of(spark, sf_dir))), engine)
    by_pair = answers.groupBy(F.concat_ws(" to ", "from", "to").alias("pair")).agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("success", "timeout", "cancelled", "error")), F.sum(F.length("text")).alias("units"))
    return by_pair.join(at.circuit(log).select("pair", "attempts"), "pair")


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, segments and responses are stored in the same buckets, so a page's rows meet without a shuffle."""
    return render.render(page_buckets(pages(spark, sf_dir), "pages"), answered(spark, sf_dir))


def page_contents(rendered_pages: DataFrame) -> DataFrame:
    """The marks of every rendered page with their texts, in document order, and what is left of the page without them."""
    mark = '<div class="gm-translation" data-gm-id="([^"]*)">([^<]*)</div>'
    marks = F.concat_ws("\n", F.zip_with(F.regexp_extract_all("html", F.lit(mark), F.lit(1)), F.regexp_extract_all("html", F.lit(mark), F.lit(2)), lambda i, t: F.concat(i, F.lit(" "), t)))
    bare = F.regexp_replace(F.regexp_replace("html", mark, ""), "(?s)^.*<article>|</article>.*$|</?[a-z0-9]+>", "")
    for escaped, plain in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(escaped), F.lit(plain))
    return rendered_pages.select("page_id", marks.alias("marks"), F.length(bare).alias("left"))


def render_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_contents(rendered(spark, sf_dir))


def page_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered pages written in page buckets, and the contents of the table read back."""
    return page_contents(write_bucketed(rendered(spark, sf_dir), passing_folder(spark, "bilingual"), buckets=16))


def segment_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments written in page buckets; the table read back, with the golden form's JSON of each."""
    stored = write_bucketed(segments_of(spark, sf_dir), passing_folder(spark, "segment-table"), buckets=16)
    return stored.select("page_id", "order", F.to_json(F.struct("order", "source", "state", F.col("skip_reason").alias("skipReason"))).alias("golden"))


def recollect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.segments(rendered(spark, sf_dir)).select("page_id", "order", "source", "state")


def with_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages with one word of the texts as code."""
    return pages(spark, sf_dir).withColumn("html", F.regexp_replace("html", " (the|der|la) ", " <code>$1</code>  "))


def protected_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.segments(with_spans(spark, sf_dir)).filter("size(protected_spans) > 0")
    listed = F.concat_ws(",", F.transform("protected_spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))))
    return found.select("page_id", "order", F.size("protected_spans").alias("n"), listed.alias("spans"))


def with_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages with controls and foreign-language blocks before the article, which differ from page to page."""
    path = F.concat(F.lit("Read "), F.substring(F.col("url"), F.lit(9), (F.col("page_id") % 20 + 5).cast("int")))
    lang_tag = F.element_at(F.array(*(F.lit(t) for t in FOREIGN)), (F.col("page_id") % len(FOREIGN) + 1).cast("int"))
    block = F.concat(F.lit('<section lang="'), lang_tag, F.lit('"><p>简体字 '), F.col("page_id").cast("string"), F.lit("</p><p>简体<b>字</b></p></section>"))
    controls = F.concat(F.lit("<button>"), path, F.lit("</button><label>go "), path, F.lit('</label><div role="button">x <i>y</i></div>'), block)
    return pages(spark, sf_dir).withColumn("html", F.concat(F.lit("<html><body>"), controls, F.lit("</body></html>")))


FOREIGN = ["zh-CN", "zh_TW", "ja", "", "zh-Hans-HK"]


def insert_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buttons, effective languages and insert modes of pages with controls and foreign blocks."""
    return extract.segments(with_controls(spark, sf_dir)).select("page_id", "order", "source", "kind", "insert_mode", "eff_lang", "state", "skip_reason", "region", "replace_snapshot", "anchor_tag")


def replaced_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with controls, every segment translated: short buttons and Simplified blocks in place, the others after their block.

    Buttons of every second page have a title of their own; in every third page the blocks' texts have drifted.
    """
    html = F.when(F.col("page_id") % 2 == 0, F.replace("html", F.lit("<button>"), F.lit('<button title="own">'))).otherwise(F.col("html"))
    controls = with_controls(spark, sf_dir).withColumn("html", html)
    drafts = extract.segments(controls).withColumns({"state": F.lit("drafted"), "draft": F.concat(F.lit("T&"), "source")})
    drifted = F.when(F.col("page_id") % 3 == 0, F.concat("replace_snapshot", F.lit("!"))).otherwise(F.col("replace_snapshot"))
    return render.render(controls, drafts.withColumn("replace_snapshot", drifted))


def made_pages(spark: SparkSession, sf_dir: str, *parts) -> DataFrame:
    """A page for each of the table's, from parts that may depend on its number and address."""
    return pages(spark, sf_dir).withColumn("html", F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)))


def turn_of(values: list[str]):
    """One of the values, by the page's number."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col("page_id") % len(values) + 1).cast("int"))


#: What an opaque element says of itself; the first OPAQUE_HIDDEN ways hide it, its language never does.
OPAQUE_WAYS = ["hidden", 'translate="no"', 'style="display:none"', 'style="content-visibility: hidden"', 'lang="zh-TW"', 'class="plain"', 'translate="yes"']
OPAQUE_HIDDEN = 4


def opaque_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and time elements: which are skipped, what of their content is kept as it is, and where that lies in the source."""
    tag, number = F.when(F.col("page_id") % 2 == 0, "code").otherwise("time"), F.col("page_id").cast("string")
    inner = F.concat(F.lit("w"), number, F.lit('<i hidden>no</i><b translate="no">no</b><i lang="zh-TW">\u7e41</i><br>end'))
    found = extract.segments(made_pages(spark, sf_dir, '<html lang="en"><body><p>Open <', tag, " ", turn_of(OPAQUE_WAYS), ">", inner, "</", tag, "> shut.</p></body></html>"))
    listed = F.concat_ws(",", F.transform("protected_spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"), x["kind"])))
    return found.select("page_id", "order", "source", listed.alias("spans"))


#: Elements that pass their children on, a button that doesn't though it is told to, and elements that are inline anyway.
FLAT = [
    'sun <span style="display:contents">and <em style="display: contents">moon N <p>P N</p> set</em> or</span> rise',
    'sun <span role="button" style="display:contents">push N</span> rise',
    "sun <span>and <em>moon N</em> or</span> rise",
    '<section style="display:contents">loose N <p>P N</p></section> rise',
]
FLAT_SOURCES = [["sun and moon N", "P N", "set or rise"], ["sun", "push N", "rise"], ["sun and moon N or rise"], ["loose N", "P N", "rise"]]


def flattened_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks and runs of pages with elements of display: contents."""
    body = F.replace(turn_of(FLAT), F.lit("N"), F.col("page_id").cast("string"))
    return extract.segments(made_pages(spark, sf_dir, '<html lang="en"><body><div>', body, "</div></body></html>")).select("page_id", "order", "source")


#: Names of a block, and which sign each is.
HINTS = ['class="sidebar"', 'class="x" id="main-column"', 'class="comment article"', 'class="plain"', 'id="promo-2"']
SIGNS = ["chrome", "main", "main", "", "chrome"]


def hint_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of blocks by the names around them and the length of their text."""
    words = F.expr("repeat(concat('Read ', page_id, ' '), cast(page_id % 40 + 1 as int))")
    found = extract.segments(made_pages(spark, sf_dir, '<html lang="en"><body><div ', turn_of(HINTS), "><div><p>", words, "</p></div></div></body></html>"))
    return found.select("page_id", "order", "region", "char_count")


#: The html element's attributes, and what follows a Han text; kana count where they are among the first 500 units, hidden or not.
PAGE_TAGS = ["", ' lang=""', ' lang=" "', ' lang="zh-Hant"', ' lang="en"']
TAILS = ["", "<p>\u304b\u306a</p>", "<p hidden>" + "x" * 600 + "</p><p>\u304b\u306a</p>", "<p hidden>\u304b\u306a</p>"]


def sample_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a page counts as Chinese by its tag, or without one by a sample of its text."""
    tail = F.element_at(F.array(*map(F.lit, TAILS)), (F.floor(F.col("page_id") / len(PAGE_TAGS)) % len(TAILS) + 1).cast("int"))
    found = extract.segments(made_pages(spark, sf_dir, "<html", turn_of(PAGE_TAGS), "><body><p>\u7b80\u4f53 ", F.col("page_id").cast("string"), "</p>", tail, "</body></html>"))
    return found.select("page_id", "order", "source", "state", "skip_reason", "page_is_target")


def edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages with one word spelled anew, as a later version of them."""
    return pages(spark, sf_dir).withColumn("html", F.regexp_replace("html", " the ", " THE "))


def incremental_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.fresh(extract.segments(edited(spark, sf_dir)), segments_of(spark, sf_dir)).select("page_id", "order", "source")


def stream_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over a stream of the edited pages, against a written table of what is known."""
    known, done = stored_segments(spark, sf_dir), passing_folder(spark, "changes")
    stream = streams.table_stream(spark, f"{sf_dir}/pages.parquet*", streams.PAGES)
    new = stream.withColumn("html", F.regexp_replace("html", " the ", " THE "))
    query = streams.changed_pages(new, lambda: known, lambda df, n: df.select("page_id", "order", "source").write.mode("overwrite").parquet(f"{done}/{n}"), f"{done}-checkpoint")
    query.awaitTermination()
    return spark.read.schema("page_id long, order int, source string").parquet(f"{done}/*")


def stream_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three versions of every page, one after another, as one stream that keeps up the table of what is known: what each brings anew."""
    folder = passing_folder(spark, "versions")
    known = KnownSegments(spark, f"{folder}/known", buckets=16)
    for version, word in enumerate(("the", "THE", "Thee"), 1):
        spelled = F.replace("html", F.lit(" the "), F.lit(f" {word} "))
        pages(spark, sf_dir).select("page_id", "url", spelled.alias("html")).write.mode("append").parquet(f"{folder}/pages")
        done = f"{folder}/new/version={version}"
        query = kept_up(streams.table_stream(spark, f"{folder}/pages", streams.PAGES), known, lambda df, n, done=done: df.select("page_id", "order", "source").write.mode("overwrite").parquet(f"{done}/{n}"), f"{folder}/checkpoint")
        query.awaitTermination()
    return spark.read.schema("page_id long, order int, source string, version int").option("basePath", f"{folder}/new").parquet(f"{folder}/new/*/*")


def drift_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of text alone whose text has changed, or that hold other elements by now, in the edited pages."""
    old = segments_of(spark, sf_dir).filter("only_text")
    found = render.drift(old, extract.segments(edited(spark, sf_dir)))
    return found.groupBy("page_id", "drifted").agg(F.count("*").alias("n"))


def as_attempts(events: DataFrame) -> DataFrame:
    """Events as attempts. A status query that was answered has a result, by the event's number."""
    outcome = F.when(F.col("event_type") == "error", "timeout").when(F.col("event_type") == "signup", "cancelled").when(F.col("event_type") == "click", "error").otherwise("success")
    entry = F.when(F.col("event_id") % 2 == 0, "translate").otherwise("availability")
    result = F.when((F.col("event_id") % 2 == 1) & (outcome == "success"), F.element_at(F.array(F.lit("installed"), F.lit("supported"), F.lit("unsupported")), (F.col("event_id") % 3 + 1).cast("int")))
    return events.select(F.col("user_id").alias("pair"), entry.alias("entry"), F.col("event_id").alias("id"), "ts", outcome.alias("outcome"), result.alias("result"))


def attempts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_attempts(table(spark, sf_dir, "events"))


def timeout_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return at.timeout_streaks(attempts_of(spark, sf_dir)).select("pair", "entry", "id", "streak")


def installed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return at.installed(attempts_of(spark, sf_dir)).select("pair", "id", "cached")


def circuit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a day's opening, so that the table's sparse attempts meet it."""
    return at.circuit(attempts_of(spark, sf_dir), threshold=2, seconds=86_400).select("pair", "entry", "attempts", "rejected", "opened", "streak")


def pair_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = attempts_of(spark, sf_dir)
    return at.resolved_status(log, at.circuit(log, threshold=2, seconds=86_400), F.lit("2024-01-20").cast("timestamp"))


def timing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = metrics.timing_summary(table(spark, sf_dir, "events"), "event_type", "value")
    return made.select("event_type", "least", "p50", "p95", F.round("mean", 6).alias("mean"), F.round("cv", 6).alias("cv"))


def timing_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities of returned line items as samples, by line number, against those of the others; the baseline of some numbers is faster,
    of some more even spread, and one comes from elsewhere."""
    n = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(n.cast("string").alias("key"), (F.col("l_returnflag") == "R").alias("now"), (100 + F.col("l_quantity") * F.when(n > 5, 8).otherwise(1)).cast("double").alias("value"), F.when(n % 3 == 1, 0.7).otherwise(1.0).alias("pace"))
    now = metrics.timing_summary(rows.filter("now"), "key", "value").withColumn("env", F.lit("x86"))
    base = metrics.timing_summary(rows.filter("not now").withColumn("value", F.col("value") * F.col("pace")), "key", "value")
    return metrics.timing_gate(now, base.withColumn("env", F.when(F.col("key") == "2", "arm").otherwise("x86")), "key")


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of documents as sources and of pages as targets."""
    pairs = table(spark, sf_dir, "documents").select(F.col("lang").alias("from"), F.explode(F.array(*map(F.lit, TARGETS))).alias("to"))
    return translate.languages(pairs.filter("`from` <> `to`"))


def text_input_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as inputs: some with a positional text, which wins, and some whose bytes end inside a character."""
    broken = F.when(F.col("doc_id") % 7 == 0, F.concat(F.col("text").cast("binary"), F.unhex(F.lit("C3")))).otherwise(F.col("text").cast("binary"))
    typed = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit(" "), "source", F.lit("\n")))
    raw = spread(table(spark, sf_dir, "documents")).select("doc_id", typed.alias("positional"), broken.alias("content"))
    return text_inputs(raw).select("doc_id", "status", F.length("text").alias("size"))


def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages with their advertisement hidden in a way that differs from page to page."""
    way = F.element_at(F.array(*(F.lit(w) for w in HIDDEN)), (F.col("page_id") % len(HIDDEN) + 1).cast("int"))
    return pages(spark, sf_dir).withColumn("html", F.replace("html", F.lit('<div class="ad">'), F.concat(F.lit("<div "), way, F.lit(">"))))


#: Ways to hide an element, and what decides each.
HIDDEN = ["hidden", 'aria-hidden="true"', 'translate="no"', 'style="display:none"', 'class="sr-only"', 'lang="zh-TW"', 'role="Math "', 'class="x notranslate"', 'style="content-visibility: hidden"']
RULES = ["attribute", "attribute", "translate-no", "display", "attribute", "already-target", "attribute", "translate-no", "display"]


def node_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.node_audit(audited(spark, sf_dir)).filter("tag <> '#text'")


def stream_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = streams.segment_stream(streams.table_stream(spark, f"{sf_dir}/pages.parquet*", streams.PAGES))
    return streams.once(stream.select("page_id", "order", "source", "state"), passing_folder(spark, "stream"))


def stream_circuit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream that ends: what the watermark still holds back comes out in a second run."""
    stream, folder = as_attempts(streams.table_stream(spark, f"{sf_dir}/events.parquet*", table(spark, sf_dir, "events").schema)).drop("result"), passing_folder(spark, "stream")
    ended = streams.with_end(stream, f"{folder}/end")
    circuits = streams.circuit_stream(ended, threshold=2, seconds=86_400, late="2 days")
    streams.once(circuits, folder)
    streams.end_stream(stream, f"{folder}/end")
    return streams.once(circuits, folder)


QUERIES = {
    f.__name__: f
    for f in (
        segments, segment_table, page_counters, corpus_counters, skip_reasons, counter_diff, counter_variants, counter_check, protected_spans, insert_modes, normalize_text, worth_gate, gate_urls, page_lang_gate, dispatch_plan, eager_segments, lazy_tiers,
        admitted_blocks, resorted, parse_requests, responses, pair_precheck, engine_status, distinct_work, apply_responses, bilingual_pairs, bridge_messages, unmatched_responses, engine_translate, render_pages, page_table, recollect, incremental_segments, stream_changes,
        drift_guard, timeout_streaks, installed_pairs, circuit_windows, pair_status, timing_summary, timing_gate, languages, text_input_status, node_audit, stream_segments, stream_circuit, replaced_pages, opaque_rules, flattened_blocks, hint_regions, sample_gate, stream_versions, engine_attempts,
    )
}
