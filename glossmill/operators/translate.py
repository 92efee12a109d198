"""Requests, language-pair checks, translation by memory or engine, and what responses do to segments: equi-joins."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.sources.stored import dropped_later, written

# Fixed values of the wire format.
FROM, TO = "en", "zh-Hant"
NO_ID, NO_SOURCE, NO_TEXT = "missing id", "missing source", "no-text"


def string_field(json: Column, name: str) -> Column:
    """A field of a JSON object if it is a string; any other type counts as missing."""
    value = F.try_variant_get(F.try_parse_json(json), f"$.{name}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def parsed_requests(requests: DataFrame) -> DataFrame:
    """Requests (message: JSON text) with id, source, from, to, and error where the id or else the source is missing."""
    fields = requests.withColumns({"id": string_field(F.col("message"), "id"), "source": string_field(F.col("message"), "source"), "from": F.coalesce(string_field(F.col("message"), "from"), F.lit(FROM)), "to": F.coalesce(string_field(F.col("message"), "to"), F.lit(TO))})
    return fields.withColumn("error", F.when(F.col("id").isNull(), NO_ID).when(F.col("source").isNull(), NO_SOURCE))


def response(id_: Column, text: Column, error: Column) -> Column:
    """The JSON of one of three shapes: translated (id, text), failed (error, id), unidentified (error)."""
    return F.when(error.isNull(), F.to_json(F.struct(id_.alias("id"), text.alias("text")))).otherwise(F.to_json(F.struct(error.alias("error"), id_.alias("id"))))


def request_message(id_: Column, source: Column, from_: Column, to: Column) -> Column:
    return F.to_json(F.struct(F.lit("translate").alias("type"), id_.alias("id"), source.alias("source"), from_.alias("from"), to.alias("to")))


def cli_json(source: Column, target: Column, text: Column) -> Column:
    """Keys in alphabetical order."""
    return F.to_json(F.struct(source.alias("source"), target.alias("target"), text.alias("text")))


def requests_of(segments: DataFrame, to: str = TO) -> DataFrame:
    """Pending segments as requests; the source language is the page's."""
    rows = segments.filter("state = 'pending'")
    return rows.select("page_id", "seg_id", "source", F.coalesce(F.nullif("page_lang", F.lit("")), F.lit(FROM)).alias("from"), F.lit(to).alias("to"))


def pair_errors(requests: DataFrame, pairs: DataFrame) -> DataFrame:
    """requests with pair_error: a pair that is only supported isn't downloaded, an unsupported one can't be; others don't block.

    pairs (from, to, status) is the table of language pairs, whose number doesn't grow with the requests.
    """
    status = F.coalesce("status", F.lit("undetermined"))
    pair = F.concat("from", F.lit(" to "), "to")
    error = F.when(status == "supported", F.concat(F.lit("not downloaded: "), pair)).when(status == "unsupported", F.concat(F.lit("unsupported pair: "), pair))
    return requests.join(pairs, ["from", "to"], "left").withColumn("pair_error", error).drop("status")


def distinct_work(requests: DataFrame) -> DataFrame:
    """Each text of each pair once, and how often it is wanted; partial counts absorb texts that every page repeats."""
    return requests.groupBy("from", "to", "source").agg(F.count("*").alias("wanted"))


#: A text with at least 1/HOT_SHARE of all requests is looked up map-side if it has at most HOT_LENGTH characters: a broadcast of 2 MB at most.
HOT_SHARE, HOT_LENGTH = 512, 1_024
TEXT_KEY = ["from", "to", "source"]


def common_texts(requests: DataFrame) -> DataFrame:
    """The texts (from, to, source) that many requests have, such as those of navigation and footers: HOT_SHARE of them at most."""
    least = max(2, requests.count() // HOT_SHARE)
    short = requests.filter(F.length("source") <= HOT_LENGTH)
    return short.groupBy(*TEXT_KEY).agg(F.count("*").alias("wanted")).filter(F.col("wanted") >= least).select(*TEXT_KEY)


def by_memory(requests: DataFrame, memory: DataFrame) -> DataFrame:
    """requests with text from a translation memory (from, to, source, text), which has each text once; null where it has none.

    Texts that many requests share are looked up without a shuffle, so none of them makes a hot task; the others meet the memory by a
    64-bit hash, with the texts themselves compared after it. requests are read three times: store them if they are costly to make.
    """
    common = dropped_later(written(common_texts(requests), "common-texts"))
    hot = memory.join(F.broadcast(common), TEXT_KEY, "left_semi")
    marked = requests.join(F.broadcast(common.withColumn("_hot", F.lit(True))), TEXT_KEY, "left")
    near = marked.filter("_hot").drop("_hot").join(F.broadcast(hot.select(*TEXT_KEY, "text")), TEXT_KEY, "left")
    key = F.xxhash64(*TEXT_KEY).alias("_key")
    far = marked.filter("_hot is null").drop("_hot").select("*", key).join(memory.select(*TEXT_KEY, "text", key), ["_key", *TEXT_KEY], "left").drop("_key")
    return near.unionByName(far)


class Cancelled(Exception):
    """What an engine raises, or gives for a text, when it was told to stop."""


def outcome_of(result: object) -> str:
    if isinstance(result, TimeoutError):
        return "timeout"
    if isinstance(result, Cancelled):
        return "cancelled"
    return "error" if isinstance(result, BaseException) else "success"


def translated(work: DataFrame, make_engine: Callable[[str, str], Callable[[list[str]], list]], batch: int = 32, salts: int = 64, clock: Callable[[], float] = time.time) -> tuple[DataFrame, DataFrame]:
    """(answers, attempts) of distinct work (from, to, source) by a pluggable engine, which takes texts in batches.

    An engine gives a text or an exception for each text; what it raises counts for all texts of the call. answers: from, to, source,
    text, error and outcome; attempts: pair, entry, id, ts and outcome, one per text, as the jobs on logs read them. Few pairs have nearly
    all work, so it is dealt by pair and a salt of the text, and a task makes one engine for each pair it meets. The engine runs once:
    both results are read from one written table.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engines: dict[tuple[str, str], Callable[[list[str]], list]] = {}
        number = TaskContext.get().partitionId() << 33

        def call(a: str, b: str, texts: list[str]) -> list:
            try:
                if (a, b) not in engines:
                    engines[a, b] = make_engine(a, b)
                results = list(engines[a, b](texts))
                if len(results) != len(texts):
                    raise ValueError(f"{len(results)} results for {len(texts)} texts")
                return results
            except Exception as e:  # an engine's failure is a result
                return [e] * len(texts)

        for part in parts:
            rows = []
            for (a, b), own in part.groupby(["from", "to"], sort=False, dropna=False):
                texts = own["source"].tolist()
                for at in range(0, len(texts), batch):
                    for source, result in zip(texts[at : at + batch], call(a, b, texts[at : at + batch]), strict=True):
                        failed = isinstance(result, BaseException)
                        rows.append((a, b, source, None if failed else result, (str(result) or type(result).__name__) if failed else None, outcome_of(result), number, int(clock() * 1_000_000)))
                        number += 1
            yield pd.DataFrame(rows, columns=["from", "to", "source", "text", "error", "outcome", "id", "at"])

    dealt = work.select(*TEXT_KEY).repartition("from", "to", F.pmod(F.xxhash64("source"), F.lit(salts))).sortWithinPartitions("from", "to")
    done = dealt.mapInPandas(run, "`from` string, `to` string, source string, text string, error string, outcome string, id long, at long")
    table = dropped_later(written(done, "engine-calls"))
    attempts = table.select(F.concat_ws(" to ", "from", "to").alias("pair"), F.lit("translate").alias("entry"), "id", F.timestamp_micros("at").alias("ts"), "outcome")
    return table.drop("id", "at"), attempts


def by_engine(work: DataFrame, make_engine: Callable[[str, str], Callable[[str], str]]) -> DataFrame:
    """(from, to, source, text, error) of distinct work by a pluggable engine; one engine per pair and task, failures become errors."""

    def run(parts):
        engines: dict[tuple[str, str], Callable[[str], str]] = {}
        for part in parts:
            rows = []
            for a, b, source in zip(part["from"], part["to"], part["source"], strict=True):
                try:
                    engine = engines.setdefault((a, b), None) or make_engine(a, b)
                    engines[a, b] = engine
                    rows.append((a, b, source, engine(source), None))
                except Exception as e:  # an engine's failure is a result
                    rows.append((a, b, source, None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["from", "to", "source", "text", "error"])

    return work.select("from", "to", "source").mapInPandas(run, "`from` string, `to` string, source string, text string, error string")


def engine_status(requests: DataFrame, status: Callable[[str, str], str]) -> DataFrame:
    """(from, to, status) of the language pairs of requests, asked of an engine once a pair; a failure leaves a pair undetermined."""

    def run(parts):
        for part in parts:
            rows = []
            for a, b in zip(part["from"], part["to"], strict=True):
                try:
                    rows.append((a, b, status(a, b)))
                except Exception:  # an engine's failure is a result
                    rows.append((a, b, "undetermined"))
            yield pd.DataFrame(rows, columns=["from", "to", "status"])

    return requests.select("from", "to").distinct().mapInPandas(run, "`from` string, `to` string, status string")


def applied(segments: DataFrame, responses: DataFrame) -> DataFrame:
    """segments with new state, reason and draft, from responses (page_id, seg_id, text, error); only pending ones change."""
    hit = F.col("state").eqNullSafe("pending") & F.col("answered")
    joined = segments.join(responses.select("page_id", "seg_id", "text", "error", F.lit(True).alias("answered")), ["page_id", "seg_id"], "left").withColumn("answered", F.coalesce("answered", F.lit(False)))
    state = F.when(~hit, F.col("state")).when(F.col("error").isNotNull() | F.col("text").isNull(), "failed").otherwise("drafted")
    reason = F.when(hit & F.col("error").isNotNull(), F.col("error")).when(hit & F.col("text").isNull(), NO_TEXT)
    return joined.withColumns({"state": state, "reason": reason, "draft": F.when(hit & F.col("error").isNull(), F.col("text"))}).drop("answered", "text", "error")


def unmatched(responses: DataFrame, segments: DataFrame) -> DataFrame:
    return responses.join(segments, ["page_id", "seg_id"], "left_anti")


def bilingual_pairs(segments: DataFrame) -> DataFrame:
    """The parallel corpus: source and text of every segment that would be shown."""
    return shown(segments).select("page_id", "order", "source", "text", "insert_mode")


def shown(segments: DataFrame) -> DataFrame:
    """Drafted segments with an anchor and a text that isn't empty; a refined text comes first."""
    text = F.coalesce("refined", "draft") if "refined" in segments.columns else F.col("draft")
    return segments.withColumn("text", text).filter("state = 'drafted' and anchor_path is not null and text <> ''")


def languages(pairs: DataFrame) -> DataFrame:
    """Codes that are a source or a target of pairs (from, to), each once, in order. A table without any is an error, raised when read."""
    both = pairs.select(F.explode(F.array("from", "to")).alias("language")).filter("language is not null").distinct()
    listed = both.agg(F.sort_array(F.collect_list("language")).alias("all"))  # a list of language codes, one row
    some = F.when(F.size("all") > 0, F.col("all")).otherwise(F.raise_error(F.lit("no supported languages")).cast("array<string>"))
    return listed.select(F.explode(some).alias("language"))
