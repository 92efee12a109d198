"""A corpus pipeline: quality rules, near-duplicate removal, substring deduplication, personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents, and further ones of
any name. All work on whole tables and texts; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.llm.bpe import tokenizer_path
from glossmill.llm.jaccard import one_of_each
from glossmill.llm.packing import pack
from glossmill.llm.pii import redact
from glossmill.llm.quality import judge
from glossmill.llm.shared import documents, dropped_later, written
from glossmill.llm.substrings import cut_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null, empty and short texts fail a base rule; equal rows share a verdict, null ids are no bar."""
    judged = judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.filter("kept").select("row.*")


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar ones: that with the smallest id.

    Null and empty texts are similar to nothing and stay. Where ids repeat or are null, rows of the smallest id stay, equal rows once.
    """
    return one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that occur earlier; documents of which nothing is left go. Earlier: by id, nulls last, then by words where
    ids repeat; texts without a word stay as they are."""
    return cut_repeats(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; null texts stay null. Each row is judged alone, so repeated ids are no matter."""
    return redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences: each row is a document, a null or empty text one of its end id alone."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join),
    ("substring_dedup", substring_dedup),
    ("personal_data", personal_data),
    ("packing", packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = dropped_later(written(docs, name))
    return docs
