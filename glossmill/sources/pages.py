"""Where pages and texts come from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.functions import text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole HTML files as pages; the id is a hash of the path."""
    read = spark.read.text(path, wholetext=True)
    return read.select(F.xxhash64(F.input_file_name()).alias("page_id"), F.input_file_name().alias("url"), F.col("value").alias("html"))


def wrapped(fragments: DataFrame) -> DataFrame:
    """Body fragments (page_id, html) as whole documents."""
    return fragments.withColumn("html", F.concat(F.lit("<!doctype html><html><body>"), "html", F.lit("</body></html>")))


def text_inputs(raw: DataFrame) -> DataFrame:
    """Text inputs (positional string, content binary) resolved: the positional text wins; then text and status ok, empty or invalid_utf8."""
    valid = F.coalesce(F.call_function("is_valid_utf8", F.col("content").cast("string")), F.lit(True))
    chosen = F.coalesce("positional", F.when(valid, F.col("content").cast("string")), F.lit(""))
    bad = F.col("positional").isNull() & ~valid
    body = F.when(bad, F.lit(None)).otherwise(text.trimmed(chosen))
    return raw.select("*", body.alias("text"), F.when(bad, "invalid_utf8").when(body == "", "empty").otherwise("ok").alias("status"))
