"""Counters and regression gates: aggregates with partial sums, exact where the reference figures are exact."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossmill.sources.stored import dropped_later, written

# The largest spread that is judged, and the ratios to the baseline that fail.
MAX_CV, MAX_P50, MAX_P95 = 0.15, 1.3, 1.5


def counters(segments: DataFrame, *by: str) -> DataFrame:
    """Wide counters of segments, per key or over all."""
    return segments.groupBy(*by).agg(
        F.count("*").alias("segment_count"), F.sum("char_count").alias("source_chars"), F.count_if(F.col("kind") == "button").alias("button_segments"), F.sum(F.size("protected_spans")).alias("protected_spans"),
        *(F.count_if(F.col(c) == v).alias(f"{c}_{v}") for c, values in (("state", ("pending", "skipped")), ("region", ("main", "chrome"))) for v in values),
    )


def counter_rows(segments: DataFrame) -> DataFrame:
    """Counters in long form (key, value); a state or region has a row only if it occurs."""
    return counter_totals(counters(segments))


def counter_totals(counted: DataFrame) -> DataFrame:
    """Wide counters, added up over all rows, in long form."""
    names = counted.columns
    wide = counted.agg(*(F.sum(n).alias(n) for n in names))
    long = wide.select(F.explode(F.array(*(F.struct(F.lit(n).alias("key"), F.col(n).cast("long").alias("value")) for n in names))).alias("c")).select("c.*")
    return long.filter("value > 0 or not (key like 'state%' or key like 'region%')")


def counter_diff(now: DataFrame, base: DataFrame) -> DataFrame:
    """Keys whose values differ or that only one side has."""
    joined = now.select("key", F.col("value").alias("now")).join(base.select("key", F.col("value").alias("base")), "key", "full_outer")
    return joined.filter(~F.col("now").eqNullSafe(F.col("base")))


def counter_check(now: DataFrame, base: DataFrame, varying: DataFrame) -> DataFrame:
    """What fails a run: counters that differ from the baseline's, and inputs with more than one counter set (varying: see variants())."""
    unsteady = varying.agg(F.count_if(F.col("variants") != 1).alias("now")).filter("now > 0")
    return counter_diff(now, base).unionByName(unsteady.select(F.lit("unsteady inputs").alias("key"), "now", F.lit(0).cast("long").alias("base")))


def variants(runs: DataFrame, by: str) -> DataFrame:
    """Distinct counter sets per input; more than one means that collection isn't repeatable."""
    sets = [c for c in runs.columns if c not in (by, "run")]
    return runs.groupBy(by).agg(F.count_distinct(F.to_json(F.struct(*sets))).alias("variants"))


def nearest_ranks(samples: DataFrame, by: str, value: str, quantiles: dict[str, float]) -> DataFrame:
    """(by, one column per quantile): of each key the value of rank ceil(q n), exact for any number of samples.

    A distributed selection: equal samples are counted together, the distinct ones dealt in ranges of key and value; the ranges' counts,
    added up within a key, tell in which range a rank lies, and only rows of such ranges are gone through. No task holds a key's values.
    Nulls are no samples; a key without any has no row.
    """
    counted = samples.filter(F.col(value).isNotNull()).groupBy(F.col(by).alias("by"), F.col(value).alias("v")).agg(F.count("*").alias("n"))
    ordered = dropped_later(written(counted.repartitionByRange("by", "v").withColumn("part", F.spark_partition_id()), "ordered"))
    totals = ordered.groupBy("by", "part").agg(F.sum("n").alias("own"))
    parts = Window.partitionBy("by").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    totals = totals.withColumn("upto", F.sum("own").over(parts)).withColumn("all", F.sum("own").over(Window.partitionBy("by")))
    asked = F.array(*(F.struct(F.lit(c).alias("name"), F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("all"))).cast("long").alias("rank")) for c, q in quantiles.items()))
    within = F.filter(asked, lambda r: (r["rank"] <= F.col("upto")) & (r["rank"] > F.col("upto") - F.col("own")))
    wanted = totals.withColumn("ranks", within).filter(F.size("ranks") > 0).select(F.col("by").alias("its"), F.col("part").alias("in"), F.transform("ranks", lambda r: F.struct(r["name"].alias("name"), (r["rank"] - F.col("upto") + F.col("own")).alias("rank"))).alias("ranks"))
    rows = ordered.join(wanted, F.col("by").eqNullSafe(F.col("its")) & (F.col("part") == F.col("in")))
    before = F.sum("n").over(Window.partitionBy("by", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    met = F.filter("ranks", lambda r: (r["rank"] <= F.col("upto")) & (r["rank"] > F.col("upto") - F.col("n")))
    picked = rows.withColumn("upto", before).select("by", "v", F.explode(met).alias("r"))
    return picked.groupBy(F.col("by").alias(by)).agg(*(F.max(F.when(F.col("r.name") == c, F.col("v"))).alias(c) for c in quantiles))


def timing_summary(samples: DataFrame, by: str, value: str) -> DataFrame:
    """Per key: the least value, exact nearest ranks, the mean, and the spread over the mean."""
    mean, spread = F.avg(value), F.stddev_pop(value)
    plain = samples.groupBy(by).agg(F.min(value).alias("least"), mean.alias("mean"), F.when(mean == 0, 0.0).otherwise(spread / mean).alias("cv"))
    ranks = nearest_ranks(samples, by, value, {"p50": 0.5, "p95": 0.95}).withColumnRenamed(by, "_key")
    return plain.join(ranks, F.col(by).eqNullSafe(F.col("_key")), "left").select(by, "least", "p50", "p95", "mean", "cv")


def timing_gate(now: DataFrame, base: DataFrame, by: str) -> DataFrame:
    """now and base (by, p50, p95, cv, env): a verdict per key, not judged where the environment differs or the spread is wide."""
    b = base.select(by, F.col("p50").alias("base_p50"), F.col("p95").alias("base_p95"), F.col("env").alias("base_env"))
    judged = F.col("env").eqNullSafe(F.col("base_env")) & (F.col("cv") <= MAX_CV)
    slow = (F.col("p50") > MAX_P50 * F.col("base_p50")) | (F.col("p95") > MAX_P95 * F.col("base_p95"))
    return now.join(b, by).select(by, F.when(~judged, "not judged").when(slow, "fail").otherwise("pass").alias("verdict"))
