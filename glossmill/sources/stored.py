"""Tables written between steps, in the folder that driver and executors share, and bucketed sinks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only a session on one machine may do without: it gets a fresh one."""
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir")
    if not named and not (conf.get("spark.master") or "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or "file://" + tempfile.mkdtemp(prefix="spark-shared-")


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def passing_folder(spark: SparkSession, name: str) -> str:
    """A folder for a sink that only this session's results read: it goes, with all in it, when the driver's process ends."""
    above, files = _folder(spark, fresh_folder(spark, name))
    files.mkdirs(above)
    files.deleteOnExit(above)
    return f"{above.toString()}/sink"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: df as a Parquet table in the shared folder, read back. A lost executor costs no earlier stage."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


def _folder(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of tables made by written() once nothing reads them any more."""
    for table in tables:
        path, files = _folder(table.sparkSession, table._written_at)
        files.delete(path, True)


def dropped_later(table: DataFrame) -> DataFrame:
    """Marks a table made by written() that a result still reads: its files go when the driver's process ends."""
    path, files = _folder(table.sparkSession, table._written_at)
    files.deleteOnExit(path)
    return table


#: Slots into which keys are hashed to deal rows by their bytes; a sum for each comes to the driver.
SLOTS = 4_096


def spread(df: DataFrame, key: str | None = None, content: str | None = None) -> DataFrame:
    """df dealt over all cores where it comes in fewer splits than there are cores; larger tables stay as they are, as do those that come
    out of a shuffle (an adaptive plan), whose splits are only known as it runs, and bucketed ones. With a key and a content column rows
    are dealt by bytes: see by_bytes()."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming:
        return df
    run = df._jdf.queryExecution()
    if run.executedPlan().nodeName() == "AdaptiveSparkPlan" or run.toRdd().getNumPartitions() >= cores or "Bucketed: " in run.executedPlan().toString():
        return df
    return df.repartition(cores) if key is None else by_bytes(df, key, content, cores)


def by_bytes(df: DataFrame, key: str, content: str, tasks: int) -> DataFrame:
    """df dealt over tasks so that each has about as many bytes of the content column: sizes are added up in slots of hashed keys, and the
    slots' prefix sums cut at equal targets. A row larger than a task's share leaves its task little else."""
    slot = F.pmod(F.xxhash64(key), F.lit(SLOTS)).cast("int")
    sizes = [0] * SLOTS
    for number, size in df.groupBy(slot.alias("slot")).agg(F.sum(F.octet_length(content) + 16)).collect():
        sizes[number] = size or 16
    share, done, homes = sum(sizes) / tasks, 0, []
    for size in sizes:
        homes.append(min(tasks - 1, int((done + size / 2) / share)) if share else 0)
        done += size
    home = F.get(F.split(F.lit(",".join(map(str, homes))), ",").cast("array<int>"), slot)
    return df.repartitionById(tasks, home)


def page_buckets(df: DataFrame, name: str, key: str = "page_id", buckets: int | None = None) -> DataFrame:
    """df as a table bucketed and sorted by the key: joins, windows and aggregates by the key, or by it and more, plan no exchange of it.

    The number of buckets, by default that of shuffle partitions, must be the same for tables that are joined. A shuffle for the write
    takes the place of one for each later use. Joins by key and more rely on the key alone, which the session must allow.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = fresh_folder(spark, name)
    table = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    df.repartition(buckets, key).write.format("parquet").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    found = spark.table(table)
    found._written_at = path
    return dropped_later(found)


def write_bucketed(rows: DataFrame, path: str, key: str = "page_id", buckets: int = 64) -> DataFrame:
    """Writes rows as Parquet in folders by a bucket of the key, so that a page's rows are found in one of them; returns the table.

    The rebalance hint lets adaptive execution split large buckets over tasks and files and join small ones.
    """
    bucketed = rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    bucketed.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)
    return rows.sparkSession.read.schema(bucketed.schema).parquet(path)
