"""What the operators share: reading tables, cutting lineage, connected components."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import lineage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, free: bool = False) -> DataFrame:
    """df, written to the cluster's checkpoint folder (see lineage.cut), so that lost executors
    lose no work.

    free: the driver collects its garbage now, so that Spark drops shuffle files and
    checkpoints that no frame needs any more; for jobs whose steps are as large as the input.
    """
    done = lineage.cut(df)
    if free:
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
    return done


class Scratch:
    """Tables of one job in the cluster's shared folder: compressed and by column, so far smaller
    than checkpoints, as safe from lost executors, and dropped by name when no step reads
    them any more. What a returned frame still reads stays in the folder."""

    #: While a table is written: shuffle files go with each step, and tasks hand few rows at once to Python, as a row
    #: holds a whole text or what was found in it.
    WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{lineage.shared_folder(spark)}/{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """df, written and read again; its shuffle files go as soon as it is written."""
        before = {k: self.spark.conf.get(k) for k in self.WRITING}
        try:
            for k, v in self.WRITING.items():
                self.spark.conf.set(k, v)
            df.write.option("compression", "zstd").parquet(f"{self.folder}/{name}")
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def crc_mod(col: str, n: int) -> Column:
    """crc32 of an id as text, modulo n: the split of documents into folds."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(n)


def sampled(df: DataFrame, key: str, rows: int, count: int) -> DataFrame:
    """The rows of df (count of them, or fewer) with the least hashes of key, about `rows` at most: a
    threshold on the hash cuts them before any sort, so that no partition sends `rows` of its own."""
    if count <= rows:
        return df
    h = F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 40))
    return df.where(h < int((1 << 40) * rows / count))


def join_split(rows: DataFrame, keyed: DataFrame, on: list[str], add: str, frequent: int = 2000) -> DataFrame:
    """rows with the column add of keyed, which has one row for each key and n, how many of rows have
    it; rows of other keys go. Keys that more than one of `frequent` rows have, so many at
    most, are sent to the rows; only the others are shuffled, so no key fills a task.
    rows is read twice: write it first."""
    keyed = cut(keyed.select(*on, add, "n"))
    total = keyed.agg(F.sum("n")).first()[0] or 0
    often = F.broadcast(keyed.where(F.col("n") > total / frequent).select(*on, F.col(add).alias("_often")))
    both = rows.join(often, on, "left")
    rare = both.where("_often IS NULL").drop("_often").join(keyed.where(F.col("n") <= total / frequent).drop("n"), on)
    return both.where("_often IS NOT NULL").withColumnRenamed("_often", add).unionByName(rare)


def _are_stars(e: DataFrame) -> bool:
    """Whether every u of the edges (u, v) has one v, and no v is a u."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in"))
    ends = ends.unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where((F.col("out") > 1) | (F.col("out") > 0) & (F.col("in") > 0)).isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph by alternating large and small stars.

    edges: pairs of longs. Returns (node, component): each node that has an edge to
    another, with the smallest node it reaches. No edges: no rows. Every round is
    aggregations and equi-joins over the edges; only whether all are stars reaches the driver.
    """
    hi, lo = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    e = cut(edges.select(hi, lo).where("u <> v").distinct())
    for _ in range(max_rounds):
        if _are_stars(e):
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(large.where("u <> v").distinct())
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        linked = e.join(least, "u")
        small = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = cut(small.where("u <> v").distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())
