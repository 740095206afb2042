"""Paths through directories and commits, one join for each step of the longest path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.lineage import cut

FOUND, MISSING, NOT_APPLICABLE, NO_ARGUMENT = "found", "missing", "not applicable", "no argument"


def steps(path: Column) -> Column:
    """A path's names: runs of slashes part them, those at its end count for nothing."""
    return F.when(path.rlike("^/+$"), F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(path, "/+$", ""), "/+"))


def follow(requests: DataFrame, entries: DataFrame, commits: DataFrame) -> DataFrame:
    """(id, outcome, at, name): where each request (id, source, path) ends.

    entries: (directory, name, target), a null name for an empty directory; commits:
    (commit, target), which only the name `target` leads on from. Found: at is what the
    path leads to. Missing: at is the directory that has no entry of that name. Not
    applicable: at is a blob, or a commit asked for another name. Null source or path: no
    argument. Of entries that share directory and name, the smallest target counts.
    """
    links = entries.where("name IS NOT NULL").select(F.col("directory").alias("node"), F.col("name").alias("step"), "target")
    links = links.unionByName(commits.select(F.col("commit").alias("node"), F.lit("target").alias("step"), "target"))
    links = cut(links.groupBy("node", "step").agg(F.min("target").alias("target"), F.lit(True).alias("leads")))
    directories = cut(entries.select(F.col("directory").alias("node")).distinct().withColumn("is_dir", F.lit(True)))
    state = requests.select("id", F.col("source").alias("at"), steps(F.col("path")).alias("rest"))
    state = cut(state.withColumn("outcome", F.when(F.col("at").isNull() | F.col("rest").isNull(), NO_ARGUMENT).otherwise(FOUND)).withColumn("name", F.lit(None).cast("string")))
    columns = ["id", "outcome", "at", "name"]
    ended = state.where((F.col("outcome") != FOUND) | (F.size("rest") == 0)).select(columns)
    going = state.where((F.col("outcome") == FOUND) & (F.size("rest") > 0))
    while not going.isEmpty():
        going = going.withColumn("name", F.element_at("rest", 1))
        met = going.join(links, (F.col("at") == F.col("node")) & (F.col("name") == F.col("step")), "left").drop("node").join(directories, F.col("at") == F.col("node"), "left")
        outcome = F.when(F.col("leads"), FOUND).when(F.col("is_dir"), MISSING).otherwise(NOT_APPLICABLE)
        met = cut(met.select("id", outcome.alias("outcome"), F.when(F.col("leads"), F.col("target")).otherwise(F.col("at")).alias("at"), F.when(F.col("leads"), None).otherwise(F.col("name")).alias("name"), F.slice("rest", 2, F.size("rest")).alias("rest")))
        ended = ended.unionByName(met.where((F.col("outcome") != FOUND) | (F.size("rest") == 0)).select(columns))
        going = met.where((F.col("outcome") == FOUND) & (F.size("rest") > 0))
    return ended
