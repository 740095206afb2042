"""Folders of files as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.urn import sha1_urn
from cairn.operators.trees import ignored


def scan(spark: SparkSession, folder: str, rules: list[str] | None = None) -> DataFrame:
    """(path, size, modified, urn) of the files under folder that rules, and names that begin with
    a dot, do not leave out. Spark itself skips files whose names begin with _ or a dot."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    inside = F.regexp_replace(F.expr("substring_index(path, ':', -1)"), "^/+", "/")
    base = "/" + folder.split(":", 1)[-1].strip("/") + "/"
    path = F.substring(inside, len(base) + 1, 1 << 30)
    return files.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), sha1_urn(F.col("content")).alias("urn")).where(~ignored(F.col("path"), rules or []))
