"""Caches: results of functions, and blobs that were fetched from elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.urn import sha1_part, sha1_urn

#: What a stored result begins with, text and reference.
TEXT, REFERENCE = '"', "<"


def stored_result(value: Column, uri: Column) -> Column:
    """A result as it is stored: a reference if uri is not null, else text."""
    return F.coalesce(F.concat(F.lit(REFERENCE), uri), F.concat(F.lit(TEXT), value))


def results(puts: DataFrame, order: str) -> DataFrame:
    """(key, value, uri) of the last put (key, stored, and the order column) of each key; one of value
    and uri is null."""
    last = puts.where("key IS NOT NULL").groupBy("key").agg(F.max_by("stored", order).alias("stored"))
    body, reference = F.substring("stored", 2, 2**31 - 1), F.col("stored").startswith(REFERENCE)
    return last.select("key", F.when(~reference, body).alias("value"), F.when(reference, body).alias("uri"))


def cached(fetched: DataFrame, stored: DataFrame) -> DataFrame:
    """fetched (urn, content, other columns) with outcome: what happens to each blob before it is handed on.

    cached: its SHA-1 is the one that urn names, and it goes to the store. present: so it
    is, and stored (sha1_urn) has it. mismatch: it is another. unverifiable: urn names no
    SHA-1. A cached blob's address is the column stored_urn, null for the others.
    """
    own = fetched.withColumn("_urn", sha1_urn(F.col("content")))
    known = stored.select(F.col("sha1_urn").alias("_known")).distinct()
    both = own.join(known, F.col("_urn") == F.col("_known"), "left")
    same = F.concat(F.lit("urn:sha1:"), sha1_part(F.col("urn"))) == F.col("_urn")
    outcome = F.when(same.isNull(), "unverifiable").when(~same, "mismatch").when(F.col("_known").isNotNull(), "present").otherwise("cached")
    return both.withColumn("outcome", outcome).withColumn("stored_urn", F.when(F.col("outcome") == "cached", F.col("_urn"))).drop("_urn", "_known")
