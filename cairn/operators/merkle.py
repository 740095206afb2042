"""Content addresses of directories, level by level, and what is rolled up over subtrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.rdf import NAMESPACE, SUBJECT, directory_xml
from cairn.functions.urn import sha1_urn
from cairn.operators.changes import above
from cairn.operators.lineage import cut


def directory_ids(entries: DataFrame, namespace: str = NAMESPACE) -> DataFrame:
    """(path, id, xml) of every directory of entries (path, is_dir, urn, and if they are there size
    and modified), the root as an empty path: the address of its document, which holds the
    addresses of what is in it.

    One aggregation for each level of the tree, the deepest first, each written. A directory
    is one row of that: its document has to be hashed as a whole.
    """
    for name, kind in (("size", "long"), ("modified", "timestamp")):
        if name not in entries.columns:
            entries = entries.withColumn(name, F.lit(None).cast(kind))
    parts = F.split("path", "/")
    flat = cut(entries.select("path", F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("up"), F.element_at(parts, -1).alias("name"), F.size(parts).alias("depth"), "is_dir", F.col("urn").alias("target"), "size", "modified"))
    depth = flat.agg(F.max("depth")).first()[0] or 0
    found = below = None
    for level in range(depth, -1, -1):
        rows = flat.where(F.col("depth") == level + 1).select("up", "path", "name", "is_dir", "target", "size", "modified")
        if below is not None:
            ids = below.select(F.col("path").alias("_path"), F.col("id").alias("_id"))
            rows = rows.join(ids, rows["path"] == ids["_path"], "left").withColumn("target", F.coalesce("_id", "target"))
        made = rows.groupBy(F.col("up").alias("path")).agg(F.collect_list(F.struct("name", "is_dir", "target", "size", "modified")).alias("e"))
        here = flat.where((F.col("depth") == level) & F.col("is_dir")).select("path") if level else flat.sparkSession.createDataFrame([("",)], "path string")
        full = here.join(made, "path", "left").withColumn("e", F.coalesce("e", F.array().cast("array<struct<name:string,is_dir:boolean,target:string,size:bigint,modified:timestamp>>")))
        xml = full.select("path", directory_xml(F.col("e"), namespace).alias("xml"))
        below = cut(xml.select("path", F.concat(F.lit(SUBJECT), sha1_urn(F.col("xml"))).alias("id"), "xml"))
        found = below if found is None else found.unionByName(below)
    return found


def rollup(files: DataFrame) -> DataFrame:
    """(path, newest, fully_stored, blobs) of every directory above files (path, modified, stored), the
    root as an empty path: the latest time, whether all is stored, and how many files."""
    ups = F.concat(F.array(F.lit("")), F.slice(above(F.col("path")), 1, F.size(F.split("path", "/")) - 1))
    each = files.select(F.explode(ups).alias("path"), "modified", "stored")
    return each.groupBy("path").agg(F.max("modified").alias("newest"), F.bool_and("stored").alias("fully_stored"), F.count("*").alias("blobs"))
