"""Names with a namespace, long and short."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_name(name: Column) -> tuple[Column, Column]:
    """(namespace, rest): cut behind the last #, or if there is none the last slash; null if one of both would be empty."""
    space = F.when(name.contains("#"), F.regexp_extract(name, r"(?s)^(.+#)[^#]+$", 1)).otherwise(F.regexp_extract(name, r"(?s)^(.+/)[^/]+$", 1))
    space = F.nullif(space, F.lit(""))
    return space, F.when(space.isNotNull(), F.substr(name, F.length(space) + 1))


def shorten(names: DataFrame, known: dict[str, str]) -> DataFrame:
    """names (doc, pos, name, other columns) with prefix, namespace and short.

    The longest of the known namespaces (by prefix; the empty prefix gives the rest alone)
    that a name goes on from is its own; others get the prefixes a0, a1 and so on, in the
    order in which a document's names first need them. Null where a name has none: no
    slash or #, or nothing before or behind it. Known prefixes are not to be of that form.
    """
    name = F.col("name")
    mine = [F.when(name.startswith(space) & (F.length(name) > len(space)), F.struct(F.lit(prefix).alias("prefix"), F.lit(space).alias("namespace"))) for prefix, space in sorted(known.items(), key=lambda x: (-len(x[1]), x[0]))]
    given = F.coalesce(*mine) if mine else F.lit(None).cast("struct<prefix:string,namespace:string>")
    rows = names.withColumn("_given", given).withColumn("_own", F.when(given.isNull(), split_name(name)[0]))
    firsts = rows.where("_own IS NOT NULL").groupBy("doc", F.col("_own").alias("_space")).agg(F.min("pos").alias("_first"))
    made = firsts.withColumn("_made", F.concat(F.lit("a"), F.row_number().over(Window.partitionBy("doc").orderBy("_first", "_space")) - 1)).select(F.col("doc").alias("_doc"), "_space", "_made")
    rows = rows.join(made, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("_own") == F.col("_space")), "left")
    rows = rows.withColumn("prefix", F.coalesce("_given.prefix", "_made")).withColumn("namespace", F.coalesce("_given.namespace", "_own"))
    rest = F.substr(name, F.length("namespace") + 1)
    return rows.withColumn("short", F.when(F.col("prefix") == "", rest).otherwise(F.concat("prefix", F.lit(":"), rest))).drop("_given", "_own", "_doc", "_space", "_made")


def expand(names: DataFrame, spaces: DataFrame) -> DataFrame:
    """names (doc, short, other columns) with name, by spaces (doc, prefix, namespace). Null for a prefix
    that the document has not, or nothing before or behind the colon."""
    parted = names.withColumn("_prefix", F.when(~F.col("short").contains(":"), "").when(F.col("short").rlike("(?s)^[^:]+:.+$"), F.substring_index("short", ":", 1)))
    of = spaces.select(F.col("doc").alias("_doc"), F.col("prefix").alias("_of"), F.col("namespace").alias("_space")).distinct()
    both = parted.join(of, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("_prefix") == F.col("_of")), "left")
    rest = F.when(F.col("_prefix") == "", F.col("short")).otherwise(F.substr(F.col("short"), F.length("_prefix") + 2))
    return both.withColumn("name", F.concat("_space", rest)).drop("_prefix", "_doc", "_of", "_space")
