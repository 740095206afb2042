"""Changes of trees that hold directories too: tables of entries (path, is_dir, urn).

A directory's urn is null. All work is joins and aggregations on paths; trees of any depth
take one pass, since an entry knows the paths above it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What sorts after everything below a directory.
LAST = "\U0010ffff"


def above(path: Column) -> Column:
    """The paths of the directories above path, the root left out."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def _above(entries: DataFrame) -> DataFrame:
    """(path): every directory above the entries, once."""
    return entries.where(F.contains("path", F.lit("/"))).select(F.explode(F.slice(above(F.col("path")), 1, F.size(F.split("path", "/")) - 1)).alias("path")).distinct()


def entries(files: DataFrame, directories: DataFrame | None = None) -> DataFrame:
    """(path, is_dir, urn) of files (path, urn), the directories above them, and those in directories
    (path), which may be empty."""
    dirs = _above(files.select("path"))
    if directories is not None:
        dirs = dirs.unionByName(directories.select("path")).unionByName(_above(directories.select("path"))).distinct()
    return files.select("path", F.lit(False).alias("is_dir"), "urn").unionByName(dirs.select("path", F.lit(True).alias("is_dir"), F.lit(None).cast("string").alias("urn")))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, seq, op): DD for a directory that is gone or a file now, D for a file that is gone,
    a directory now or another one, A for a file that is new or another one. New empty
    directories are no change. In order of place(): what is in a directory goes before it."""
    both = old.select("path", F.col("is_dir").alias("od"), F.col("urn").alias("o")).join(new.select("path", F.col("is_dir").alias("nd"), F.col("urn").alias("n")), "path", "full_outer")
    same = ~F.coalesce("od", F.lit(True)) & ~F.coalesce("nd", F.lit(True)) & F.col("o").eqNullSafe(F.col("n"))
    dd, gone = F.coalesce("od", F.lit(False)) & ~F.coalesce("nd", F.lit(False)), ~F.coalesce("od", F.lit(True)) & ~same
    ops = F.array_compact(F.array(F.when(dd, "DD"), F.when(gone, "D"), F.when(~F.coalesce("nd", F.lit(True)) & ~same, "A")))
    return both.select("path", F.posexplode(ops).alias("seq", "op"), F.when(dd, F.concat("path", F.lit("/" + LAST))).otherwise(F.col("path")).alias("place"))


def dump(found: DataFrame) -> DataFrame:
    """(top, dump): the changes of each entry of the root as lines, in order."""
    line = F.struct("place", "seq", F.concat(F.rpad("op", 3, " "), "path").alias("line"))
    lines = found.groupBy(F.substring_index("path", "/", 1).alias("top")).agg(F.array_sort(F.collect_list(line)).alias("l"))
    return lines.select("top", F.array_join(F.col("l.line"), "\n").alias("dump"))


def apply_changes(base: DataFrame, found: DataFrame, new: DataFrame) -> DataFrame:
    """(path, is_dir, urn, conflict): base with the changes, the contents of added files from new.

    Deleting what is missing does nothing. A directory is deleted only if nothing is left in
    it. Directories above added files are made. conflict says why a change was not made:
    `exists` (a file is added where an entry is left), `not a directory` (below a file that
    is left) and `not a file` (D of a directory); its entry stays as it was.
    """
    ops = found.groupBy("path").agg(*[F.max(F.col("op") == op).alias(name) for op, name in (("D", "d"), ("DD", "dd"), ("A", "a"))])
    both = base.join(ops, "path", "left").select("path", "is_dir", "urn", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("d", "dd", "a")])
    sure = both.where(F.when(F.col("is_dir"), ~F.col("dd")).otherwise(~F.col("d")))
    held = _above(sure.select("path")).withColumn("held", F.lit(True))
    left = both.where("is_dir AND dd").join(held, "path", "left_semi").unionByName(sure)
    wrong = F.when(F.col("a"), "exists").when(F.col("d") & F.col("is_dir"), "not a file")
    kept = left.select("path", "is_dir", "urn", wrong.alias("conflict"))
    added = found.where("op = 'A'").select("path").distinct().join(kept.select("path"), "path", "left_anti")
    ups = added.select(F.col("path").alias("added"), F.explode(above(F.col("path"))).alias("path"))
    blocked = ups.join(kept.where("NOT is_dir").select("path"), "path", "left_semi").select(F.col("added").alias("path")).distinct().withColumn("conflict", F.lit("not a directory"))
    made = added.join(blocked, "path", "left").join(new.where("NOT is_dir").select("path", "urn"), "path").select("path", F.lit(False).alias("is_dir"), "urn", "conflict")
    dirs = _above(made.where("conflict IS NULL").select("path")).join(kept.select("path"), "path", "left_anti")
    return kept.unionByName(made).unionByName(dirs.select("path", F.lit(True).alias("is_dir"), F.lit(None).cast("string").alias("urn"), F.lit(None).cast("string").alias("conflict")))


def merge(old: DataFrame, new: DataFrame, files: str = "Fail", directories: str = "Merge", fail: bool = False) -> DataFrame:
    """(path, is_dir, urn, conflict): new merged into old.

    files: Fail, Replace, Ignore, or Same?X:Y, for files that both have. directories, for
    those in the root that both have: Merge (what is in them is merged alike), Replace or
    Ignore (the new or the old one is taken whole), Fail. An entry that is a file on one
    side and a directory on the other is always a conflict, and what is below it too.
    Conflicts keep the old entry and say which kind they are; with fail they raise.
    """
    same, other = files.removeprefix("Same?").split(":") if files.startswith("Same?") else (files, files)
    top = lambda df: df.withColumn("top", F.substring_index("path", "/", 1))
    whole = top(old).where("is_dir AND path = top").select("top").join(top(new).where("is_dir AND path = top").select("top"), "top").withColumn("whole", F.lit(True))
    o, n = top(old), top(new)
    both = o.select("path", "top", F.col("is_dir").alias("od"), F.col("urn").alias("o")).join(n.select("path", "top", F.col("is_dir").alias("nd"), F.col("urn").alias("n")), ["path", "top"], "full_outer").join(whole, "top", "left")
    mixed = F.col("od") != F.col("nd")
    under = both.where(mixed).select(F.col("path").alias("up")).withColumn("mixed", F.lit(True))
    ups = both.select("path", F.explode(above(F.col("path"))).alias("up")).join(under, "up").select("path").distinct().withColumn("mixed", F.lit(True))
    both = both.join(ups, "path", "left")
    in_both = F.coalesce("whole", F.lit(False))
    method = (
        F.when(F.col("mixed"), "Mixed").when(in_both & F.lit(directories != "Merge"), F.lit(directories)).when(F.col("od").isNull() | F.col("nd").isNull(), "Add").when(F.col("od"), "Ignore")
        .when(F.col("o").eqNullSafe(F.col("n")), F.lit(same)).otherwise(F.lit(other))
    )
    rows = both.withColumn("method", method)
    # Where a side is taken whole, the other side's own entries go.
    rows = rows.where(~((F.col("method") == "Replace") & in_both & F.lit(directories == "Replace") & F.col("nd").isNull()) & ~((F.col("method").isin("Ignore", "Fail", "Mixed")) & F.col("od").isNull()))
    conflict = F.when(F.col("method") == "Mixed", "mixed").when(F.col("method") == "Fail", F.when(F.lit(directories == "Fail") & in_both, "directory").otherwise("file"))
    if fail:
        conflict = F.when(conflict.isNotNull(), F.raise_error(F.concat(F.lit("cannot merge "), "path", F.lit(": "), conflict)).cast("string"))
    take_new = (F.col("method") == "Replace") | F.col("od").isNull()
    return rows.select("path", F.when(take_new, F.col("nd")).otherwise(F.col("od")).alias("is_dir"), F.when(take_new, F.col("n")).otherwise(F.col("o")).alias("urn"), conflict.alias("conflict"))


def merge_all(trees: list[DataFrame], files: str = "Fail") -> DataFrame:
    """(path, is_dir, urn, conflict) of any number of trees, each merged into those before it."""
    out = trees[0].withColumn("conflict", F.lit(None).cast("string"))
    for tree in trees[1:]:
        before = out.where("conflict IS NOT NULL").select("path", F.col("conflict").alias("was"))
        out = merge(out.drop("conflict"), tree, files).join(before, "path", "left").select("path", "is_dir", "urn", F.coalesce("conflict", "was").alias("conflict"))
    return out
