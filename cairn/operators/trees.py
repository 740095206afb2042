"""Directory trees as flat tables (path, urn): walking, comparing, changing, merging."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_directories(files: DataFrame, *keep: str) -> DataFrame:
    """(path, name, depth, is_dir): files' paths and all directories above them."""
    parts = F.split("path", "/")
    ups = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("path"), F.element_at(parts, n).alias("name"), n.alias("depth"), (n < F.size(parts)).alias("is_dir")))).alias("e"))
    return ups.select("e.*").distinct()


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, op): D where the old file is gone or differs, A where the new one is there or differs."""
    both = old.select("path", F.col("urn").alias("o")).join(new.select("path", F.col("urn").alias("n")), "path", "full_outer")
    changed = both.where(~F.col("o").eqNullSafe(F.col("n")))
    ops = F.array_compact(F.array(F.when(F.col("o").isNotNull(), F.lit("D")), F.when(F.col("n").isNotNull(), F.lit("A"))))
    return changed.select("path", F.explode(ops).alias("op"))


def apply_changes(old: DataFrame, changes: DataFrame, new: DataFrame) -> DataFrame:
    """old (path, urn) without its deletions and with its additions, whose contents new has.
    Deleting what is missing does nothing."""
    gone = changes.where("op = 'D'").select("path")
    added = changes.where("op = 'A'").select("path").join(new, "path")
    return old.join(gone, "path", "left_anti").select("path", "urn").unionByName(added.select("path", "urn"))


def merge(old: DataFrame, new: DataFrame, policy: str = "Same?Ignore:Fail") -> DataFrame:
    """(path, urn, conflict) of new merged into old. policy: Fail, Replace, Ignore, or Same?X:Y,
    X where contents are equal, Y elsewhere. Conflicts under Fail keep the old file and
    are marked."""
    both = old.select("path", F.col("urn").alias("o")).join(new.select("path", F.col("urn").alias("n")), "path", "full_outer")
    same, other = policy.removeprefix("Same?").split(":") if policy.startswith("Same?") else (policy, policy)
    method = F.when(F.col("o").isNull() | F.col("n").isNull(), F.lit("Add")).when(F.col("o") == F.col("n"), F.lit(same)).otherwise(F.lit(other))
    urn = F.when(method == "Replace", F.col("n")).otherwise(F.coalesce("o", "n"))
    return both.select("path", urn.alias("urn"), (method == "Fail").alias("conflict"))


def _quoted(text: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)


def glob_regex(rule: str, base: str = "") -> str:
    """An ignore rule (without a leading !) as a pattern for whole paths, built segment by segment.

    A rule that begins with a slash holds from base on, others at any depth. A segment ** is any
    number of directories, or all below where it is the last; in other segments * is any text
    without a slash, and ** any text.
    """
    anchored, last = rule.startswith("/"), rule.count("/")
    out = [f"{_quoted(base)}/" if base else ""] if anchored else ["(?:.*/)?"]
    for i, segment in enumerate(rule.split("/")):
        if i == 0 and anchored:
            continue
        if segment == "**":
            out.append("(?:[^/]+/)*" if i < last else ".*")
        else:
            stars = [_quoted(p) if k % 2 == 0 else "[^/]*" if p == "*" else ".*" for k, p in enumerate(re.split(r"(\*+)", segment))]
            out.append("".join(stars) + ("/" if i < last else ""))
    return f"^{''.join(out)}$"


def ignored(path: Column, rules: list[str]) -> Column:
    """Whether the last rule that matches says to leave the path out; without one, whether its
    name begins with a dot. Rules: blank lines and # comments are skipped, ! means keep."""
    out = F.when(path.rlike(r"(?:^|/)\.[^/]*$"), True).otherwise(False)
    for rule in rules:
        if rule.strip() and not rule.startswith("#"):
            out = F.when(path.rlike(glob_regex(rule.removeprefix("!"))), not rule.startswith("!")).otherwise(out)
    return out


def merge_directories(old: DataFrame, new: DataFrame, method: str) -> DataFrame:
    """(path, urn) of new's files and directories merged into old's root. method: Replace or
    Ignore, for directories of the root that both have: the new or the old one is taken whole.
    Files are taken alike."""
    first, other = {"Replace": (new, old), "Ignore": (old, new)}[method]
    top = F.substring_index("path", "/", 1)
    taken = first.select(top.alias("top")).distinct()
    rest = other.withColumn("top", top).join(taken, "top", "left_anti")
    return first.select("path", "urn").unionByName(rest.select("path", "urn"))


def changeset_lines(changes: DataFrame) -> DataFrame:
    """(top, dump): the changes of each directory of the root as lines `op path`, by path, deletions first."""
    line = F.struct("path", F.when(F.col("op") == "D", 0).otherwise(1).alias("seq"), F.concat_ws(" ", "op", "path").alias("line"))
    lines = changes.groupBy(F.substring_index("path", "/", 1).alias("top")).agg(F.array_sort(F.collect_list(line)).alias("l"))
    return lines.select("top", F.array_join(F.col("l.line"), "\n").alias("dump"))


def longest_prefix(asked: DataFrame, heads: DataFrame) -> DataFrame:
    """asked's rows with head and rest: of the paths in heads (head) the longest that asked.path is
    or lies under, and what follows it; rows under none are left out. One join on each prefix."""
    parts = F.split("path", "/")
    prefixes = asked.withColumn("head", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))))
    found = prefixes.join(heads.select("head").distinct(), "head").groupBy(*asked.columns).agg(F.max_by("head", F.length("head")).alias("head"))
    return found.withColumn("rest", F.substring(F.col("path"), F.length("head") + F.lit(2), F.length("path")))


def preorder_key(path: Column, is_dir: Column, key) -> Column:
    """Sorts entries as a walk visits them: a directory before what it holds, directories before
    files, each by key of its name."""
    parts = F.split(path, "/")
    return F.transform(parts, lambda p, i: F.concat(F.when((i < F.size(parts) - 1) | is_dir, "0").otherwise("1"), key(p)))


def pick(entries: DataFrame, seed: str, by: str) -> DataFrame:
    """(by, path): of each group one path, chosen alike by the same seed."""
    return entries.groupBy(by).agg(F.min_by("path", F.struct(F.sha1(F.concat(F.lit(seed + ":"), "path").cast("binary")), "path")).alias("path"))
