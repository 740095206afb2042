"""SimHash near-duplicates over a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most 3 bits differ in at most 3 of their 8
bytes, so they share at least 5 positional bytes. The index posts each distinct
fingerprint under positional bytes, four at a time: a family of position sets such that
any 5 positions contain one. Fingerprints that meet in a list are tallied (how many of
the 8 positional bytes they share), kept from 5 on, and verified by their bits. Each
link is emitted in the first list it meets in only, so no later distinct is needed.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import components, cut, join_split


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Unsigned SimHash of UTF-8 text: words are runs of bytes other than ASCII white
    space, A-Z lower-cased; shingles with repeats; fewer words: the whole sequence; no
    word: zero."""
    words = text.lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    h = np.array([xxhash.xxh64_intdigest(g, 42) for g in grams], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): fp as a signed long. Null text counts as empty. One row per row of docs."""

    def run(batches):
        for batch in batches:
            fps = [fingerprint(x or b"", shingle) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, "id long, fp long")


@cache
def position_sets(size: int, within: int, of: int = 8) -> tuple[tuple[int, ...], ...]:
    """Sets of `size` byte positions, such that any `within` of the positions contain one
    of them; picked greedily, in order."""
    todo = set(combinations(range(of), within))
    picked = []
    while todo:
        best = max(combinations(range(of), size), key=lambda s: sum(set(s) <= set(t) for t in todo))
        picked.append(best)
        todo = {t for t in todo if not set(best) <= set(t)}
    return tuple(picked)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(fps: DataFrame, max_bits: int = 3, key_bytes: int = 4) -> DataFrame:
    """(a, b), a < b: all pairs of the distinct longs in fps.fp that differ in at most
    max_bits bits (0 to 4). Nulls link with nothing."""
    least = 8 - max_bits
    masks = [_signed(sum(0xFF << 8 * i for i in s)) for s in position_sets(min(key_bytes, least), least)]
    posted = fps.select("fp").where("fp is not null").distinct().select(
        "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("list", "key")
    )
    a, b = posted.alias("a"), posted.alias("b")
    x: Column = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    tally = sum((F.when(x.bitwiseAND(F.lit(_signed(0xFF << 8 * i))) == 0, 1).otherwise(0) for i in range(1, 8)), F.when(x.bitwiseAND(F.lit(0xFF)) == 0, 1).otherwise(0))
    first = F.coalesce(*[F.when(x.bitwiseAND(F.lit(m)) == 0, F.lit(i)) for i, m in enumerate(masks)])
    meet = (F.col("a.list") == F.col("b.list")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp"))
    return a.join(b, meet & (F.bit_count(x) <= max_bits) & (tally >= least) & (F.col("a.list") == first)).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 3, shingle: int = 3) -> DataFrame:
    """(id_col, fingerprint, component_id): one row per row of docs.

    fingerprint: 16 lowercase hex digits. component_id: the smallest id reachable over
    links, a row's own included. Rows with null or empty text have fingerprint zero and
    link with each other. Null ids get a component if any row they link with has an id,
    else null. Repeated ids: each row is kept. Empty table: no rows. Other columns are
    not read, whatever their names.
    """
    fps = cut(fingerprints(docs, id_col, text_col, shingle))
    least = fps.groupBy("fp").agg(F.min("id").alias("least"))
    found = cut(components(links(fps, max_bits)))
    group = least.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ids = cut(group.groupBy("component").agg(F.min("least").alias("component_id")))
    by_fp = cut(group.join(ids, "component").select("fp", "component_id"))
    return fps.join(by_fp, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Whole documents as near copies: a wide fingerprint of many positions, and the shingles themselves

#: Positions of a wide fingerprint, and about how many shingles the block at each stands for.
POSITIONS, EACH, EACH_SHORT = 32, 6, 3
#: Bytes of a block that are SimHash; the two above them are its place. One of so many positional
#: bytes must be shared: texts at a similarity of 0.8 share about two in five, others one in 256.
BYTES, COUNT = 6, 5


def shingles(text: bytes, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles of words; fewer words: of the whole sequence."""
    words = text.lower().split()
    grams = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)) if len(words) >= size else [b" ".join(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), np.uint64) if words else np.zeros(0, np.uint64))


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """Signed longs, one for each position: the SimHash, of BYTES bytes, of the shingles that fall into
    one of 2^t classes by their hash, below t and the class, which are its place. Of long texts only POSITIONS of the
    classes count, so that a class has about EACH shingles (EACH_SHORT in short texts).
    Texts whose sizes are a fifth apart at most share a t: each has one or two."""
    n = len(h)
    if not n:
        return np.zeros(0, np.int64)
    about = np.log2(max(n / EACH, min(POSITIONS, n / EACH_SHORT), 1))
    out = []
    for t in sorted({round(max(0.0, about + d)) for d in (-0.17, 0.17)}):
        kind = h & np.uint64((1 << t) - 1)
        order = np.argsort(kind, kind="stable")
        order = order[kind[order] < POSITIONS]
        of, start = np.unique(kind[order], return_index=True)
        if len(of):
            mixed = (h[order] ^ (h[order] >> np.uint64(t))) * np.uint64(0x9E3779B97F4A7C15)  # the class's own bits say nothing
            bits = np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)
            ones, size = np.add.reduceat(bits, start, 0), np.diff(np.r_[start, len(order)])
            block = np.packbits(ones * 2 > size[:, None], axis=1, bitorder="little").view("<u8").ravel()
            out.append((block >> np.uint64(16) | of.astype(np.uint64) << np.uint64(48) | np.uint64(t << 56)).view(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _sets(batches):
    """Of (id, row, t): digest of the shingle set and the wide fingerprint."""
    for batch in batches:
        sets = [shingles(t or b"") for t in batch.column(2).to_pylist()]
        digest = [xxhash.xxh3_128_digest(h.tobytes()) for h in sets]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digest, pa.binary()), pa.array([wide_fingerprint(h) for h in sets], pa.list_(pa.int64()))], ["id", "row", "set", "blocks"])


def counted(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """pairs (a, b) of nodes (node, blocks) whose wide fingerprints share one in COUNT of the
    positional bytes at the places that both have, at least."""

    def run(batches):
        for batch in batches:
            sides = []
            for k in (2, 3):
                of = np.repeat(np.arange(len(batch), dtype=np.int64), batch.column(k).value_lengths().to_numpy())
                block = batch.column(k).flatten().to_numpy().view(np.uint64)
                sides.append((of << 16 | (block >> np.uint64(48)).astype(np.int64), block))
            place, i, j = np.intersect1d(sides[0][0], sides[1][0], assume_unique=True, return_indices=True)
            differ = (sides[0][1][i] ^ sides[1][1][j]).view(np.uint8).reshape(-1, 8)[:, :BYTES]
            pair = place >> 16
            tally = np.bincount(pair, (differ == 0).sum(1), len(batch))
            kept = pa.array(tally * COUNT >= BYTES * np.maximum(np.bincount(pair, minlength=len(batch)), 1))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], ["a", "b"])

    sides = [nodes.select(F.col("node").alias(k), F.col("blocks").alias(f"at_{k}")) for k in "ab"]
    return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "at_a", "at_b").mapInArrow(run, "a long, b long")


def similar_pairs(nodes: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of nodes (node, blocks, and the row that stands for each: id, row) whose shingle sets
    have at least that Jaccard similarity: found over the positions' index, tallied by the
    positional bytes that they share (see counted), verified on the sets.

    Texts that share a block at some position are compared with four of those that do, by
    four orders, so a block that very many share gives as many pairs as texts; all that
    share blocks are connected by them. texts (id, row, t) are read for candidates only.
    """
    posted = cut(nodes.select("node", F.explode("blocks").alias("block")))
    place = F.pmod("block", F.lit(4))
    first = posted.groupBy("block").agg(F.min_by("node", F.struct(F.xxhash64("node", place), "node")).alias("first"), F.count("*").alias("n")).where("n > 1")
    met = join_split(posted, first, ["block"], "first").where("node <> first")
    pairs = cut(counted(met.select(F.least("node", "first").alias("a"), F.greatest("node", "first").alias("b")).distinct(), nodes))
    need = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "id", "row"), "node")
    found = texts.alias("t").join(need.alias("n"), (F.col("t.row") == F.col("n.row")) & F.col("t.id").eqNullSafe(F.col("n.id"))).select("node", "t.t")

    def run(batches):
        for batch in batches:
            h = [shingles(t or b"").view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h, pa.list_(pa.int64()))], ["node", "h"])

    grams = cut(found.dropDuplicates(["node"]).mapInArrow(run, "node long, h array<long>"))
    both = pairs.join(grams.select(F.col("node").alias("a"), F.col("h").alias("x")), "a").join(grams.select(F.col("node").alias("b"), F.col("h").alias("y")), "b")

    def compare(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = x.values.to_numpy(zero_copy_only=False), y.values.to_numpy(zero_copy_only=False)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared >= similarity * (len(x) + len(y) - shared) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_())), batch.column(1).filter(pa.array(keep, pa.bool_()))], ["a", "b"])

    return both.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """docs with one document of each group of near copies: the one with the smallest id (null last).

    Documents are linked whose sets of five-word shingles have a Jaccard similarity of at
    least `similarity`: candidates by the index over wide fingerprints, kept by a count of
    the positional bytes they share, each verified on the sets. Texts with fewer words are one shingle; texts without a word are copies of
    each other. Rows that repeat an id are rows of their own: which of them stays, if they
    are near copies, is decided by a hash of all their columns. Of wholly equal rows one
    stays. All columns are returned as they came; all must be of types that can be hashed.
    """
    row = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), row, F.col(text_col).cast("binary").alias("t"))
    sets = cut(rows.mapInArrow(_sets, "id long, row long, set binary, blocks array<long>"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    nodes = cut(sets.groupBy("set").agg(F.min(order).alias("first"), F.first("blocks").alias("blocks")))
    nodes = nodes.select("set", "blocks", "first", F.col("first.id").alias("id"), F.col("first.row").alias("row"), F.monotonically_increasing_id().alias("node"))
    group = cut(components(similar_pairs(nodes, rows, similarity))).withColumnRenamed("node", "_node")
    grouped = nodes.join(group, F.col("node") == F.col("_node"), "left").withColumn("component", F.coalesce("component", "node"))
    least = grouped.groupBy("component").agg(F.min("first").alias("stays"))
    decided = grouped.join(least, "component").select("set", "stays")
    marked = cut(sets.select("id", "row", "set").join(decided, "set").select("id", "row", (F.col("id").eqNullSafe(F.col("stays.id")) & (F.col("row") == F.col("stays.row"))).alias("kept")))
    gone = marked.where("NOT kept").select(F.col("id").alias("_gone"), F.col("row").alias("_gone_row")).distinct()
    twice = cut(marked.where("kept").groupBy("id", "row").count().where("count > 1").select(F.col("id").alias("_gone"), F.col("row").alias("_gone_row")))
    whole = docs.select(F.struct("*").alias("_whole"), F.col(id_col).cast("long").alias("_id"), row.alias("_row"))  # so that no name clashes
    named = lambda k: F.col("_id").eqNullSafe(k["_gone"]) & (F.col("_row") == k["_gone_row"])
    out = whole.join(gone, named(gone), "left_anti")
    if not twice.isEmpty():
        out = out.join(twice, named(twice), "left_anti").unionByName(whole.join(twice, named(twice), "left_semi").dropDuplicates(["_id", "_row"]))
    return out.select("_whole.*")
