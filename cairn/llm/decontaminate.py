"""Benchmark decontamination: size-partitioned MinHash containment search.

An item of q distinct shingles that a document contains to a share t misses at most
(1 - t) q of them. So of the item's floor((1 - t) q) + 1 smallest shingle hashes, a
bottom-k MinHash sketch, at least one is in the document: sketches of that length miss
nothing. Items are partitioned by size (powers of two) and each partition takes the
length that its largest item needs, however long the documents are. Documents that hit
a sketch are candidates; containment is then counted on the shingles themselves.

Words are runs of letters and digits in lower case. An item with fewer words than a
shingle is one shingle: its whole sequence.
"""

from __future__ import annotations

import re
from collections import defaultdict

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import cut, join_split

WORD = re.compile(r"[^\W_]+")
#: Items of at most so many bytes together are sent to every task; beyond, they are joined.
BROADCAST_BYTES = 32 << 20


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def shingles_of(words: list[str], n: int) -> set[str]:
    return {" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def sketch_of(grams: set[str], threshold: float) -> list[str]:
    """The shingles of smallest hash, as many as the item's size partition needs."""
    largest = 1 << (len(grams) - 1).bit_length()
    k = min(len(grams), int((1 - threshold) * largest + 1e-9) + 1)
    return sorted(grams, key=lambda g: (xxhash.xxh64_intdigest(g, 7), g))[:k]


def _keep(threshold: float, hit: int, size: int) -> bool:
    return hit >= threshold * size - 1e-9


def _sent(docs: DataFrame, items: list, n: int, threshold: float) -> DataFrame:
    """Items in every task: candidates and their check in one pass over the texts."""
    index = defaultdict(list)  # sketch shingle -> items
    sizes, lengths = [], set()
    for k, (_, text) in enumerate(items):
        words = words_of(text)
        grams = shingles_of(words, n)
        sizes.append(grams)
        if grams:
            lengths.add(min(n, len(words)))
            for g in sketch_of(grams, threshold):
                index[g].append(k)
    known = {w for grams in sizes for g in grams for w in g.split(" ")}
    index, ids = dict(index), [i for i, _ in items]
    sent = docs.sparkSession.sparkContext.broadcast((index, sizes, ids, known, sorted(lengths)))

    def run(batches):
        index, sizes, ids, known, lengths = sent.value
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                grams = set()
                for m in lengths:
                    if m == 1:
                        grams.update(w for w in words if w in known)
                        continue
                    run_of = 0  # known words in a row: a shingle with another word is in no item
                    for i, w in enumerate(words):
                        run_of = run_of + 1 if w in known else 0
                        if run_of >= m:
                            grams.add(" ".join(words[i - m + 1 : i + 1]))
                for k in {k for g in grams & index.keys() for k in index[g]}:
                    hit = len(sizes[k] & grams)
                    if _keep(threshold, hit, len(sizes[k])):
                        out.append((key, ids[k], len(sizes[k]), hit))
            cols = [*zip(*out, strict=True)] or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["id", "item", "n_shingles", "n_shared"])

    return docs.mapInArrow(run, "id long, item long, n_shingles long, n_shared long")


def _joined(docs: DataFrame, items: DataFrame, n: int, threshold: float) -> DataFrame:
    """Items of any number: sketches are joined with the documents' shingles, then the
    items' shingles with those of candidate documents."""

    def doc_grams(batches):
        lengths = sent.value
        for batch in batches:
            out = []
            for row, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text)
                out += ((row, key, g) for g in set().union(*(shingles_of(words, m) for m in lengths if len(words) >= m)))
            cols = [*zip(*out, strict=True)] or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["row", "id", "gram"])

    def item_grams(batches):
        for batch in batches:
            out = []
            for row, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text)
                grams = shingles_of(words, n)
                first = set(sketch_of(grams, threshold)) if grams else set()
                out += ((row, key, min(n, len(words)), len(grams), g, g in first) for g in grams)
            cols = [*zip(*out, strict=True)] or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["item_row", "item", "length", "n_shingles", "gram", "sketch"])

    numbered = lambda df: df.select(F.monotonically_increasing_id().alias("row"), "id", "t")  # noqa: E731  rows, whatever their ids
    of_items = cut(numbered(items).mapInArrow(item_grams, "item_row long, item long, length long, n_shingles long, gram string, sketch boolean"))
    sent = docs.sparkSession.sparkContext.broadcast(sorted(r[0] for r in of_items.select("length").distinct().collect()))  # n lengths at most
    known = of_items.select("gram").distinct()
    grams = cut(numbered(docs).mapInArrow(doc_grams, "row long, id long, gram string").join(known, "gram", "left_semi"))
    often = of_items.where("sketch").join(grams.groupBy("gram").agg(F.count("*").alias("n")), "gram")
    posted = often.groupBy("gram").agg(F.collect_set("item_row").alias("of"), F.first("n").alias("n"))
    candidates = join_split(grams.select("row", "gram"), posted, ["gram"], "of").select("row", F.explode("of").alias("item_row")).distinct()
    pairs = candidates.join(of_items.select("item_row", "item", "n_shingles", "gram"), "item_row").join(grams, ["row", "gram"])
    counted = pairs.groupBy("row", "id", "item_row", "item", "n_shingles").agg(F.count("*").alias("n_shared"))
    return counted.where(F.col("n_shared") >= threshold * F.col("n_shingles") - 1e-9).select("id", "item", "n_shingles", "n_shared")


def leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.8, n: int = 5, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment): documents that contain an
    item's distinct n-word shingles to a share of at least threshold.

    docs: doc_id, text; items: item_id, text; other columns are not read. Null or empty
    texts, and texts without a letter or digit, match nothing. A repeated id gives one
    row for each row of docs that matches, a null id too, and each row of items is an item of
    its own: the same rows whether items are sent to the tasks or, being many, joined.
    Empty tables: no rows.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("t"))
    i = items.select(F.col("item_id").cast("long").alias("id"), F.col("text").cast("string").alias("t"))
    total = i.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    found = _sent(d, i.collect(), n, threshold) if total <= broadcast_bytes else _joined(d, i, n, threshold)
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def clean(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """docs without the documents that leak an item. Rows with null ids cannot be named by
    a leak and stay."""
    gone = leaks(docs, items, threshold).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
