"""op3's dictionary and its suffix order, against brute force."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from test_operators import repeats_brute

from cairn.llm import suffixes
from cairn.llm.common import Scratch


def letters(seed, n):
    return bytes(np.random.default_rng(seed).integers(97, 123, n, np.uint8)).decode()


def dictionary(spark, texts):
    """(windows in contexts of shared anchors, windows in the dictionary) of texts."""
    docs = spark.createDataFrame(list(enumerate(texts)), "ord long, s string").select("ord", F.col("s").cast("binary").alias("t"))
    found = suffixes.occurrences(docs)
    shared = found.join(found.groupBy("anchor").count().where("count > 1"), "anchor")
    by_doc = shared.groupBy("ord").agg(F.collect_list(F.struct("at", "windows", "back")).alias("open"))
    contexts = docs.join(by_doc, "ord").select("ord", "t", "open").mapInArrow(suffixes._regions, "ord long, start long, text binary, phrases array<struct<o:bigint,windows:bigint,back:bigint>>")
    kept = suffixes.dictionary(contexts, Scratch(spark)).agg(F.coalesce(F.sum("windows"), F.lit(0))).first()[0]
    return shared.agg(F.coalesce(F.sum("windows"), F.lit(0))).first()[0], kept


def test_windows_without_equals_are_not_sorted(spark):
    """Texts that share 90 bytes have anchors in common and no window: nothing is left to sort."""
    texts = [letters(k, 400) + letters(99, 90) + letters(50 + k, 400) for k in range(3)]
    open_, kept = dictionary(spark, texts)
    assert open_ > 0 and kept == 0
    texts = [letters(k, 400) + letters(99, 130) + letters(50 + k, 400) for k in range(3)]
    open_, kept = dictionary(spark, texts)
    assert 3 * 31 <= kept <= 3 * (31 + 2 * suffixes.PIECE) and kept < open_


def test_passages_that_begin_anywhere(spark):
    """Passages of 95 to 400 bytes of a few sources, between other text; in several partitions."""
    rng = np.random.default_rng(8)
    sources = [letters(k, 1000) for k in range(4)]
    texts = []
    for k in range(150):
        parts = []
        for _ in range(int(rng.integers(1, 5))):
            at, n = int(rng.integers(0, 900)), int(rng.choice([95, 99, 100, 101, 140, 400]))
            parts += [sources[int(rng.integers(4))][at : at + n], letters(int(rng.integers(1 << 30)), int(rng.integers(0, 60)))]
        texts.append("".join(parts))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {r[0]: tuple(r)[1:] for r in suffixes.repeated_bytes(rows).collect()}
    want = repeats_brute([(i, t.encode()) for i, t in enumerate(texts)])
    assert got == want and sum(w[1] > 0 for w in want.values()) > 100


def test_spans_of_rows():
    rows = [[(5, 1), (0, 2), (300, 1), (106, 1)], None, [], [(0, 1)], [(101, 1), (0, 1)], [(100, 1), (0, 1)]]
    kind = pa.list_(pa.struct([("at", pa.int64()), ("windows", pa.int64())]))
    column = pa.array([r and [{"at": a, "windows": w} for a, w in r] for r in rows], kind)
    assert suffixes.spans_of(column) == [[(0, 105), (106, 206), (300, 400)], [], [], [(0, 100)], [(0, 100), (101, 201)], [(0, 200)]]


def dealt(texts, bits, frequent, monkeypatch, block):
    """What _dealer gives for texts, in several batches, and what _marker makes of it, sorted by bucket."""
    monkeypatch.setattr(suffixes, "BLOCK", block)
    batches = [pa.RecordBatch.from_arrays([pa.array(range(k, min(k + 7, len(texts)))), pa.array([t.encode() for t in texts[k : k + 7]], pa.binary())], ["ord", "t"]) for k in range(0, len(texts), 7)]
    given = pa.Table.from_batches(suffixes._dealer(bits, frequent)(batches[::-1]))
    rows = given.sort_by("bucket").to_batches(max_chunksize=5)
    marked = [tuple(r.values()) for b in suffixes._marker(frequent)(rows) for r in b.to_pylist()]
    return batches, given, marked


def test_phrases_are_marked_as_one_by_one(monkeypatch):
    """In one block or many, with frequent anchors or none: later phrases and firsts of shared anchors."""
    texts = [letters(k % 20, 300) + letters(99, 90) + letters(50 + k, 200) + letters(98, 150) * (k % 3) for k in range(60)] + ["", "ab" * 400]
    for block in (10**6, 100):
        for often in (False, True):
            batches, _, marked = dealt(texts, 4, np.zeros(0, np.int64), monkeypatch, block)
            all_ = sorted((tuple(int(x) for x in r) for cols in suffixes._found(batches) for r in zip(*cols, strict=True)), key=lambda r: r[2:4])
            ctxs, first = {}, {}
            for a, c, o, at, *_ in all_:
                ctxs.setdefault(a, set()).add(c)
                first.setdefault((a, c), (o, at))
            counts = {}
            for a, *_ in all_:
                counts[a] = counts.get(a, 0) + 1
            hot = sorted(a for a, n in counts.items() if n > 8) if often else []
            if often:
                marked = dealt(texts, 4, np.array(hot), monkeypatch, block)[2]
            want = [(o, at, w, b, (o, at) == first[a, c]) for a, c, o, at, w, b in all_ if (o, at) != first[a, c] or len(ctxs[a]) > 1 or a in hot]
            assert sorted(marked) == sorted(want) and len({x[-1] for x in want}) == 2 and bool(hot) == often


def test_buckets_are_even(monkeypatch):
    """A passage that all texts have, in other text each: no bucket holds it or more than its share."""
    texts = [letters(k, 300) + letters(999, 90) + letters(5000 + k, 300) for k in range(2000)]
    for block in (10**6, 500):
        batches, given, _ = dealt(texts, 3, np.zeros(0, np.int64), monkeypatch, block)
        anchors = np.concatenate([cols[0] for cols in suffixes._found(batches)])
        found, n = np.unique(anchors, return_counts=True)
        given = dealt(texts, 3, found[n > 20], monkeypatch, block)[1]
        held = given.append_column("n", pa.array([len(x) for x in given["at"].to_pylist()])).group_by("bucket").aggregate([("n", "sum")])["n_sum"].to_numpy()
        assert n.max() > 1000 and len(held) == 8 and held.max() < 1.15 * held.mean()


def test_tasks_hash_little_at_once():
    """What a task holds while it parses does not grow with the rows of a batch or the length of a text."""
    texts = [letters(k, 40_000).encode() for k in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(texts, pa.binary())], ["ord", "t"])
    tracemalloc.start()
    try:
        for _ in suffixes._found([batch]):
            pass
        assert tracemalloc.get_traced_memory()[1] < 30e6
    finally:
        tracemalloc.stop()


def test_few_rows_go_to_python_at_once(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(b)])], ["n"])

    got = Scratch(spark).write(spark.range(0, 5000, 1, 1).mapInArrow(sizes, "n long"), "sizes")
    assert max(r[0] for r in got.collect()) <= 1000 and spark.conf.get(key) == before


def test_a_passage_of_all_documents(spark, monkeypatch):
    """Frequent anchors are found and dealt by context; the result is as by brute force."""
    monkeypatch.setattr(suffixes, "LOOK", 1)
    monkeypatch.setattr(suffixes, "BLOCK", 300)
    texts = [letters(k % 90, 120) + letters(7777, 60 + k % 80) + letters(300 + k, 50) for k in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r[0]: tuple(r)[1:] for r in suffixes.repeated_bytes(rows).collect()}
    assert got == repeats_brute([(i, t.encode()) for i, t in enumerate(texts)])
