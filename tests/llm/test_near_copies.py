"""The pipeline's near copies against brute force on five-word shingles."""

import numpy as np
from pyspark.sql import functions as F

from cairn.llm import simhash


def grams(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(grams(a) & grams(b)) / max(1, len(grams(a) | grams(b)))


def corpus(seed=4):
    """Originals of 30 to 1500 words, edited copies of each, at similarities around the threshold."""
    rng = np.random.default_rng(seed)
    words = [f"word{i}" for i in range(5000)]
    out = []
    for k in range(120):
        n = int(rng.choice([30, 80, 200, 500, 1500]))
        base = rng.choice(words, n).tolist()
        out.append(" ".join(base))
        for share in (0.005, 0.015, 0.022, 0.06):
            copy = list(base)
            for at in rng.choice(n, max(1, int(share * n)), replace=False):
                copy[at] = str(rng.choice(words))
            out.append(" ".join(copy))
    return out


def test_recall_and_precision(spark):
    texts = corpus()
    close = [(i, j) for k in range(0, len(texts), 5) for i in range(k, k + 5) for j in range(i + 1, k + 5) if jaccard(texts[i], texts[j]) >= 0.8]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string").select("id", F.lit(0).cast("long").alias("row"), F.col("t").cast("binary").alias("t"))
    nodes = rows.mapInArrow(simhash._sets, "id long, row long, set binary, blocks array<long>").withColumn("node", F.col("id"))
    got = {tuple(r) for r in simhash.similar_pairs(nodes, rows, 0.8).collect()}
    assert got <= set(close)  # nothing below the threshold, nothing between originals
    up = list(range(len(texts)))
    root = lambda i: i if up[i] == i else root(up[i])
    for a, b in got:
        up[max(root(a), root(b))] = min(root(a), root(b))
    assert len(close) > 300 and sum(root(a) == root(b) for a, b in close) >= 0.98 * len(close)


def test_rows_of_one_id(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long, "a"), (1, "another text that is wholly different from it", "b"), (2, long + " end", "c"), (None, long, "d"), (3, "", "e"), (4, None, "f"), (5, "one two", "g"), (5, "one two", "g"), (6, "ONE  two", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string")
    got = sorted((r["doc_id"] or 0, r["row"]) for r in simhash.keep_one(df).collect())
    assert got == [(1, "a"), (1, "b"), (3, "e"), (5, "g")]
    assert simhash.keep_one(df.limit(0)).count() == 0
    assert simhash.keep_one(df).columns == df.columns


def test_one_large_group(spark):
    """Hundreds of near copies of one text are one group, without a pair for each two."""
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(base[: i % 290 + 5] + [f"x{i}"] + base[i % 290 + 5 :])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["doc_id"] for r in simhash.keep_one(df).collect()] == [0]


def test_count_filter(spark):
    """Pairs pass by the positional bytes that they share, as brute force counts them; near copies
    do, and texts that share one passage and with it a block do not."""
    texts = corpus(5)[:60]
    common = [f"same{i}" for i in range(60)]
    texts += [" ".join([f"{k}x{i}" for i in range(400)] + common) for k in range(6)]
    prints = [simhash.wide_fingerprint(simhash.shingles(t.encode())).tolist() for t in texts]
    nodes = spark.createDataFrame(list(enumerate(prints)), "node long, blocks array<long>")
    every = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts))]
    got = {tuple(r) for r in simhash.counted(spark.createDataFrame(every, "a long, b long"), nodes).collect()}
    want = set()
    for i, j in every:
        at = [{b >> 48: (b & (1 << 48) - 1).to_bytes(6, "little") for b in prints[k]} for k in (i, j)]
        both = at[0].keys() & at[1].keys()
        shared = sum(x == y for p in both for x, y in zip(at[0][p], at[1][p], strict=True))
        if shared * simhash.COUNT >= 6 * max(1, len(both)):
            want.add((i, j))
    assert got == want
    close = {(i, j) for i, j in every if jaccard(texts[i], texts[j]) >= 0.8}
    assert len(close & got) >= 0.98 * len(close) > 30
    assert not any(i >= 60 and j >= 60 for i, j in got)
