"""The language model against sums over its whole vocabulary and finite differences."""

from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from cairn.llm import lm


def model(spark, words, seed=1):
    rows = spark.createDataFrame([(w.encode(), c) for w, c in words.items()], "word binary, c long")
    vocab = lm.vocabulary(rows, sum(words.values()), len(words))
    w = np.random.default_rng(seed).normal(0, 0.5, (lm.slots_of(sum(words.values())), lm.RADIX)).astype(np.float32)
    return vocab, w


WORDS = {f"w{i}": 1 + i % 7 for i in range(900)} | {"": 40, "the": 200}


def test_chances_sum_to_one(spark):
    """Of every history, the words' chances and those of unknown words sum to one."""
    vocab, w = model(spark, WORDS)
    leaf = [int(r[0]) for r in spark.createDataFrame([(x.encode(),) for x in WORDS], "word binary").select(lm.leaf_of(F.col("word"), vocab["levels"])).collect()]
    crc = np.array([crc32(x.encode()) for x in WORDS], np.int64)
    assert lm.leaves(crc, vocab["levels"]).tolist() == leaf
    for last in ("the w1 w2", "w3 w3 w3", "unseen words here"):
        before = [np.full(len(crc), crc32(x.encode()), np.int64) for x in last.split()]
        chance = 10 ** (lm.log_probs(vocab, w, crc, before) + np.log10(np.array([*WORDS.values()]) + 0.1))
        of_leaf = np.ones(len(vocab["mass"]))
        every = np.arange(len(of_leaf))
        features = lm.history([np.full(len(every), b[0], np.int64) for b in before])
        for level, node, digit in lm.paths(every, vocab["levels"]):
            of_leaf *= lm.softmax(vocab["bias"][level], node, w, lm.rows_of(features, level, node, len(w)))[every, digit]
        assert abs(chance.sum() + (0.1 * of_leaf / vocab["mass"]).sum() - 1) < 1e-5


def test_step_is_the_gradient(spark, monkeypatch):
    """With a large ease, a step is the gradient by finite differences, times a constant."""
    vocab, w = model(spark, WORDS)
    rng = np.random.default_rng(2)
    crc = np.array([crc32(x.encode()) for x in rng.choice([*WORDS], 60)], np.int64)
    before = [np.roll(crc, k) for k in (1, 2, 3)]
    monkeypatch.setattr(lm, "EASE", 1e12)
    leaf, features = lm.leaves(crc, vocab["levels"]), lm.history(before)
    new, zero = w.astype(np.float64), np.zeros(len(w))
    lm.descend(vocab, new, zero.copy(), zero.copy(), leaf, features)
    change = (new - w) * 1e6 / lm.RATE
    value = lambda w: lm.log_probs(vocab, w, crc, before).sum() * np.log(10)
    for slot in np.flatnonzero(np.abs(change).sum(1))[:5]:
        for j in (0, 7):
            up, down = w.astype(np.float64), w.astype(np.float64)
            up[slot, j] += 1e-2
            down[slot, j] -= 1e-2
            assert abs((value(up) - value(down)) / 2e-2 - change[slot, j]) < 0.02


def test_long_text_in_pieces(spark, monkeypatch):
    """A text that is made tokens in pieces has the tokens and histories of the whole."""
    text = b"one two\nthree  four five six seven eight nine ten " * 5
    whole = list(lm.sequences([text, None, b"a b"]))
    monkeypatch.setattr(lm, "CHUNK", 24)
    parts = list(lm.sequences([text, None, b"a b"]))
    assert len(parts) > 5
    for k in (0, 2):
        assert np.concatenate([np.asarray(p[k]) for p in parts]).tolist() == np.concatenate([np.asarray(p[k]) for p in whole]).tolist()
    for back in range(3):
        assert np.concatenate([p[3][back] for p in parts]).tolist() == np.concatenate([p[3][back] for p in whole]).tolist()
    assert sum((p[1] for p in parts), []) == [*text.split(), b"", b"", b"a", b"b", b""]
