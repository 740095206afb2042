"""Language-model scoring by a hashed maximum-entropy model.

Every word has a place in a tree of classes: the digits, base RADIX, of a hash of the word
name a class, a class within it and so on, in LEVELS steps (as many as the vocabulary
asks for). P(word | history) is the product of the softmaxes of its digits, each given the
digits before, and of the word's smoothed share of the counts of its last class. The
softmaxes start from the classes' shares of the counts and add hashed features of the
history: the last word, the last two words, and the word two back (a skip). Words that
share the last class, several at most where the vocabulary is large, are told apart by
their counts alone.

Weights are trained by distributed gradient updates: in each round the tasks take AdaGrad
steps on their own documents, from the same weights, and of each weight the changes are
averaged by how often each task used it. Each training document is used in one round.
Counts are of all training documents; scores are of all documents, in numpy batches that
touch only the rows of the weights that the text needs.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import crc_mod, cut

RADIX, BITS = 16, 4
#: Features of the history in the first softmax, in those behind it, and how many are first.
WIDE, NARROW, WIDE_LEVELS = 3, 1, 1
#: Words of at most this number of kinds are counted in every task; rarer ones are joined.
HEAD = 200_000
ROUNDS = 3
#: Tokens of one gradient step or one batch of scores; bytes of text that are made tokens at once.
STEP, CHUNK = 32_768, 1 << 19
RATE, EASE = 0.4, 4.0
#: Rows of weights that are sent together.
BLOCK = 4096
END = b""
START = 0x9E3779B9
_MIX = 1_540_483_477  # times 32 bits, this fits a signed long


def levels_of(v: int) -> int:
    """Softmaxes of a word, for v kinds of words: their last classes are about v to the power 3/4."""
    return int(min(5, max(2, round(0.75 * np.log(max(v, 2)) / np.log(RADIX)))))


def slots_of(n: int) -> int:
    """Rows of hashed weights for n training tokens: about 16 times the square root, from 2^12 on,
    and 2^22 (268 MB) at the most, since each task holds them."""
    return 1 << int(min(22, max(12, np.ceil(np.log2(16 * np.sqrt(max(n, 1)))))))


def pieces(text: bytes | None):
    """Lists of the tokens of text, a bounded number at a time: words in ASCII lower case, then
    the end, which is the empty token."""
    text, at = text or b"", 0
    while len(text) - at > CHUNK:
        stop = at + CHUNK
        while stop < len(text) and not text[stop : stop + 1].isspace():
            stop += 1
        yield text[at:stop].lower().split()
        at = stop
    yield [*text[at:].lower().split(), END]


def count_tokens(docs: DataFrame) -> DataFrame:
    """(word, c) of docs' t, a binary column; counted in the tasks before the shuffle."""

    def run(batches):
        some: Counter = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(some), pa.binary()), pa.array(list(some.values()), pa.int64())], ["word", "c"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for words in pieces(text):
                    some.update(words)
                if len(some) > 500_000:
                    yield rows()
                    some.clear()
        yield rows()

    return docs.select("t").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def head_of(counts: DataFrame, most: int = HEAD) -> list[tuple[bytes, int]]:
    """The most frequent words with their counts, most at the most: all words of at least some
    count, found from a histogram of the counts, so that nothing is sorted in one task."""
    bins = sorted(counts.groupBy(F.floor(F.log2("c") * 16).alias("b")).count().collect(), reverse=True)
    total, least = 0, None
    for b, n in bins:
        total += n
        if total > most:
            break
        least = b
    if least is None:
        return []
    rows = counts.where(F.floor(F.log2("c") * 16) >= least).collect()
    return sorted(((bytes(w), c) for w, c in rows), key=lambda x: (-x[1], x[0]))


def leaf_of(word: Column, levels: int) -> Column:
    """A word's last class, as leaves() has it."""
    mixed = (F.crc32(word) * F.lit(_MIX)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftright(mixed, 32 - BITS * levels)


def leaves(crc: np.ndarray, levels: int) -> np.ndarray:
    return (crc.astype(np.uint64) * np.uint64(_MIX) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - BITS * levels)


def vocabulary(counts: DataFrame, n: int, v: int) -> dict:
    """What every task knows of the counts: the frequent words' own, and by last class the mass of
    its words, each with 0.1 more, and 0.1 for all that are unknown."""
    levels = levels_of(v)
    words = head_of(counts)
    by_leaf = counts.groupBy(leaf_of(F.col("word"), levels).alias("leaf")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()
    mass = np.full(RADIX**levels, 0.1)
    for leaf, c, kinds in by_leaf:
        mass[leaf] += c + 0.1 * kinds
    bias, up = [], mass
    for _ in range(levels):
        part = up.reshape(-1, RADIX)
        up = part.sum(1)
        bias.append(np.log(part / up[:, None]).astype(np.float32))
    return {
        "ids": {w: i for i, (w, _) in enumerate(words)}, "counts": np.array([c for _, c in words] + [0], np.float64),
        "mass": mass, "bias": bias[::-1], "levels": levels, "n": n, "v": v,
    }


def sequences(texts: list[bytes | None]):
    """(row, words, crc32 of each word, crc32 of the last, second and third token before each) of
    runs of rows, of about CHUNK bytes; row: the text of each token."""
    held: list[tuple[int, list[bytes], tuple[int, int, int]]] = []
    size = 0

    def done():
        pads, n = [c for *_, c in held], np.array([len(w) for _, w, _ in held], np.int64)
        words = list(chain.from_iterable(w for _, w, _ in held))
        crc = np.fromiter(map(crc32, words), np.int64, len(words))
        before = []
        for back in (1, 2, 3):
            b = np.empty_like(crc)
            b[back:] = crc[:-back]
            before.append(b)
        starts = np.cumsum(n) - n
        for k, (at, pad) in enumerate(zip(starts.tolist(), pads, strict=True)):
            for back in range(1, 4):
                for i in range(min(back, int(n[k]))):
                    before[back - 1][at + i] = pad[back - 1 - i]
        return np.repeat([r for r, *_ in held], n), words, crc, before

    for row, text in enumerate(texts):
        last = (START, START, START)
        for words in pieces(text):
            held.append((row, words, last))
            tail = [crc32(w) for w in words[-3:]][::-1]
            last = (*tail, *last)[:3]
            size += len(words)
            if size > CHUNK // 8:
                yield done()
                held, size = [], 0
    if held:
        yield done()


def history(before: list[np.ndarray]) -> list[np.ndarray]:
    """Hashes of the features: the last word, the last two, and the one two back."""
    a, b, _ = (x.astype(np.uint64) for x in before)
    m1, m2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    return [(a + np.uint64(1)) * m1, ((a * m2) ^ (b + np.uint64(7))) * m1, (b + np.uint64(3)) * m2]


def rows_of(features: list[np.ndarray], level: int, node: np.ndarray, slots: int) -> list[np.ndarray]:
    """The rows of weights that a softmax adds up: one for each feature, with its node."""
    key = (node.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ np.uint64(level * 0xA24BAED4963EE407 & (1 << 64) - 1)
    shift = np.uint64(64 - slots.bit_length() + 1)
    return [(((f ^ key) * np.uint64(0xFF51AFD7ED558CCD)) >> shift).astype(np.int64) for f in features[: WIDE if level < WIDE_LEVELS else NARROW]]


def softmax(bias: np.ndarray, node: np.ndarray, w: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """Of each token, the chances of all digits; weights are clipped, so nothing overflows."""
    z = bias.take(node, 0)
    for r in rows:
        z += w.take(r, 0)
    np.exp(z, out=z)
    z *= (1 / (z @ np.ones(RADIX, z.dtype)))[:, None]
    return z


def paths(leaf: np.ndarray, levels: int):
    """(level, node, digit) of each softmax on the way to the leaves."""
    leaf = leaf.astype(np.int64)
    for level in range(levels):
        yield level, leaf >> BITS * (levels - level), leaf >> BITS * (levels - 1 - level) & RADIX - 1


def descend(vocab: dict, w: np.ndarray, squares: np.ndarray, uses: np.ndarray, leaf: np.ndarray, features: list[np.ndarray]) -> None:
    """One AdaGrad step, in place, on the log probability of the tokens; a rate for each row."""
    for level, node, digit in paths(leaf, vocab["levels"]):
        rows = rows_of(features, level, node, len(w))
        p = softmax(vocab["bias"][level], node, w, rows)
        p[np.arange(len(digit)), digit] -= 1
        columns = np.ascontiguousarray(p.T, np.float64)
        for r in rows:
            order = np.argsort(r)
            at = r.take(order)
            new = np.r_[True, at[1:] != at[:-1]]
            used, group = at[new], np.empty_like(r)
            group[order] = np.cumsum(new) - 1
            g = np.stack([np.bincount(group, c, len(used)) for c in columns], 1)  # the rows' sums
            squares[used] += np.einsum("ij,ij->i", g, g)
            uses[used] += np.bincount(group)
            g *= (RATE / np.sqrt(squares[used] + EASE))[:, None]
            now = w.take(used, 0)
            now -= g
            w[used] = np.clip(now, -10, 10, out=now)


def train_round(docs: DataFrame, vocab: dict, weights: np.ndarray) -> np.ndarray:
    """Weights after one round over docs' t: of each row the tasks' changes, averaged by uses."""
    sc = docs.sparkSession.sparkContext
    sent = sc.broadcast(({k: vocab[k] for k in ("bias", "levels")}, weights))

    def run(batches):
        vocab, first = sent.value
        w, squares, uses = first.copy(), np.zeros(len(first), np.float32), np.zeros(len(first), np.float32)
        for batch in batches:
            for _, _, crc, before in sequences(batch.column(0).to_pylist()):
                leaf, features = leaves(crc, vocab["levels"]), history(before)
                for at in range(0, len(crc), STEP):
                    descend(vocab, w, squares, uses, leaf[at : at + STEP], [f[at : at + STEP] for f in features])
        for k in range(0, len(w), BLOCK):
            n = uses[k : k + BLOCK]
            if n.any():
                change = (w[k : k + BLOCK] - first[k : k + BLOCK]) * n[:, None]
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([n.astype("<f4").tobytes()], pa.binary()), pa.array([change.astype("<f4").tobytes()], pa.binary())], ["block", "uses", "change"])

    def add(batches):
        total: dict[int, list] = {}
        for batch in batches:
            for block, uses, change in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = np.frombuffer(uses, "<f4").astype(np.float64), np.frombuffer(change, "<f4").astype(np.float64)
                if block in total:
                    total[block][0] += x
                    total[block][1] += y
                else:
                    total[block] = [x, y]
        for block, (x, y) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([x.astype("<f4").tobytes()], pa.binary()), pa.array([y.astype("<f4").tobytes()], pa.binary())], ["block", "uses", "change"])

    kind = "block long, uses binary, change binary"
    # Few tasks, each over many documents: what they send does not grow with the corpus.
    parts = docs.select("t").coalesce(2 * sc.defaultParallelism).mapInArrow(run, kind)
    out = weights.copy()
    for block, uses, change in parts.repartition("block").mapInArrow(add, kind).collect():
        x, y = np.frombuffer(bytes(uses), "<f4"), np.frombuffer(bytes(change), "<f4").reshape(-1, RADIX)
        out[block : block + BLOCK] += y / np.maximum(x, 1)[:, None]
    sent.unpersist()
    return out


def log_probs(vocab: dict, w: np.ndarray, crc: np.ndarray, before: list[np.ndarray]) -> np.ndarray:
    """log10 of the chance of each token's last class, over the class's mass: what remains is the
    token's own count."""
    leaf, features = leaves(crc, vocab["levels"]), history(before)
    out = -np.log10(vocab["mass"][leaf.astype(np.int64)])
    for at in range(0, len(crc), STEP):
        some = slice(at, at + STEP)
        p = np.ones(len(leaf[some]))
        for level, node, digit in paths(leaf[some], vocab["levels"]):
            q = softmax(vocab["bias"][level], node, w, rows_of([f[some] for f in features], level, node, len(w)))
            p *= q.ravel().take(np.arange(0, q.size, RADIX) + digit)
        out[some] += np.log10(p)
    return out


def _scored(docs: DataFrame, vocab: dict, weights: np.ndarray) -> DataFrame:
    """Of each row: sums over the tokens in the head, and its other words with their numbers."""
    sent = docs.sparkSession.sparkContext.broadcast((vocab, weights))
    kinds = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))

    def run(batches):
        vocab, w = sent.value
        ids, rare = vocab["ids"], len(vocab["counts"]) - 1
        own = np.log10(vocab["counts"] + 0.1)
        own[rare] = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                m = part.num_rows
                size, known, base, score = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m), np.zeros(m)
                others: list[Counter] = [Counter() for _ in range(m)]
                for row, words, crc, before in sequences(part.column(2).to_pylist()):
                    at = np.fromiter(map(ids.get, words, repeat(rare)), np.int64, len(words))
                    add = lambda x: np.bincount(row, x, m)  # noqa: B023, E731
                    size += np.bincount(row, minlength=m)
                    known += add((at < rare).astype(float)).astype(np.int64)
                    base += add(own[at])
                    score += add(own[at] + log_probs(vocab, w, crc, before))
                    for i in np.flatnonzero(at == rare).tolist():
                        others[row[i]][words[i]] += 1
                base -= size * np.log10(vocab["n"] + 0.1 * (vocab["v"] + 1))
                rest = [[{"word": x, "n": n} for x, n in c.items()] for c in others]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(size), pa.array(known), pa.array(base), pa.array(score), pa.array(rest, kinds)], ["id", "held_out", "n_tokens", "n_known", "base", "score", "others"])

    return docs.select("id", "held_out", "t").mapInArrow(run, "id long, held_out boolean, n_tokens long, n_known long, base double, score double, others array<struct<word:binary,n:long>>")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, rounds: int = ROUNDS) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of
    docs. held_out: crc32(id) mod folds is 0; the model learns from all other documents.

    base_score: log10 probability by add-0.1 smoothed counts of the training tokens; score:
    by the model. Null and empty texts are the end token alone. Rows with a null id are
    learned from, not held out. Repeated rows count each. Empty table: no rows.
    Nothing to learn from: base_score is 0 for each token, score has even shares.
    """
    held = F.coalesce(crc_mod(id_col, folds) == 0, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), held.alias("held_out"), F.col(text_col).cast("binary").alias("t"), F.pmod(F.coalesce(F.xxhash64(id_col), F.lit(0)), F.lit(rounds)).alias("round"))
    learned = rows.where("not held_out")
    counts = cut(count_tokens(learned))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    vocab = vocabulary(counts, n, v)
    weights = np.zeros((slots_of(n), RADIX), np.float32)
    for k in range(rounds if n else 0):
        weights = train_round(learned.where(F.col("round") == k), vocab, weights)
    found = cut(_scored(rows, vocab, weights).withColumn("uid", F.monotonically_increasing_id()))
    others = found.where(F.size("others") > 0).select("uid", F.inline("others"))
    logs = F.log10(F.coalesce("c", F.lit(0)) + 0.1) * F.col("n")
    late = others.join(counts, "word", "left").groupBy("uid").agg(F.sum(logs).alias("logs"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("late_known"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return found.drop("others").join(late, "uid", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + zero("late_known")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + zero("logs")).alias("base_score"), (F.col("score") + zero("logs")).alias("score"),
    )
