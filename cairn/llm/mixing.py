"""Mixing sources to target weights by soft membership.

A classifier learned from the labelled table gives each document a posterior over
domains. Nonnegative rates of the documents are then fitted by projected gradient
descent, distributed over the documents, on the least squares between the expected
tokens of each domain, sum of rate * tokens * posterior, and its target.
"""

from __future__ import annotations

import logging
import re
from collections import Counter
from functools import reduce
from itertools import islice
from operator import eq, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import cut, sampled

LOG = logging.getLogger(__name__)

#: Labelled rows of each domain that the classifier is fitted on, about, at most.
SAMPLE_ROWS = 2000
#: Words that a document is classified by, at most: those that tell domains apart best.
WORDS = 1000
#: Documents of the sample that a word is in, at least.
LEAST_DOCS = 8
#: What is taken off the ends of words.
MARKS = ".,;:!?\"'()[]{}<>|*_`~"
SIGNS = re.compile(r"[^\w\s]{2}")
SHAPES = 4


def features(text: str | None) -> tuple[int, set[str], list[float]]:
    """Tokens (runs between white space), distinct ones in lower case without marks at their ends, and
    shares of tokens that look unlike prose: in capitals, with runs of signs, repeating the
    last, one sign."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return 0, set(), [0.0] * SHAPES
    counts = Counter(words)
    odd = [(w, c) for w, c in counts.items() if not w.isalnum()]
    capitals = sum(c for w, c in counts.items() if w.isupper() and len(w) > 2)
    signs = sum(c for w, c in odd if SIGNS.search(w))
    bare = sum(c for w, c in odd if len(w) == 1)
    again = sum(map(eq, words, islice(words, 1, None)))
    bag = {w.lower().strip(MARKS) for w in counts}
    bag.discard("")
    return n, bag, [min(1.0, 4 * x / n) for x in (capitals, signs, again, bare)]


def choose_words(counts: list[tuple[str, dict[str, int]]], size: dict[str, int], most: int = WORDS, least_z: float = 4.5) -> list[str]:
    """Words whose share of documents differs most between a domain and the rest, by z-score.
    counts: of each word, its documents by domain; size: documents of each domain."""
    n, best = sum(size.values()), {}
    for w, by in counts:
        c, z = sum(by.values()), 0.0
        for d, m in size.items():
            a, p = by.get(d, 0), (c + 1) / (n + 2)
            if 0 < m < n:
                z = max(z, abs(a / m - (c - a) / (n - m)) / np.sqrt(p * (1 - p) * (1 / m + 1 / (n - m))))
        if z >= least_z:
            best[w] = z
    return sorted(best, key=lambda w: (-best[w], w))[:most]


def fit(samples: list[tuple[str, list[int], list[float]]], words: list[str], prior: dict[str, float], steps: int = 250, rate: float = 0.1, penalty: float = 1e-3) -> dict:
    """Softmax regression over chosen words (samples have their indices) and shapes, by full-batch
    gradient steps; prior: each domain's share of the labelled table, which the balanced
    sample is set back to."""
    labels = [s[0] for s in samples]
    domains = sorted(prior)
    at = {w: i for i, w in enumerate(words)}
    x = np.zeros((len(samples), len(words) + SHAPES + 1), np.float32)
    for row, (_, bag, shape) in zip(x, samples, strict=True):
        row[bag] = 1
        row[len(words) : -1] = shape
        row[-1] = 1
    y = np.array([domains.index(d) for d in labels], np.int64)
    share = np.bincount(y, minlength=len(domains)) / max(1, len(y))
    offset = np.log(np.maximum(share, 1e-9))
    w = np.zeros((x.shape[1], len(domains)), np.float32)
    mean, var = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = x @ w + offset
        e = np.exp(z - z.max(1, keepdims=True))
        p = e / e.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        g = x.T @ p / max(1, len(y)) + penalty * w
        mean += 0.1 * (g - mean)
        var += 0.01 * (g * g - var)
        w -= rate * (mean / (1 - 0.9**t)) / (np.sqrt(var / (1 - 0.99**t)) + 1e-8)
    return {"domains": domains, "at": at, "w": w.astype(np.float64), "log_prior": np.log([max(prior[d], 1e-9) for d in domains])}


def posteriors(model: dict, got: list[tuple[int, set[str], list[float]]]) -> np.ndarray:
    """The domains' posteriors of each text, from its features; one product for all of them."""
    at, w = model["at"], model["w"]
    bags = [[at[v] for v in bag & at.keys()] for _, bag, _ in got]
    ends = np.cumsum([len(b) for b in bags])
    sums = np.concatenate([np.zeros((1, w.shape[1])), np.cumsum(w[np.array([i for b in bags for i in b], np.int64)], 0)])
    z = sums[ends] - sums[ends - [len(b) for b in bags]]
    z += np.array([s for *_, s in got]) @ w[-SHAPES - 1 : -1] + w[-1] + model["log_prior"]
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(docs: DataFrame, labels: DataFrame, domains: list[str], rows: int = SAMPLE_ROWS) -> dict:
    """labels: (doc_id, domain). The classifier, fitted on about `rows` documents of each
    domain at most, by the hash of their ids; labels of other domains, null or absent documents
    are not used. Where a domain has no row, its prior is its smoothed share, zero rows."""
    given = labels.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull()).select("doc_id", "domain").distinct()
    count = dict(map(tuple, given.groupBy("domain").count().collect()))
    prior = {d: (count.get(d, 0) + 1) / (sum(count.values()) + len(domains)) for d in domains}
    pick = None
    for d in domains:
        some = sampled(given.where(F.col("domain") == d), "doc_id", rows, count.get(d, 0))
        pick = some if pick is None else pick.unionByName(some)
    chosen = docs.select("doc_id", "text").join(F.broadcast(pick), "doc_id").select("doc_id", "domain", "text")

    def run(batches):
        for batch in batches:
            got = [features(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([sorted(b) for _, b, _ in got], pa.list_(pa.string())), pa.array([s for *_, s in got], pa.list_(pa.float64()))], ["doc_id", "domain", "bag", "shape"])

    found = cut(chosen.mapInArrow(run, "doc_id long, domain string, bag array<string>, shape array<double>"))
    size = dict(map(tuple, found.groupBy("domain").count().collect()))
    by_word = found.select("domain", F.explode("bag").alias("word")).groupBy("word").agg(*[F.count(F.when(F.col("domain") == d, 1)).alias(f"n{i}") for i, d in enumerate(domains)])
    often = by_word.where(sum((F.col(f"n{i}") for i in range(1, len(domains))), F.col("n0")) >= LEAST_DOCS)
    words = choose_words([(r[0], dict(zip(domains, r[1:], strict=True))) for r in often.collect()], {d: size.get(d, 0) for d in domains})
    sent = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})

    def indices(batches):
        for batch in batches:
            at = [[sent.value[w] for w in bag if w in sent.value] for bag in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.list_(pa.int64())), batch.column(3)], ["doc_id", "domain", "at", "shape"])

    rows = found.mapInArrow(indices, "doc_id long, domain string, at array<long>, shape array<double>").collect()
    return fit([(r[1], r[2], r[3]) for r in sorted(rows, key=lambda r: (r[0], r[1], r[3]))], words, prior)


def memberships(docs: DataFrame, model: dict, key: Column | None = None) -> DataFrame:
    """(doc_id, n_tokens, p): p[i], the posterior of the model's i-th domain; _text: key, if given, a long."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "n_tokens", "p"] + ["_text"] * (key is not None)

    def run(batches):
        model = sent.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                got = [features(t) for t in part.column(1).to_pylist()]
                p = posteriors(model, got)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1]), pa.int32()), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, *_ in got], pa.int64()), flat, *part.columns[2:]], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *([] if key is None else [key.alias("_text")]))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, p array<double>" + (", _text long" if key is not None else ""))


def _rate(steps: list[np.ndarray], least: float = 0.0) -> Column:
    """Every document starts at 1, and each step moves it and projects it on what is not under least."""
    if not steps:
        return F.lit(1.0)
    one = lambda r, g: F.greatest(F.lit(float(least)), r - F.aggregate(F.zip_with(g, F.col("p"), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))
    return F.aggregate(F.array(*[F.array(*map(F.lit, map(float, g))) for g in steps]), F.lit(1.0), one)


def solve_rates(members: DataFrame, domains: list[str], targets: dict[str, float], total: float | None = None, most_steps: int = 100, tolerance: float = 1e-3, least: float = 0.0) -> tuple[DataFrame, dict]:
    """(members with rate, report): rates of at least `least`, by projected gradient.

    Each step is the gradient of the squared errors, scaled by the inverse of the damped
    matrix of second derivatives over the documents above their bound. A step after which the
    objective is larger is taken back and damped more. Ends where every domain is within
    tolerance * total of its goal (met), or where, with the targets out of reach, a plain
    projected gradient step would move less than tolerance / 10 of the tokens (stationary);
    else after most_steps passes.

    report: reached and goal by domain, residual (the largest error as a share of total), met,
    stationary, steps.
    """
    n = len(domains)
    docs = members.select(F.col("n_tokens").cast("double").alias("t"), "p")

    def measure(steps: list[np.ndarray], plain: np.ndarray):
        """Tokens; expected ones by domain, after all steps; sums of t * p * p over the documents
        that are then free; tokens that the step plain, put for the last, moves."""

        def run(batches):
            got = np.zeros(2 + n + n * n)
            for batch in batches:
                t, p = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
                r = before = np.ones(len(t))
                for g in steps:
                    before, r = r, np.maximum(least, r - p @ g)
                free = np.where(r > least, t, 0.0)
                moved = t @ np.abs(np.maximum(least, before - p @ plain) - before)
                got += np.concatenate([[t.sum(), moved], (r * t) @ p, ((p * free[:, None]).T @ p).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([got.tolist()], pa.list_(pa.float64()))], ["sums"])

        got = np.sum([np.zeros(2 + n + n * n), *(np.array(r[0]) for r in docs.mapInArrow(run, "sums array<double>").collect())], 0)
        return got[0], got[1], got[2 : 2 + n], got[2 + n :].reshape(n, n)

    tokens, _, reached, h = measure([], np.zeros(n))
    goal = np.array([targets[d] for d in domains], float)
    total = float(total if total is not None else tokens)
    goal = goal / goal.sum() * total
    steps: list[np.ndarray] = []
    met = stationary = not tokens
    if tokens:
        curve = np.maximum(np.diag(h), 1e-9 * tokens)  # of each domain's squared error
        value = lambda e: float((e * e / curve).sum())
        damp, passes = 0.01, 1
        while True:
            error = reached - goal
            met = bool(np.abs(error).max() <= tolerance * total)
            if met or stationary or passes >= most_steps:
                break
            step = np.linalg.solve(h + damp * np.diag(curve), error)
            _, moved, then, h_then = measure([*steps, step], 0.7 * error / curve)
            passes += 1
            if moved <= 0.1 * tolerance * tokens:
                stationary = True
            elif value(then - goal) > value(error) and damp < 1e6:
                damp *= 10
            else:
                steps.append(step)
                reached, h, damp = then, h_then, max(damp / 4, 1e-6)
    residual = float(np.abs(reached - goal).max() / total) if total else 0.0
    by = lambda x: dict(zip(domains, x.tolist(), strict=True))
    report = {"reached": by(reached), "goal": by(goal), "residual": residual, "met": met, "stationary": stationary, "steps": len(steps)}
    (LOG.info if met else LOG.warning)("rates: targets %s, residual %.4f of all tokens, %d steps%s", "met" if met else "not met", residual, len(steps), "" if met or stationary else ", not settled")
    return members.withColumn("rate", _rate(steps, least)), report


def fit_rates(members: DataFrame, domains: list[str], targets: dict[str, float], total: float | None = None, **how) -> tuple[DataFrame, dict[str, float]]:
    """(members with rate, expected tokens by domain). targets: weights of the domains, scaled
    to sum to 1; total: tokens to reach, by default as many as there are; how: see solve_rates."""
    rated, report = solve_rates(members, domains, targets, total, **how)
    return rated, report["reached"]


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], total: float | None = None) -> DataFrame:
    """(doc_id, n_tokens, p, rate), one row per row of docs; p in order of the domains' names.

    docs: doc_id, text; labels: doc_id, domain; other columns are not read. Null and empty
    texts have no tokens, posteriors by the priors, and any rate: they change no total.
    Null ids and repeated rows are rated each. Without labels all posteriors are the
    smoothed priors. Empty docs: no rows.
    """
    domains = sorted(targets)
    members = cut(memberships(docs, train(docs, labels, domains)))
    return fit_rates(members, domains, targets, total)[0]


#: Production weights of the corpus's expected tokens.
TARGETS = {"good": 0.9, "low": 0.1, "toxic": 0.0}


def domain_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labels table: toxic, else by quality."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "good").alias("domain"))


#: The pipeline's decision on a document, apart from its rate: posterior of a domain from which on it goes.
WORST = {"toxic": 0.5}
#: Least rate of a document that stays; the fit counts it in, so that what is put out holds the tokens that were fitted.
LEAST = 1e-3


def keep_rated(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, worst: dict[str, float] | None = None, least: float = LEAST) -> DataFrame:
    """docs with a column rate, without the documents whose posterior of a domain in worst reaches
    its limit. Rates are fitted over those that stay and remove none. Rows of one id and one
    text share a rate; others have their own, rows without an id too."""
    targets, worst = targets or TARGETS, WORST if worst is None else worst
    domains = sorted(targets)
    key = F.xxhash64(F.col("text")).alias("_text")
    members = cut(memberships(docs, train(docs, labels, domains), key))
    bad = [F.element_at("p", domains.index(d) + 1) >= x for d, x in worst.items() if d in domains]
    stay = members.where(~reduce(or_, bad, F.lit(False)))
    rated = solve_rates(stay, domains, targets, least=least)[0]
    rated = rated.groupBy(F.col("doc_id").alias("_id"), "_text").agg(F.min("rate").alias("rate"))
    rows = docs.drop("rate").select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_row_id"), key.alias("_row_text"))  # so that no name clashes
    both = rows.join(rated, F.col("_row_id").eqNullSafe(F.col("_id")) & (F.col("_row_text") == F.col("_text")))
    return both.select("row.*", "rate")
