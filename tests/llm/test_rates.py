"""Rates reach their targets or the best there is, and no rate removes a document."""

import numpy as np

from cairn.llm import mixing
from pyspark.sql import functions as F


def members(spark, sharp, n=2000, seed=3):
    rng = np.random.default_rng(seed)
    z = sharp * np.eye(3)[rng.choice(3, n, p=[0.5, 0.4, 0.1])] + rng.normal(size=(n, 3))
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    t = rng.integers(20, 400, n)
    return spark.createDataFrame([(i, int(a), b.tolist()) for i, (a, b) in enumerate(zip(t, p, strict=True))], "doc_id long, n_tokens long, p array<double>"), p, t


def test_targets_met(spark):
    """Soft posteriors, targets in reach: within a thousandth of all tokens, not within percents."""
    goal = {"a": 0.6, "b": 0.33, "c": 0.07}
    rows, p, t = members(spark, 1.5)
    rated, reached = mixing.fit_rates(rows, list("abc"), goal)
    r = np.array([x["rate"] for x in rated.orderBy("doc_id").collect()])
    assert (r >= 0).all() and np.allclose((r * t) @ p, list(reached.values()))
    assert np.abs((r * t) @ p / t.sum() - list(goal.values())).max() <= 1e-3


def test_out_of_reach(spark):
    """No rates give a share of nothing to a domain of soft posteriors: the optimum is reported as one."""
    goal = np.array([0.9, 0.1, 0.0])
    rows, p, t = members(spark, 1.0)
    rated, report = mixing.solve_rates(rows, list("abc"), dict(zip("abc", goal, strict=True)))
    assert report["met"] or report["stationary"]
    r = np.array([x["rate"] for x in rated.orderBy("doc_id").collect()])
    curve = (t[:, None] * p * p).sum(0)
    value = lambda r: ((((r * t) @ p - goal * t.sum()) ** 2) / curve).sum()
    step = lambda r: np.maximum(0, r - 0.7 * p @ (((r * t) @ p - goal * t.sum()) / curve))
    x = np.ones(len(t))
    for _ in range(40):  # where the fit stopped before
        x = step(x)
    assert value(r) < 0.2 * value(x)
    assert np.abs((r * t) @ p / t.sum() - goal).max() <= report["residual"] + 1e-9
    assert report["met"] or (np.abs(step(r) - r) * t).sum() <= 1e-4 * t.sum()


def test_only_toxic_goes(spark):
    """Clean documents stay whatever their rate, and what stays holds the tokens that were fitted."""
    rng = np.random.default_rng(5)
    words = {"good": ["alpha", "beta", "gamma"], "low": ["spam", "deal", "offer"], "toxic": ["vile", "hate", "slur"]}
    kinds = ["good"] * 100 + ["low"] * 200 + ["toxic"] * 60
    rows = [(i, " ".join(rng.choice(words[k], 30)), k) for i, k in enumerate(kinds)]
    rows += [(0, "spam deal offer " * 10, "low"), (None, "vile hate slur " * 10, "toxic")]
    docs = spark.createDataFrame([(i, x) for i, x, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k) for i, _, k in rows[:360]], "doc_id long, domain string")
    got = mixing.keep_rated(docs, labels)
    kept = sorted((r["doc_id"], r["text"]) for r in got.collect())
    assert kept == sorted((i, x) for i, x, k in rows if k != "toxic")
    assert got.where(F.col("rate") < 0.3).count() >= 200  # the low ones stay, at low rates
    assert got.where("rate <= 0").count() == 0
