"""The pipeline's stages against brute force: what goes and what stays."""

import re

import corpus_pipeline
from cairn.llm import secrets
from cairn.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    start = {r["doc_id"]: r["text"] for r in docs.collect()}

    kept = corpus_pipeline.language(spark, docs, SF)
    assert kept.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert texts == {i: t for i, t in start.items() if any(c.isalpha() for c in t or "")}

    kept = corpus_pipeline.near_copies(spark, kept, SF)
    once = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert kept.columns == docs.columns and len(set(once.values())) == len(once) and set(once) <= set(texts)
    assert {t: min(i for i, x in texts.items() if x == t) for t in once.values()} == {t: i for i, t in once.items()}

    kept = corpus_pipeline.benchmark(spark, kept, SF)
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    grams = lambda w: {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    tests = [grams(words(r["text"])) for r in table(spark, SF, "benchmark").collect()]
    clean = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert set(clean) == {i for i, t in once.items() if not any(len(g & grams(words(t))) >= 0.8 * len(g) for g in tests)}

    kept = corpus_pipeline.mask_secrets(spark, kept, SF)
    masked = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert kept.columns == docs.columns and set(masked) == set(clean)
    assert not any(r["spans"] for r in secrets.secrets(kept).collect() if "[SECRET]" not in masked[r["doc_id"]])

    rated = corpus_pipeline.weights(spark, kept, SF).collect()
    assert {r["doc_id"] for r in rated} <= set(masked) and all(r["rate"] > 0 for r in rated)


def test_run(spark):
    docs = corpus_pipeline.run(spark, SF)
    assert docs.columns == [*table(spark, SF, "documents").columns, "rate"]
    assert 0 < docs.count() < table(spark, SF, "documents").count()
    assert len(corpus_pipeline.STAGES) == 5
