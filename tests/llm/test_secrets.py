"""The randomness tests on truly random tokens, and what the scan does with them."""

import numpy as np
from pyspark.sql import functions as F

from cairn.llm import secrets


def tokens(code, n, size, rng):
    return ["".join(rng.choice(list(secrets.ALPHABETS[code]), size)) for _ in range(n)]


def test_random_tokens_pass(spark):
    """Of random tokens of 20 to 4,000 characters, about one in a hundred at most fails any one test."""
    rng = np.random.default_rng(3)
    rows = [(code, size, t) for code in secrets.ALPHABETS for size, n in ((20, 150), (100, 150), (800, 60), (4000, 25)) for t in tokens(code, n, size, rng)]
    df = spark.createDataFrame(rows, "code string, size int, t string")
    scores = secrets.battery(F.col("t"), F.col("code"))[:3]
    failed = df.select("code", "size", *[(F.abs(x) > secrets.REJECT).cast("int").alias(n) for x, n in zip(scores, "abc", strict=True)]).groupBy("code").agg(F.count("*"), F.sum("a"), F.sum("b"), F.sum("c")).collect()
    for code, n, *bad in failed:
        assert max(bad) <= 0.01 * n + 2, (code, n, bad)


def test_encodings_inferred(spark):
    rng = np.random.default_rng(4)
    rows = [(code, t) for code in secrets.ALPHABETS for t in tokens(code, 50, 64, rng)]
    got = spark.createDataFrame(rows, "code string, t string").select("code", secrets.encoding(F.col("t")).alias("e")).where("NOT code <=> e").count()
    assert got <= 0.02 * len(rows) + 3 * 50  # a short base64 text may have none of the two signs
    plain = [("4" * 24,), ("internationalization" * 2,), ("some-long-name-with-dashes-2",), ("SRC/main/Java_2-x/y+z",)]
    assert [r[0] for r in spark.createDataFrame(plain, "t string").select(secrets.encoding(F.col("t"))).collect()] == [None] * 4
    uuid = spark.createDataFrame([("0b3e6f1c-9a4d-4e7f-8c21-5d7a90b1e2f3",)], "t string").select(secrets.encoding(secrets.bare(F.col("t")))).first()[0]
    assert uuid == "hex"


def test_keys_in_text_are_found(spark):
    """Long random keys of every encoding in ordinary text, and none of the text's own words."""
    rng = np.random.default_rng(5)
    words = "the quick brown fox jumps over lazy dogs while internationalization committees deliberate".split()
    rows, where = [], {}
    for i, (code, t) in enumerate((c, t) for c in ("base36l", "base62", "base64", "base64url", "base32l") for t in tokens(c, 20, 48, rng)):
        before = " ".join(rng.choice(words, 12)) + " "
        rows.append((i, before + t + " " + " ".join(rng.choice(words, 9))))
        where[i] = (len(before), len(before) + len(t))
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in secrets.secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(where[i] in got[i] for i in where) >= 0.9 * len(where)
    assert all(s[0] >= where[i][0] and s[1] <= where[i][1] for i in where for s in got[i])


def test_rest_of_a_key_goes_too(spark):
    """A base span inside a longer random key does not keep the rest of the key in the text."""
    rng = np.random.default_rng(6)
    rows = [(i, f"see {a}{'0123456789abcdef' * 2}{b} here") for i, (a, b) in enumerate(zip(tokens("base62", 40, 30, rng), tokens("base62", 40, 30, rng), strict=True))]
    rows += [(100 + i, f"see {t} here") for i, t in enumerate(tokens("base62", 200, 96, rng))]
    got = {r["doc_id"]: r["text"] for r in secrets.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(t == "see [SECRET] here" for i, t in got.items() if i >= 100) >= 180
    assert all("0123456789abcdef0123" not in t for t in got.values())
