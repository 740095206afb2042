"""Paths, namespaces and caches on small made cases."""

from cairn.operators import caches, namespaces, paths


def test_follow(spark):
    entries = spark.createDataFrame([("d", "sub", "e"), ("e", "x", "blob"), ("f", None, None), ("d", "old", "c1"), ("d", "twice", "b"), ("d", "twice", "a")], "directory string, name string, target string")
    commits = spark.createDataFrame([("c1", "d"), ("c2", "c1")], "commit string, target string")
    cases = [
        ("d", "sub/x", "found", "blob", None), ("d", "sub//x///", "found", "blob", None), ("d", "/", "found", "d", None), ("d", "sub/y", "missing", "e", "y"), ("f", "any", "missing", "f", "any"), ("d", "/sub", "missing", "d", ""),
        ("c2", "target/target/sub", "found", "e", None), ("c1", "parent", "not applicable", "c1", "parent"), ("d", "sub/x/more", "not applicable", "blob", "more"), ("d", "old/target/old", "found", "c1", None), ("d", "twice", "found", "a", None),
        (None, "x", "no argument", None, None), ("d", None, "no argument", "d", None),
    ]
    asked = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "id long, source string, path string")
    got = {r["id"]: (r["outcome"], r["at"], r["name"]) for r in paths.follow(asked, entries, commits).collect()}
    assert got == {i: c[2:] for i, c in enumerate(cases)}
    assert paths.follow(asked.limit(0), entries, commits).count() == 0


def test_namespaces(spark):
    names = [("http://a/b#c", "k:c"), ("http://a/x/y", "a0:y"), ("http://a/z", "a1:z"), ("http://a/x/w", "a0:w"), ("plain", None), ("http://a/b#", None), ("v:here", "here"), (None, None), ("#top", None)]
    df = spark.createDataFrame([(1, i, n) for i, (n, _) in enumerate(names)] + [(2, 0, "http://a/z")], "doc long, pos long, name string")
    short = namespaces.shorten(df, {"k": "http://a/b#", "": "v:"})
    got = {(r["doc"], r["pos"]): r["short"] for r in short.collect()}
    assert got == {(1, i): s for i, (_, s) in enumerate(names)} | {(2, 0): "a0:z"}
    back = namespaces.expand(short.select("doc", "pos", "short"), short.select("doc", "prefix", "namespace"))
    assert {(r["doc"], r["pos"]): r["name"] for r in back.collect()} == {(1, i): n if s else None for i, (n, s) in enumerate(names)} | {(2, 0): "http://a/z"}


def test_caches(spark):
    from pyspark.sql import functions as F

    puts = spark.createDataFrame([("k", "one", None, 1), ("k", None, "urn:x", 2), ("t", "", None, 1), (None, "no", None, 1)], "key string, value string, uri string, at int")
    got = {r["key"]: (r["value"], r["uri"]) for r in caches.results(puts.withColumn("stored", caches.stored_result(F.col("value"), F.col("uri"))), "at").collect()}
    assert got == {"k": (None, "urn:x"), "t": ("", None)}
    empty = "urn:sha1:3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"  # of no bytes
    rows = [(1, empty, ""), (2, empty, "x"), (3, "urn:other", ""), (4, None, "")]
    fetched = spark.createDataFrame(rows, "id long, urn string, content string")
    for stored, first in (([], ("cached", empty)), ([(empty,), (empty,)], ("present", None))):
        got = {r["id"]: (r["outcome"], r["stored_urn"]) for r in caches.cached(fetched, spark.createDataFrame(stored, "sha1_urn string")).collect()}
        assert got == {1: first, 2: ("mismatch", None), 3: ("unverifiable", None), 4: ("unverifiable", None)}
