"""Known answers: addresses, comparisons, orders, rules, changes and graphs."""

import pytest
from pyspark.sql import functions as F

from cairn.functions.codecs import percent_decode, percent_encode
from cairn.functions.ordering import natural_key
from cairn.functions.urn import equivalent, sha1_urn
from cairn.functions.values import append_path, boolean, delta_ms, from_cp437, repo_ref, rs_hash, strip_subject, thumbnail_name
from cairn.operators import commits, trees


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(("text", "urn"), [("Hallo, werlde!", "JMFVQGKCBX3GASAMGGUFPLIUVRWEFDBK"), ("Hello, world!", "SQ5HALIG6NCZTLXB7DNI56PXFFQDDVUZ")])
def test_sha1_urn(spark, text, urn):
    assert one(spark, sha1_urn(F.lit(text))) == f"urn:sha1:{urn}"


A, B, C, D = "A" * 32, "B" * 32, "C" * 39, "D" * 39


@pytest.mark.parametrize(("a", "b", "same"), [
    (f"urn:sha1:{A}", f"urn:sha1:{A}", True), (f"urn:sha1:{A}", f"urn:sha1:{B}", False), (f"urn:bitprint:{A}.{C}", f"urn:bitprint:{A}.{C}", True),
    (f"urn:bitprint:{A}.{C}", f"urn:bitprint:{A}.{D}", False), (f"urn:bitprint:{A}.{C}", f"urn:sha1:{A}", True), (f"urn:bitprint:{A}.{C}", f"urn:tree:tiger:{D}", False),
    (f"urn:sha1:{A}", f"urn:tree:tiger:{C}", None), ("http://a/", "http://a/", None), (f"x-rdf-subject:urn:sha1:{A}", f"urn:sha1:{A}", None),
    (f"x-rdf-subject:urn:sha1:{A}", f"x-rdf-subject:urn:sha1:{A}", True),
])
def test_equivalent(spark, a, b, same):
    assert one(spark, equivalent(F.lit(a), F.lit(b))) is same


def test_percent(spark):
    assert one(spark, percent_encode(F.lit("ABC + 123"))) == "ABC%20%2B%20123"
    for text in ("a~b*c-d._é%", ""):
        assert one(spark, percent_decode(percent_encode(F.lit(text)))) == text


def test_natural_order(spark):
    names = ["a10", "a2", "a02b", "b1", "a", "a1b10", "a1b9"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(natural_key(F.col("n")), "n").collect()]
    assert got == ["a", "a1b9", "a1b10", "a2", "a02b", "a10", "b1"]


def test_ignore_rules(spark):
    df = spark.createDataFrame([("a/x.o",), ("a/keep.o",), (".git",), ("build/a",), ("src/build/a",), ("a/b/c/d",)], "p string")
    rules = ["*.o", "!keep.o", "/build/**", "a/**/d"]
    got = {r[0]: r[1] for r in df.select("p", trees.ignored(F.col("p"), rules)).collect()}
    assert got == {"a/x.o": True, "a/keep.o": False, ".git": True, "build/a": True, "src/build/a": False, "a/b/c/d": True}


def test_diff_and_apply(spark):
    old = spark.createDataFrame([("bloba", "A"), ("blobb", "B"), ("s/c", "C")], "path string, urn string")
    new = spark.createDataFrame([("bloba", "A"), ("blobb", "C"), ("t/c", "C")], "path string, urn string")
    ops = trees.diff(old, new)
    assert sorted(map(tuple, ops.collect())) == [("blobb", "A"), ("blobb", "D"), ("s/c", "D"), ("t/c", "A")]
    assert sorted(map(tuple, trees.apply_changes(old, ops, new).collect())) == sorted(map(tuple, new.collect()))


def test_commit_graph(spark):
    edges = spark.createDataFrame([("B", "A"), ("C", "A"), ("D", "B"), ("E", "B"), ("F", "D"), ("F", "E")], "child string, parent string")
    pairs = spark.createDataFrame([("C", "F"), ("D", "E"), ("E", "F")], "a string, b string")
    assert sorted(map(tuple, commits.common_ancestor(edges, pairs, 5).collect())) == [("C", "F", "A"), ("D", "E", "B"), ("E", "F", "E")]
    edges = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 2), (5, 1), (5, 2), (6, 3), (6, 4)], "child long, parent long")
    heads = spark.createDataFrame([(i,) for i in range(7)], "node long")
    for depth, left in ((0, set(range(7))), (1, {5, 6}), (10, {5, 6})):
        assert {r[0] for r in commits.filter_ancestors(edges, heads, depth).collect()} == left
    some = heads.where("node not in (3, 5)")
    assert {r[0] for r in commits.filter_ancestors(edges, some, 1).collect()} == {1, 6}


@pytest.mark.parametrize(("base", "path", "drop", "joined"), [
    ("foo/", "bar/", True, "foo/bar/"), ("foo/", "/bar", True, "/bar"), ("foo/", "E:/junk", True, "E:/junk"), ("foo/baz/", "../bar", True, "foo/bar"),
    ("http://www.example.net/music/", "../style/", True, "http://www.example.net/style/"), ("http://www.example.net/music/whatever", "/", True, "http://www.example.net/"),
    ("foo", "bar/", False, "foo/bar/"), ("foo", "bar", True, "bar"), ("a/b/c/", "../../d", True, "a/d"), ("http://h/a?q=/x#y", "b", True, "http://h/b"), ("a/", "../../b", True, "a/../../b"), ("a/b/", "gone/./../next", True, "a/b/next"),
    ("http://h/a/b", "../../../c", True, "http://h/../../c"), ("/" .join("abcdefghijklmnop") + "/", "../" * 15 + "z", True, "a/z"), ("a\\b\\", "c", True, "a/b/c"), ("", "x", True, "x"), ("x", "", True, "x"),
])
def test_append_path(spark, base, path, drop, joined):
    assert one(spark, append_path(F.lit(base), F.lit(path), drop)) == joined


@pytest.mark.parametrize(("uri", "head", "expected"), [
    ("x-any-repo://xyz/123/aba", False, ("xyz", "123/aba")), ("x-any-head://xyz/123/aba", False, ("xyz", "heads/123/aba")), ("//xyz/123/aba", True, ("xyz", "heads/123/aba")),
    ("x-any-repo://xyz/1", True, ("xyz", "1")), ("123/aba", True, (None, "heads/123/aba")), ("/123/aba", False, (None, "123/aba")), ("//xyz", False, ("xyz", "")),
])
def test_repo_ref(spark, uri, head, expected):
    assert tuple(one(spark, repo_ref(F.lit(uri), head))) == expected


@pytest.mark.parametrize(("text", "truth"), [("YES", True), ("nein", False), ("0", False), ("-2.5", True), ("1e3", True), ("perhaps", None), ("", None)])
def test_boolean(spark, text, truth):
    assert one(spark, boolean(F.lit(text))) is truth


@pytest.mark.parametrize(("text", "ms"), [("+3days", 259_200_000), ("-2", -2000), ("+1years", 31_556_952_000), ("-1months", -2_628_002_880), ("3days", None), ("+1fortnights", None)])
def test_delta(spark, text, ms):
    assert one(spark, delta_ms(F.lit(text))) == ms


@pytest.mark.parametrize("key", [b"", b"a", b"index key", bytes(range(256))])
def test_rs_hash(spark, key):
    h, a = 0, 63689
    for c in key:
        h, a = h * a + (c - 256 if c > 127 else c), a * 378551
    assert one(spark, rs_hash(F.lit(key))) == h & 0x7FFFFFFF


def test_names(spark):
    assert [one(spark, thumbnail_name(F.lit(n), 128, 96)) for n in ("a.b.jpg", "a", ".x")] == ["a.b-128x96.jpg", "a-128x96", "-128x96.x"]
    assert [one(spark, strip_subject(F.lit(u))) for u in ("x-parse-rdf:a:b", "x-rdf-subject:a", "a")] == ["a:b", "a", None]
    assert one(spark, from_cp437(F.lit(bytes(range(256))))) == bytes(range(256)).decode("cp437")
