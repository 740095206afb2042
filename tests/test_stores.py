"""Known digests of trees of hashes; folders of files; a store fed by a stream."""

import base64

import pytest
from pyspark.sql import functions as F

from cairn.functions.codecs import cache_record, parse_cache_record, parse_data_uri
from cairn.functions.tiger import bitprint_urn, digests, tables, tiger_urn, tree_roots
from cairn.operators import trees
from cairn.sources.files import scan
from cairn.streaming.store import store_stream


def test_tiger():
    assert f"{tables()[0][0]:016x}" == "02aab17cf7e90c5e"
    fox, cog = digests([b"The quick brown fox jumps over the lazy " + x for x in (b"dog", b"cog")])
    assert fox.hex() == "6d12a41e72e644f017b6f0e2f7b44c6285f06dd5d2c5b075"
    assert cog.hex() == "a8f04b0f7201a0d728101c9d26525b31764a3493fcd8458f"


@pytest.mark.parametrize(("text", "root"), [(b"", "LWPNACQDBZRYXW3VHJVCJ64QBZNGHOHHHZWCLNQ"), (b"\0", "VK54ZIEEVTWNAUI5D5RDFIL37LX2IQNSTAXFKSA"), (b"A" * 1024, "L66Q4YVNAFWVS23X2HJIRA5ZJ7WXR3F26RSASFA"), (b"A" * 1025, "PZMRYHGY6LTBEH63ZWAHDORHSYTLO4LEFUIKHWY")])
def test_tree_known(text, root):
    assert base64.b32encode(tree_roots([text])[0]).decode().rstrip("=") == root


def test_tree_by_hand():
    text = bytes(range(256)) * 11
    one = digests([b"\0" + text[i : i + 1024] for i in range(0, len(text), 1024)])
    left = digests([b"\1" + one[0] + one[1]])[0]
    assert tree_roots([b"x", text, b""])[1] == digests([b"\1" + left + one[2]])[0]


def test_tiger_columns(spark):
    got = spark.createDataFrame([("",), (None,), ("é",)], "t string").select(tiger_urn(F.col("t")), bitprint_urn(F.col("t"))).collect()
    assert got[0][0] == "urn:tree:tiger:LWPNACQDBZRYXW3VHJVCJ64QBZNGHOHHHZWCLNQ"
    assert got[1] == (None, None)
    assert len(got[2][1]) == 13 + 32 + 1 + 39


def test_data_uris(spark):
    uris = ["data:,a+b%20c", "data:text/plain,x", "data:text/plain;base64,eA==", "data:a;base64;b,eA==", "http://x/", None]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in uris], "u string").select(parse_data_uri(F.col("u"))).collect()]
    assert [(g.format, bytes(g.content)) if g else None for g in got] == [(None, b"a+b c"), ("text/plain", b"x"), ("text/plain", b"x"), ("b", b"x"), None, None]


def test_cache_records(spark):
    made = cache_record(F.lit(60000), F.lit(1234567890123), F.unhex(F.lit("ab" * 20)))
    got = spark.range(1).select(made.alias("r"), parse_cache_record(made).alias("p"), parse_cache_record(F.lit(b"short")).alias("none")).first()
    assert len(got.r) == 36 and (got.p.size, got.p.mtime_ms, bytes(got.p.digest).hex(), got.none) == (60000, 1234567890123, "ab" * 20, None)


def test_prefixes_and_directories(spark):
    asked = spark.createDataFrame([("a/b/c",), ("a",), ("ab/c",)], "path string")
    heads = spark.createDataFrame([("a",), ("a/b",), ("a/b",)], "head string")
    assert {tuple(r) for r in trees.longest_prefix(asked, heads).collect()} == {("a/b/c", "a/b", "c"), ("a", "a", "")}
    old, new = (spark.createDataFrame(x, "path string, urn string") for x in ([("d/x", "1"), ("e/x", "2")], [("d/y", "3"), ("f", "4")]))
    assert {tuple(r) for r in trees.merge_directories(old, new, "Replace").collect()} == {("d/y", "3"), ("e/x", "2"), ("f", "4")}
    assert {tuple(r) for r in trees.merge_directories(old, new, "Ignore").collect()} == {("d/x", "1"), ("e/x", "2"), ("f", "4")}
    assert trees.changeset_lines(trees.diff(old, new)).count() == 3


def test_scan(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    for name in ("a/one.txt", "a/b/two.o", "three.txt"):
        (tmp_path / name).write_text("Hello, world!")
    got = {r.path: r for r in scan(spark, str(tmp_path), ["*.o"]).collect()}
    assert set(got) == {"a/one.txt", "three.txt"}
    assert got["three.txt"].urn == "urn:sha1:SQ5HALIG6NCZTLXB7DNI56PXFFQDDVUZ" and got["three.txt"].size == 13


def test_stream(spark, tmp_path):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    for texts in (["a", "b", "a", None], ["b", "c", ""]):
        spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("text string").parquet(source)
        store_stream(stream, store, str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(store).collect()
    assert sorted((bytes(r.content), r.size, r.batch) for r in got) == [(b"", 0, 1), (b"a", 1, 0), (b"b", 1, 0), (b"c", 1, 1)]
