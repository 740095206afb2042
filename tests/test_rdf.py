"""Documents byte for byte, and addresses of directories over any depth."""

import base64
import hashlib

from pyspark.sql import functions as F

from cairn.functions import rdf
from cairn.operators import changes, merkle

NS = "http://example.org/content/"
RDF = 'xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"'
BZ, DC = 'xmlns:bz="http://bitzi.com/xmlns/2002/01/bz-core#"', 'xmlns:dc="http://purl.org/dc/terms/"'
BLOB = "urn:sha1:3CL2HWDOYOLPUXLWTKY6PAP63D7VOYZO"


def entry(spark, *values):
    df = spark.createDataFrame([values], "name string, is_dir boolean, target string, size long, at string")
    e = F.struct("name", "is_dir", "target", "size", F.to_timestamp("at").alias("modified"))
    return df.select(rdf.entry_xml(e)).first()[0]


def test_entries(spark):
    plain = f'<DirectoryEntry xmlns="{NS}" {RDF}>\n\t<name>foo</name>\n\t<target>\n\t\t<Blob rdf:about="{BLOB}"/>\n\t</target>\n</DirectoryEntry>\n'
    assert entry(spark, "foo", False, BLOB, None, None) == plain
    sized = f'<DirectoryEntry xmlns="{NS}" {BZ} {DC} {RDF}>\n\t<name>foo</name>\n\t<target>\n\t\t<Blob rdf:about="{BLOB}">\n\t\t\t<bz:fileLength>1234</bz:fileLength>\n\t\t</Blob>\n\t</target>\n\t<dc:modified>2010-01-01 06:00:32 GMT</dc:modified>\n</DirectoryEntry>\n'
    assert entry(spark, "foo", False, BLOB, 1234, "2010-01-01 06:00:32") == sized
    above = f'<DirectoryEntry xmlns="{NS}" {RDF}>\n\t<name>a &amp; b</name>\n\t<target>\n\t\t<Directory rdf:about="x-rdf-subject:{BLOB}"/>\n\t</target>\n</DirectoryEntry>\n'
    assert entry(spark, "a & b", True, f"x-rdf-subject:{BLOB}", None, "2010-01-01 06:00:32") == above


def test_commit(spark):
    df = spark.createDataFrame([("t:1", ["p:2", None, "p:1"], "2020-02-03 04:05:06", "me", "a < b")], "t string, p array<string>, at string, who string, m string")
    got = df.select(rdf.commit_xml(F.col("t"), F.col("p"), F.to_timestamp("at"), F.col("who"), F.col("m"))).first()[0]
    assert got == f'<Commit xmlns="{NS}" {DC} {RDF}>\n\t<parent rdf:resource="p:1"/>\n\t<parent rdf:resource="p:2"/>\n\t<target rdf:resource="t:1"/>\n\t<dc:created>2020-02-03 04:05:06 GMT</dc:created>\n\t<dc:creator>me</dc:creator>\n\t<dc:description>a &lt; b</dc:description>\n</Commit>\n'


def test_ids_of_a_deep_tree(spark):
    files = {"a/b/c/d/x": "urn:1", "a/b/y": "urn:2", "z": "urn:3"}
    tree = changes.entries(spark.createDataFrame([*files.items()], "path string, urn string"), spark.createDataFrame([("a/empty",)], "path string"))

    def plain(at):
        names = sorted({p[len(at) :].split("/")[0] for p in [*files, "a/empty/"] if p.startswith(at) and p != at})
        if not [n for n in names if n]:
            return f'<Directory xmlns="{NS}" {RDF}>\n\t<entries rdf:parseType="Collection"/>\n</Directory>\n'
        body = ""
        for n in names:
            kind, target = ("Blob", files[at + n]) if at + n in files else ("Directory", address(plain(at + n + "/")))
            body += f'\t\t<DirectoryEntry>\n\t\t\t<name>{n}</name>\n\t\t\t<target>\n\t\t\t\t<{kind} rdf:about="{target}"/>\n\t\t\t</target>\n\t\t</DirectoryEntry>\n'
        return f'<Directory xmlns="{NS}" {RDF}>\n\t<entries rdf:parseType="Collection">\n{body}\t</entries>\n</Directory>\n'

    def address(xml):
        return "x-rdf-subject:urn:sha1:" + base64.b32encode(hashlib.sha1(xml.encode()).digest()).decode()

    got = {r["path"]: (r["id"], r["xml"]) for r in merkle.directory_ids(tree).collect()}
    want = {p: plain(p + "/" if p else "") for p in ("", "a", "a/b", "a/b/c", "a/b/c/d", "a/empty")}
    assert got == {p: (address(x), x) for p, x in want.items()}
    back = spark.createDataFrame([(want["a"],), ("<p>",)], "xml string").select(rdf.parse_directory(F.col("xml"))).collect()
    assert [tuple(e) for e in back[0][0]] == [("b", True, address(want["a/b"]), None), ("empty", True, address(want["a/empty"]), None)] and back[1][0] is None


def test_rollup(spark):
    rows = [("a/b/x", 1, True), ("a/y", 5, True), ("c/z", 3, False), ("w", 9, None)]
    got = {r["path"]: tuple(r)[1:] for r in merkle.rollup(spark.createDataFrame(rows, "path string, modified long, stored boolean")).collect()}
    assert got == {"a/b": (1, True, 1), "a": (5, True, 2), "c": (3, False, 1), "": (9, False, 4)}
