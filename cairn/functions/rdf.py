"""Directories and commits as RDF in XML, byte for byte as content addresses need it.

Properties are in order of their full names, repeated ones by value; one tab for each level.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions.codecs import xml_escape
from cairn.functions.formats import xml_unescape

#: Public namespaces, by prefix.
BZ, DC, RDF = "http://bitzi.com/xmlns/2002/01/bz-core#", "http://purl.org/dc/terms/", "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
#: Namespace of directories and commits; readers and writers of one store share it.
NAMESPACE = "http://example.org/content/"
SUBJECT = "x-rdf-subject:"
ENTRY = "name string, is_dir boolean, target string, size bigint, modified timestamp"


def _text(value: Column) -> Column:
    return F.replace(F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _when(value: Column, *parts: Column) -> Column:
    """The parts together, or nothing where value is null."""
    return F.when(value.isNull(), "").otherwise(F.concat(*parts))


def _date(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss 'GMT'")


def _entry_body(e: Column, pad: str) -> Column:
    kind = F.when(e["is_dir"], "Directory").otherwise("Blob")
    about = F.concat(F.lit(f"{pad}\t<"), kind, F.lit(' rdf:about="'), xml_escape(e["target"]), F.lit('"'))
    target = F.when(e["size"].isNull(), F.concat(about, F.lit("/>\n"))).otherwise(F.concat(about, F.lit(f">\n{pad}\t\t<bz:fileLength>"), e["size"].cast("string"), F.lit(f"</bz:fileLength>\n{pad}\t</"), kind, F.lit(">\n")))
    modified = F.when(~e["is_dir"], e["modified"])
    return F.concat(F.lit(f"{pad}<name>"), _text(e["name"]), F.lit(f"</name>\n{pad}<target>\n"), target, F.lit(f"{pad}</target>\n"), _when(modified, F.lit(f"{pad}<dc:modified>"), _date(modified), F.lit("</dc:modified>\n")))


def _namespaces(namespace: str, sized: Column, dated: Column) -> Column:
    return F.concat(F.lit(f' xmlns="{namespace}"'), F.when(sized, f' xmlns:bz="{BZ}"').otherwise(""), F.when(dated, f' xmlns:dc="{DC}"').otherwise(""), F.lit(f' xmlns:rdf="{RDF}"'))


def entry_xml(e: Column, namespace: str = NAMESPACE) -> Column:
    """A document of one entry (see ENTRY; size and modified may be null)."""
    return F.concat(F.lit("<DirectoryEntry"), _namespaces(namespace, e["size"].isNotNull(), ~e["is_dir"] & e["modified"].isNotNull()), F.lit(">\n"), _entry_body(e, "\t"), F.lit("</DirectoryEntry>\n"))


def directory_xml(entries: Column, namespace: str = NAMESPACE) -> Column:
    """A document of a directory's entries, an array of ENTRY in any order."""
    each = F.transform(F.array_sort(entries), lambda e: F.concat(F.lit("\t\t<DirectoryEntry>\n"), _entry_body(e, "\t\t\t"), F.lit("\t\t</DirectoryEntry>\n")))
    body = F.when(F.size(entries) == 0, '\t<entries rdf:parseType="Collection"/>\n').otherwise(F.concat(F.lit('\t<entries rdf:parseType="Collection">\n'), F.array_join(each, ""), F.lit("\t</entries>\n")))
    names = _namespaces(namespace, F.exists(entries, lambda e: e["size"].isNotNull()), F.exists(entries, lambda e: ~e["is_dir"] & e["modified"].isNotNull()))
    return F.concat(F.lit("<Directory"), names, F.lit(">\n"), body, F.lit("</Directory>\n"))


def commit_xml(target: Column, parents: Column, created: Column, author: Column, message: Column, target_is_dir: Column | None = None, namespace: str = NAMESPACE) -> Column:
    """A document of a commit; parents is an array of addresses, and of the others each may be null."""
    ref = lambda name, uri: F.concat(F.lit(f'\t<{name} rdf:resource="'), xml_escape(uri), F.lit('"/>\n'))
    dated = created.isNotNull() | author.isNotNull() | message.isNotNull()
    lines = F.array_join(F.transform(F.array_sort(F.array_compact(parents)), lambda p: ref("parent", p)), "")
    literal = lambda name, value: _when(value, F.lit(f"\t<dc:{name}>"), _text(value), F.lit(f"</dc:{name}>\n"))
    return F.concat(
        F.lit("<Commit"), _namespaces(namespace, F.lit(False), dated), F.lit(">\n"), lines, _when(target, ref("target", target)),
        literal("created", _date(created)), literal("creator", author), literal("description", message), F.lit("</Commit>\n"),
    )


def parse_directory(xml: Column) -> Column:
    """array<struct<name, is_dir, target, size>> of a directory's document, in its order: the new style, with the
    target's kind as its element. Null for other documents."""
    parts = F.regexp_extract_all(xml, F.lit(r"(?s)<DirectoryEntry>(.*?)</DirectoryEntry>"), F.lit(1))
    get = lambda p, pattern: F.regexp_extract(p, pattern, 1)
    size = lambda p: get(p, r"<bz:fileLength>\s*([0-9]+)\s*</bz:fileLength>")
    one = lambda p: F.struct(
        xml_unescape(get(p, r"(?s)<name>(.*?)</name>")).alias("name"), (get(p, r"<(Directory|Blob)\b") == "Directory").alias("is_dir"),
        xml_unescape(get(p, r'rdf:(?:about|resource)="([^"]*)"')).alias("target"), F.when(size(p) != "", size(p).cast("bigint")).alias("size"),
    )
    return F.when(xml.rlike(r"^\s*<Directory[\s>]"), F.transform(parts, one))
