"""Content addresses: made, taken apart, compared."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions.codecs import base32_of_hex

#: What names the RDF subject of a document, and the hashes that content is named by.
SUBJECTS = ("x-rdf-subject:", "x-parse-rdf:")
HASHES = ("sha1:", "tiger:", "bitprint:")
SUBJECT = f"^(?:{'|'.join(SUBJECTS)})"
PURE = f"{SUBJECT}?urn:(?:tree:)?(?:{'|'.join(HASHES)})(.+)$"


def sha1_urn(content: Column) -> Column:
    return F.concat(F.lit("urn:sha1:"), base32_of_hex(F.sha1(content.cast("binary")), 20))


def sha1_part(urn: Column) -> Column:
    """The SHA-1 of a sha1 or bitprint URN; null for others."""
    found = F.regexp_extract(urn, r"^urn:(?:sha1:([A-Z2-7]{32})$|bitprint:([A-Z2-7]{32})\.[A-Z2-7]{39}$)", 0)
    return F.when(found == "", None).otherwise(F.regexp_extract(urn, "([A-Z2-7]{32})", 1))


def tiger_part(urn: Column) -> Column:
    """The tree hash of a tiger or bitprint URN; null for others."""
    found = F.regexp_extract(urn, r"^urn:(?:tree:tiger:|bitprint:[A-Z2-7]{32}\.)([A-Z2-7]{39})$", 1)
    return F.when(found == "", None).otherwise(found)


def equivalent(a: Column, b: Column) -> Column:
    """Three-valued: true if all parts that both have are equal, false if one differs, null if
    there is none, or only one of the two names an RDF subject."""
    one_sided = a.rlike(SUBJECT) != b.rlike(SUBJECT)
    a, b = (F.regexp_replace(x, SUBJECT, "") for x in (a, b))
    sha, tiger = sha1_part(a) == sha1_part(b), tiger_part(a) == tiger_part(b)
    return F.when(one_sided, None).otherwise(F.when(~sha | ~tiger, False).otherwise(F.coalesce(sha, tiger)))


def post_sector_path(name: Column) -> Column:
    """<first two characters>/<name>; shorter names unchanged."""
    return F.when(F.length(name) < 2, name).otherwise(F.concat_ws("/", F.substring(name, 1, 2), name))
