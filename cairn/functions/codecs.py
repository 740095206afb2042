"""Encodings of bytes and text, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_hex(digest: Column, n_bytes: int) -> Column:
    """Base32 without padding of n_bytes given as hex digits: each five digits are 20 bits, four characters."""
    n = -(-8 * n_bytes // 5)
    padded = F.rpad(digest, -(-n // 4) * 5, "0")

    def char(i: Column) -> Column:
        word = F.conv(F.substring(padded, (F.floor(i / 4) * 5 + 1).cast("int"), F.lit(5)), 16, 10).cast("int")
        # Four five-bit groups; shifts by a column need SQL's function.
        bits = F.call_function("shiftright", word, (15 - 5 * (i % 4)).cast("int")).bitwiseAND(31)
        return F.substring(F.lit(BASE32), (bits + 1).cast("int"), F.lit(1))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), char), "")


def percent_encode(text: Column) -> Column:
    """Keeps A-Z a-z 0-9 - . _ ~; other UTF-8 bytes as %XX."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def percent_decode(text: Column) -> Column:
    """%XX only: a plus sign stands for itself."""
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def data_uri(text: Column) -> Column:
    return F.concat(F.lit("data:,"), percent_encode(text))


def xml_escape(text: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def percent_encode_bytes(data: Column) -> Column:
    """Every byte as %XX."""
    return F.regexp_replace(F.hex(data), "(..)", "%$1")


def parse_data_uri(uri: Column) -> Column:
    """struct(format, content): of `data:[part;...],payload` the last part that is not base64, null
    if there is none, and the payload's bytes. Null for other URIs."""
    head = F.regexp_extract(uri, "^data:([^,]*),", 1)
    payload = F.regexp_replace(uri, "^data:[^,]*,", "")
    kinds = F.filter(F.split(head, ";"), lambda p: ~p.isin("", "base64"))
    is_base64 = F.array_contains(F.split(head, ";"), "base64")
    content = F.when(is_base64, F.unbase64(payload)).otherwise(percent_decode(F.when(~is_base64, payload)).cast("binary"))
    return F.when(uri.rlike("^data:[^,]*,"), F.struct(F.get(F.reverse(kinds), F.lit(0)).alias("format"), content.alias("content")))


def cache_record(size: Column, mtime_ms: Column, digest: Column) -> Column:
    """Record of a hash cache: size and time, 8 bytes each with the high byte first, then the hash."""
    number = lambda x: F.unhex(F.lpad(F.hex(x.cast("long")), 16, "0"))
    return F.concat(number(size), number(mtime_ms), digest.cast("binary"))


def parse_cache_record(record: Column) -> Column:
    """struct(size, mtime_ms, digest); numbers under 2^63. Null for fewer than 16 bytes."""
    number = lambda at: F.conv(F.hex(F.substring(record, at, 8)), 16, 10).cast("long")
    whole = F.octet_length(record) >= 16
    return F.when(whole, F.struct(number(1).alias("size"), number(9).alias("mtime_ms"), F.substring(record, 17, 1 << 30).alias("digest")))
