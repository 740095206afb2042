"""Formats and paths: guessed types, references in markup, dates, file URIs, conversions, scaled sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions.codecs import BASE32, base32_of_hex, percent_decode

#: Types by a name's extension, and by how a text or an image begins.
TYPES_BY_EXTENSION = {
    "txt": "text/plain; charset=utf-8", "html": "text/html; charset=utf-8", "nfo": "text/x-nfo", "js": "application/javascript", "rdf": "application/rdf+xml",
    "slf": "application/x-simple-list-file", "bmp": "image/bmp", "gif": "image/gif", "png": "image/png", "ico": "image/vnd.microsoft.icon", "ogg": "audio/ogg", "mp3": "audio/mpeg", "flac": "audio/flac",
}
RDF_STARTS = ("<RDF", "<Commit", "<Directory", "<Redirect", "<Description")
MAGIC = {"47494638": "image/gif", "89504E47": "image/png", "FFD8": "image/jpeg", "424D": "image/bmp"}
#: Fixed value: links in markup, one line at a time.
LINK = r'(?:src|href|resource)="([^"\r\n]*)"'
IMAGE_NAME = r"(?i)^.*?\.(?:jpe?g|gif|png|bmp)$"
SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:"
SNIFFED = 1024


def type_by_name(name: Column) -> Column:
    """The type that the name's extension stands for; null for others and for more than four letters."""
    extension = F.regexp_extract(F.lower(name), r"\.([^.]{1,4})$", 1)
    return F.element_at(F.create_map(*[F.lit(x) for kv in TYPES_BY_EXTENSION.items() for x in kv]), F.when(extension.isin(*TYPES_BY_EXTENSION), extension))


def guess_type(content: Column) -> Column:
    """The type of bytes by how they begin: RDF (of 20 bytes or more), HTML, UTF-8 text, images; else
    null. A character that the SNIFFED bytes cut does not make a text none."""
    start = F.substring(content, 1, SNIFFED)
    texts = [F.substring(content, 1, SNIFFED - k).cast("string") for k in range(4)]
    is_text = F.is_valid_utf8(texts[0])
    for t in texts[1:]:
        is_text = is_text | (F.octet_length(content) > SNIFFED) & F.is_valid_utf8(t)
    text = F.decode(start, "ISO-8859-1")  # as many characters as bytes, for what is sought is ASCII
    out = F.when((F.octet_length(content) >= 20) & text.rlike(f"^(?:{'|'.join(RDF_STARTS)})") & is_text, "application/rdf+xml")
    out = out.when(is_text & F.lower(text).contains("<html"), TYPES_BY_EXTENSION["html"]).when(is_text, TYPES_BY_EXTENSION["txt"])
    for digits, kind in MAGIC.items():
        out = out.when((F.octet_length(content) >= 4) & F.hex(start).startswith(digits), kind)
    return out


def content_type(given: Column, name: Column, content: Column) -> Column:
    """The type that is given, else that of the name, else that of the content."""
    return F.coalesce(given, type_by_name(name), guess_type(content))


def directory_format(given: Column) -> Column:
    """How a blob is read as a directory: as RDF if its type says so, else as a page of links."""
    return F.when(given.startswith("application/rdf+xml"), "rdf").otherwise("html")


def xml_unescape(text: Column) -> Column:
    """Text with its five named and all numbered references, decimal and hexadecimal, replaced; what is
    no reference stays."""
    parts = F.regexp_extract_all(text, F.lit("&(?:amp|lt|gt|quot|apos|#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6});|[^&]+|&"), F.lit(0))
    char = lambda digits: F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32")
    named = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'"}

    def one(p: Column) -> Column:
        out = F.when(p.rlike("^&#[0-9]"), char(F.hex(F.regexp_extract(p, "[0-9]+", 0).cast("long")))).when(p.rlike("^&#[xX]"), char(F.regexp_extract(p, "^&#[xX]([0-9A-Fa-f]+)", 1)))
        for name, c in named.items():
            out = out.when(p == name, c)
        return out.otherwise(p)

    return F.array_join(F.transform(parts, one), "")


def is_uri(text: Column) -> Column:
    return text.rlike(SCHEME)


def is_absolute(text: Column) -> Column:
    """Whether the first slash comes first, or a colon stands before it (drive letters too)."""
    return text.rlike("^/|^[^/:]+:")


def is_hierarchical(uri: Column) -> Column:
    return uri.rlike("^file:|^[^/:]+:/")


def listing(page: Column) -> Column:
    """array<struct<name, is_dir>> of a page's relative links, in order: what is above the page, a
    query, absolute or empty is left out, and of the rest the first segment is taken."""
    links = F.transform(F.regexp_extract_all(page, F.lit(LINK), F.lit(1)), lambda x: F.regexp_replace(xml_unescape(x), r"^\./", ""))
    own = F.filter(links, lambda x: ~(x.startswith("../") | x.startswith("?") | is_absolute(x) | (x == "")))
    return F.transform(own, lambda x: F.struct(F.substring_index(x, "/", 1).alias("name"), x.contains("/").alias("is_dir")))


def query_arguments(uri: Column) -> Column:
    """array<struct<name, value>> of what follows the first question mark, percent-decoded, in order;
    one without an equals sign is its own value."""
    parts = F.filter(F.split(F.regexp_extract(uri, r"(?s)^[^?]*\?(.*)$", 1), "&"), lambda p: p != "")
    name = lambda p: percent_decode(F.regexp_extract(p, "(?s)^([^=]*)", 1))
    return F.transform(parts, lambda p: F.struct(name(p).alias("name"), F.when(p.contains("="), percent_decode(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1))).otherwise(name(p)).alias("value")))


def escape_path(path: Column) -> Column:
    """path's UTF-8 bytes as %XX, but for letters, digits and / + - . : ~ ^ ( ) \\ _."""
    pairs = F.regexp_extract_all(F.hex(path.cast("binary")), F.lit(".."), F.lit(0))
    safe = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789/+-.:~^()\\_")
    char = lambda p: F.decode(F.unhex(p), "ISO-8859-1")
    return F.array_join(F.transform(pairs, lambda p: F.when(F.contains(safe, char(p)), char(p)).otherwise(F.concat(F.lit("%"), p))), "")


def file_uri(text: Column) -> Column:
    """A path as a file: URI, with two slashes before a host's or one of this machine, three before a drive
    letter; URIs stay."""
    path = escape_path(F.translate(text, "\\", "/"))
    return (
        F.when(text.startswith("//"), F.concat(F.lit("file:"), path)).when(text.startswith("/"), F.concat(F.lit("file://"), path))
        .when(text.rlike("^[A-Za-z]:"), F.concat(F.lit("file:///"), path)).when(is_uri(text), text).otherwise(F.concat(F.lit("file:"), path))
    )


def file_path(text: Column) -> Column:
    """struct(host, path, absolute) of a path or file: URI; host is localhost for paths of this machine,
    null for relative ones."""
    plain = F.when(text.startswith("file:"), percent_decode(F.substring(text, 6, 1 << 30))).otherwise(text)
    named = plain.startswith("//")
    host = F.when(named, F.regexp_extract(plain, "^//([^/]*)", 1)).when(plain.rlike("^/|^[A-Za-z]:"), "localhost")
    path = F.when(named, F.concat(F.lit("/"), F.regexp_extract(plain, "^//[^/]*/(.*)$", 1))).otherwise(plain)
    return F.struct(host.alias("host"), path.alias("path"), host.isNotNull().alias("absolute"))


def parse_date(text: Column) -> Column:
    """Time of `2000-01-31 12:00:00 GMT`, or without a zone in the session's; null for other text."""
    zoned = F.try_to_timestamp(F.regexp_replace(text, " (?:GMT|UTC)$", " +0000"), F.lit("yyyy-MM-dd HH:mm:ss xx"))
    return F.coalesce(zoned, F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")))


def base32_decode(text: Column) -> Column:
    """Bytes of base32 in either case; characters of no value are skipped, left-over bits too."""
    chars = F.regexp_replace(F.upper(text), "[^A-Z2-7]", "")
    bits = F.transform(F.regexp_extract_all(chars, F.lit("."), F.lit(0)), lambda c: F.lpad(F.bin((F.instr(F.lit(BASE32), c) - 1).cast("long")), 5, "0"))
    whole = F.array_join(bits, "")
    octets = F.regexp_extract_all(whole, F.lit("[01]{8}"), F.lit(0))
    return F.unhex(F.array_join(F.transform(octets, lambda b: F.lpad(F.conv(b, 2, 16), 2, "0")), ""))


def convert(data: Column, source: str, target: str) -> Column:
    """Text in one of none, url, hex (base16), base32 as text in another, also upper-hex; none is UTF-8 itself."""
    digits = F.when(F.length(data) % 2 == 1, F.concat(data, F.lit("0"))).otherwise(data)  # an odd digit is the high one
    decoded = {"none": lambda: data.cast("binary"), "url": lambda: percent_decode(data).cast("binary"), "base32": lambda: base32_decode(data)}.get(source, lambda: F.unhex(digits))()
    if target == "base32":
        n = (F.octet_length(decoded) * 8 + 4) / 5
        return F.substring(base32_padded(decoded), F.lit(1), F.floor(n).cast("int"))
    pairs = F.regexp_replace(F.hex(decoded), "(..)", "%$1")
    return {"none": decoded.cast("string"), "url": pairs, "upper-hex": F.hex(decoded)}.get(target, F.lower(F.hex(decoded)))


def base32_padded(data: Column) -> Column:
    """Base32 of bytes of any number, with characters of zeros up to whole groups of five bytes."""
    groups = F.regexp_extract_all(F.rpad(F.hex(data), (F.ceil(F.octet_length(data) / 5) * 10).cast("int"), F.lit("0")), F.lit(".{10}"), F.lit(0))
    return F.array_join(F.transform(groups, lambda g: base32_of_hex(g, 5)), "")


def urn_kinds(urn: Column) -> Column:
    """struct(sha1, tiger, bitprint): whether an address gives a hash of that scheme: a bitprint all."""
    bitprint = urn.rlike(r"^urn:bitprint:[A-Z2-7]{32}\.[A-Z2-7]{39}$")
    return F.struct((bitprint | urn.rlike("^urn:sha1:[A-Z2-7]{32}$")).alias("sha1"), (bitprint | urn.rlike("^urn:tree:tiger:[A-Z2-7]{39}$")).alias("tiger"), bitprint.alias("bitprint"))


def scaled_size(w: Column, h: Column, scale=None, scale_x=None, scale_y=None, width=None, height=None, max_width=None, max_height=None, keep_aspect: bool = True) -> Column:
    """struct(width, height) in whole pixels: scales first, then given sizes, the other side by the
    aspect, then the limits."""
    opt = lambda x: F.lit(None).cast("double") if x is None else F.lit(x).cast("double")
    nw = F.coalesce(opt(width), F.floor(w * opt(scale_x)), F.floor(w * opt(scale)))
    nh = F.coalesce(opt(height), F.floor(h * opt(scale_y)), F.floor(h * opt(scale)))
    by_h, by_w = (F.floor(w * nh / h), F.floor(h * nw / w)) if keep_aspect else (w, h)
    nw, nh = F.coalesce(nw, by_h, w), F.coalesce(nh, by_w, h)
    if max_width is not None:
        over = nw > max_width
        nw, nh = F.when(over, opt(max_width)).otherwise(nw), F.when(over & F.lit(keep_aspect), F.floor(nh * max_width / nw)).otherwise(nh)
    if max_height is not None:
        over = nh > max_height
        nw, nh = F.when(over & F.lit(keep_aspect), F.floor(nw * max_height / nh)).otherwise(nw), F.when(over, opt(max_height)).otherwise(nh)
    return F.struct(nw.cast("long").alias("width"), nh.cast("long").alias("height"))


def next_key(highest: Column) -> Column:
    """The key after one that begins with a number; "0" where there is none."""
    return F.coalesce((F.regexp_extract(highest, "^[0-9]+", 0).cast("long") + 1).cast("string"), F.lit("0"))
