"""Values and names: words for booleans, time deltas, repository references, paths, key hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are booleans, in any case.
TRUE_WORDS = ("true", "yes", "yeah", "on", "ja", "oui", "si", "ok")
FALSE_WORDS = ("false", "no", "nah", "off", "nein", "non")
#: Milliseconds in a unit of a time delta.
UNITS = {"": 1000, "seconds": 1000, "s": 1000, "minutes": 60_000, "hours": 3_600_000, "days": 86_400_000, "weeks": 604_800_000, "months": 2_628_002_880, "years": 31_556_952_000}
#: RS hash's first multiplier and what multiplies it.
RS_A, RS_B = 63689, 378551

NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def boolean(text: Column) -> Column:
    """A word's truth, or whether a number is not zero; null for null and for other text."""
    word = F.lower(text)
    number = F.when(text.rlike(NUMBER), F.trim(text).cast("double") != 0)
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False).otherwise(number)


def delta_ms(text: Column) -> Column:
    """Milliseconds of `+3days`, `-2`, `+1weeks`; null if badly formed or of an unknown unit."""
    part = lambda i: F.regexp_extract(text, r"^([+-])([0-9]{1,15})(\w*)$", i)
    each = F.lit(None).cast("long")
    for unit, ms in UNITS.items():
        each = F.when(part(3) == unit, F.lit(ms).cast("long")).otherwise(each)
    return F.when(part(1) != "", each * part(2).cast("long") * F.when(part(1) == "-", -1).otherwise(1))


def repo_ref(uri: Column, assume_head: bool) -> Column:
    """struct(repo_name, sub_path) of `[x-...-repo:|x-...-head:][//repo][/]path`; repo_name is null
    where none is named, sub_path begins with heads/ for heads."""
    rest = F.regexp_replace(F.regexp_replace(uri, "^x-[a-z]+-head:", ""), "^x-[a-z]+-repo:", "")
    head = F.when(uri.rlike("^(x-[a-z]+-head:)?x-[a-z]+-repo:"), False).when(uri.rlike("^x-[a-z]+-head:"), True).otherwise(assume_head)
    named = rest.startswith("//")
    path = F.regexp_replace(F.when(named, F.regexp_replace(rest, "^//[^/]*/?", "")).otherwise(rest), "^/", "")
    return F.struct(F.when(named, F.regexp_extract(rest, "^//([^/]*)", 1)).alias("repo_name"), F.when(head, F.concat(F.lit("heads/"), path)).otherwise(path).alias("sub_path"))


def without_dots(path: Column) -> Column:
    """path without its `.` segments, and without each `..` that has a named segment before it,
    which goes too. The first segment (what is before the first slash) always stays."""

    def step(kept: Column, segment: Column) -> Column:
        up = (segment == "..") & (F.size(kept) > 1) & (F.element_at(kept, -1) != "..")
        return F.when(up, F.slice(kept, 1, F.size(kept) - 1)).when(segment == ".", kept).otherwise(F.concat(kept, F.array(segment)))

    parts = F.split(path, "/")
    ends_open = F.element_at(parts, -1).isin(".", "..")  # a/b/.. is the folder a/
    kept = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.slice(parts, 1, 1), step)
    return F.array_join(F.when(ends_open & (F.element_at(kept, -1) != ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")


def append_path(base: Column, path: Column, drop_last: bool = True) -> Column:
    """path as seen from the hierarchical base, with backslashes as slashes and dot segments taken out.
    An empty base gives path, an empty path base; a URI for path, itself. Null where either is null."""
    base, path = F.translate(base, "\\", "/"), F.translate(path, "\\", "/")
    scheme = "^[A-Za-z][A-Za-z0-9+.-]*:"
    is_uri, host = base.rlike(scheme), F.regexp_extract(base, f"({scheme}(//[^/]*)?)", 1)
    root = F.when(is_uri, F.concat(host, path)).otherwise(path)
    plain = F.when(is_uri, F.regexp_replace(base, "(?<!^)[?#].*$", "")).otherwise(base)
    folder = F.regexp_replace(plain, "[^/]*$", "") if drop_last else F.when(plain.endswith("/"), plain).otherwise(F.concat(plain, F.lit("/")))
    top = F.regexp_extract(folder, f"^({scheme[1:]}//[^/]*)/", 1)  # dots do not climb above the host
    joined = F.concat(top, without_dots(F.substring(F.concat(folder, path), F.length(top) + F.lit(1), F.length(folder) + F.length(path))))
    return F.when(base == "", path).when(path == "", base).when(path.rlike(scheme), path).when(path.startswith("/"), root).otherwise(joined)


def strip_subject(uri: Column) -> Column:
    """What follows x-rdf-subject: or x-parse-rdf:; null for other URIs."""
    return F.when(uri.rlike("^x-(rdf-subject|parse-rdf):"), F.regexp_replace(uri, "^x-(rdf-subject|parse-rdf):", ""))


def thumbnail_name(name: Column, w: int, h: int) -> Column:
    """name with -WxH before its last extension, or at its end."""
    return F.when(name.contains("."), F.regexp_replace(name, r"^(.*)(\.[^.]*)$", f"$1-{w}x{h}$2")).otherwise(F.concat(name, F.lit(f"-{w}x{h}")))


def rs_hash(key: Column) -> Column:
    """RS hash of a key's bytes as an index file has it: 32 bits that wrap, bytes with a sign, top bit cleared."""
    low, wide = F.lit(0xFFFF).cast("long"), F.lit(0xFFFFFFFF).cast("long")

    def times(x: Column, y: Column) -> Column:
        high = F.shiftleft((x * F.shiftright(y, 16)).bitwiseAND(low), 16)
        return (x * y.bitwiseAND(low) + high).bitwiseAND(wide)

    codes = F.transform(F.filter(F.split(F.regexp_replace(F.hex(key.cast("binary")), "(..)", "$1 "), " "), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("long"))
    signed = F.transform(codes, lambda c: F.when(c > 127, c - 256).otherwise(c))
    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(RS_A).cast("long").alias("a"))
    step = lambda s, c: F.struct((times(s["h"], s["a"]) + c).bitwiseAND(wide).alias("h"), times(s["a"], F.lit(RS_B).cast("long")).alias("a"))
    return F.aggregate(signed, start, step, lambda s: s["h"].bitwiseAND(F.lit(0x7FFFFFFF).cast("long")))


def from_cp437(data: Column) -> Column:
    """Text of code page 437 bytes; control characters stay."""
    high = bytes(range(128, 256))
    return F.translate(F.decode(data, "ISO-8859-1"), high.decode("latin-1"), high.decode("cp437"))


def option_true(text: Column, default: bool = False) -> Column:
    """An option's truth: default for null, false for an empty text, else true: `0` and `false` are
    texts too. Values that are booleans or numbers are true where not false or zero: see truth()."""
    return F.when(text.isNull(), default).otherwise(text != "")


def caption(text: Column, most: int = 75) -> Column:
    """text, or where it is longer than most, dots and its end."""
    return F.when(F.length(text) > most, F.concat(F.lit("..."), F.right(text, F.lit(most - 2)))).otherwise(text)  # fixed values


def up_to_root(path: Column) -> Column:
    """The relative path from a page to the root: ../ for each slash."""
    return F.repeat(F.lit("../"), F.length(path) - F.length(F.replace(path, F.lit("/"))))
