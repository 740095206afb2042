"""Secret scans: fixed patterns, and a battery of randomness tests under FDR control.

DataFrame functions only. Three patterns give the base spans. Besides, every run of
TOKEN characters gets an inferred encoding, and three statistics of its characters over
that encoding's alphabet: chi-squared uniformity, runs of character classes, and serial
correlation at lag 1. A token is a candidate if none of the three rejects randomness.
Its evidence is how unlikely ordinary text of its length looks that uniform and changes
class that often: the larger of the two chances, squared. Over all tokens of one encoding and
length class the Benjamini-Hochberg procedure keeps the false discoveries below RATE:
short tokens, which text matches by chance more often, get a sharper threshold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import cut

#: Fixed by the contract, in the order in which kinds are listed.
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "random")
UPPER, LOWER, DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALPHABETS = {
    "hex": DIGIT + "abcdef", "HEX": DIGIT + "ABCDEF", "base32": UPPER + "234567", "base32l": LOWER + "234567", "base36": UPPER + DIGIT, "base36l": LOWER + DIGIT,
    "letters": UPPER + LOWER, "base62": UPPER + LOWER + DIGIT, "base64": UPPER + LOWER + DIGIT + "+/", "base64url": UPPER + LOWER + DIGIT + "-_",
}
#: Characters of each encoding that are of one class: capitals, small letters, digits, signs.
CLASSES = {"hex": (10, 6), "HEX": (10, 6), "base32": (26, 6), "base32l": (26, 6), "base36": (26, 10), "base36l": (26, 10), "letters": (26, 26), "base62": (26, 26, 10), "base64": (26, 26, 10, 2), "base64url": (26, 26, 10, 2)}
MIXED = ("letters", "base62", "base64", "base64url")
UUID = "^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"
#: Of ordinary text: chance that two letters are equal, its standard deviation for one pair, and chance that the class of a character differs from the last one's.
SAME, SAME_SD, CHANGE = 0.07, 0.26, 0.12
#: The last one where upper and lower case and digits mix: there, ordinary text is a name of several words.
CHANGE_MIXED = 0.35
#: A randomness test rejects beyond so many standard deviations.
REJECT = 3.5
RATE = 0.01
#: Evidence is counted in steps of 1/BINS of a power of ten, up to 10^-30.
BINS = 8


def _spans(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, size, text>> of the leftmost non-overlapping matches, in code
    points, end exclusive; size: length of the pattern's group. Each match is taken with the
    gap before it, so that lengths add up to places."""
    lazily = F.lit(f"(?s)\\G(.*?)({pattern})")  # from the last match on: else what follows the last one is searched from each place
    parts = F.arrays_zip(
        F.regexp_extract_all(text, lazily, F.lit(0)).alias("all"), F.regexp_extract_all(text, lazily, F.lit(2)).alias("hit"),
        F.regexp_extract_all(text, lazily, F.lit(2 + group)).alias("of"),
    )
    empty = F.array().cast("array<struct<start:bigint,end:bigint,size:bigint,text:string>>")
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("out"))

    def step(s: Column, m: Column) -> Column:
        end = s["at"] + F.length(m["all"])
        one = F.struct((end - F.length(m["hit"])).alias("start"), end.alias("end"), F.length(m["of"]).cast("bigint").alias("size"), m["hit"].alias("text"))
        return F.struct(end.alias("at"), F.array_append(s["out"], one).alias("out"))

    return F.aggregate(parts, zero, step, lambda s: s["out"])


def _let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _kind(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("k"), s["end"].alias("end")))


def _below(z: Column) -> Column:
    """The normal distribution's share below z, by a logistic approximation."""
    z = F.greatest(F.least(z, F.lit(12.0)), F.lit(-12.0))
    return 1 / (1 + F.exp(-(1.5976 * z + 0.07056 * z * z * z)))


def bare(token: Column) -> Column:
    """The token's characters that can be random: without the dashes of a UUID."""
    return F.when(token.rlike(UUID), F.replace(token, F.lit("-"), F.lit(""))).otherwise(token)


def encoding(token: Column) -> Column:
    """The encoding that the token's characters suggest. Null: digits alone; letters of one case
    alone, which cannot be told from words; signs of both base64 alphabets; signs without
    capitals, small letters and digits, as names and paths have them."""
    return (
        F.when(token.rlike("^[0-9]+$"), None).when(token.rlike("^[0-9a-f]+$"), "hex").when(token.rlike("^[0-9A-F]+$"), "HEX").when(token.rlike("^([A-Z]+|[a-z]+)$"), None)
        .when(token.rlike("^[A-Z2-7]+$"), "base32").when(token.rlike("^[a-z2-7]+$"), "base32l").when(token.rlike("^[A-Z0-9]+$"), "base36").when(token.rlike("^[a-z0-9]+$"), "base36l")
        .when(token.rlike("^[A-Za-z]+$"), "letters").when(~token.rlike("^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])"), None)
        .when(token.rlike("^[A-Za-z0-9]+$"), "base62").when(token.rlike("^[A-Za-z0-9+/]+$"), "base64").when(token.rlike("^[A-Za-z0-9_-]+$"), "base64url")
    )


def evidence(token: Column, code: Column) -> Column:
    """-log10 of the chance that ordinary text looks as random as the token, 0 if a test rejects
    that it is random."""
    uniform, runs, serial, found = battery(token, code)
    return F.when((F.abs(uniform) <= REJECT) & (F.abs(runs) <= REJECT) & (F.abs(serial) <= REJECT), F.greatest(found, F.lit(0.0))).otherwise(0.0)


def battery(token: Column, code: Column) -> tuple[Column, Column, Column, Column]:
    """Standard scores of the three tests, and -log10 of that chance."""
    n = F.length(token).cast("double")
    size = F.element_at(F.create_map(*[F.lit(x) for k, v in ALPHABETS.items() for x in (k, float(len(v)))]), code)
    alphabet = F.element_at(F.create_map(*[F.lit(x) for kv in ALPHABETS.items() for x in kv]), code)
    squares = F.aggregate(F.split(alphabet, ""), F.lit(0.0), lambda s, c: s + F.pow(n - F.length(F.replace(token, c, F.lit(""))), F.lit(2.0)))
    chi = size / n * squares - n
    uniform = (chi - (size - 1)) / F.sqrt(2 * (size - 1))
    as_chi = lambda same: size / n * (n + n * (n - 1) * same) - n  # noqa: E731  of a share of equal pairs
    like_text = (chi - as_chi(F.lit(SAME))) / (as_chi(SAME_SD / n * math.sqrt(2)) - as_chi(F.lit(0.0)))

    classes = F.translate(token, UPPER + LOWER + DIGIT + "+/_-", "U" * 26 + "L" * 26 + "D" * 10 + "SSSS")
    changes = F.length(F.regexp_replace(classes, r"(.)\1+", "$1")) - 1
    rate = F.element_at(F.create_map(*[F.lit(x) for k, v in CLASSES.items() for x in (k, 1 - sum((a / sum(v)) ** 2 for a in v))]), code)
    runs = (changes - (n - 1) * rate) / F.sqrt((n - 1) * rate * (1 - rate))
    usual = F.when(code.isin(*MIXED), CHANGE_MIXED).otherwise(CHANGE)
    often = (changes - 0.5 - (n - 1) * usual) / F.sqrt((n - 1) * usual * (1 - usual))

    def lag(off: Column) -> Column:
        var = F.aggregate(off, F.lit(0.0), lambda s, x: s + x * x)
        next_to = F.aggregate(F.zip_with(F.slice(off, 1, F.size(off) - 1), F.slice(off, 2, F.size(off) - 1), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        return _let(var, lambda v: F.when(v > 0, next_to / v * F.sqrt(n)).otherwise(99.0))

    place = F.transform(F.split(token, ""), lambda c: F.instr(alphabet, c).cast("double"))
    centred = lambda xs: _let(F.aggregate(xs, F.lit(0.0), lambda s, x: s + x) / n, lambda mean: F.transform(xs, lambda x: x - mean))
    serial = _let(_let(place, centred), lag)

    return uniform, runs, serial, -2 * F.log10(F.greatest(_below(like_text), _below(-often)))


def scan(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns in keep, with _base (base spans by start, then kind) and _tokens (start, end,
    stratum, bin of the other tokens). Null text counts as empty."""
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    none = F.array().cast("array<struct<start:bigint,end:bigint,size:bigint,text:string>>")
    assign = F.when(t.rlike("(?i)password|passwd|secret|token|api_?key"), F.filter(_spans(t, ASSIGN, 2), lambda s: s["size"] >= 12)).otherwise(none)
    access = F.when(t.contains("AKIA"), _spans(t, ACCESS)).otherwise(none)
    hexes = F.when(t.rlike("[0-9a-f]{16}"), _spans(t, HEX)).otherwise(none)
    tokens = F.when(t.rlike("[A-Za-z0-9+/_-]{20}"), F.filter(_spans(t, TOKEN), lambda s: encoding(bare(s["text"])).isNotNull())).otherwise(none)
    base = F.array_sort(F.concat(_kind(assign, "assign"), _kind(access, "access"), _kind(hexes, "hex")))
    # A generator stands between, else the optimizer repeats the patterns where _base is used.
    found = docs.select(*keep, F.inline(F.array(F.struct(base.alias("_base"), tokens.alias("_found")))))
    # A token that a base span holds only in part stays: the rest of it is as secret.
    free = F.filter("_found", lambda s: ~F.exists("_base", lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"])))

    def tested(s: Column) -> Column:
        token = bare(s["text"])
        code = encoding(token)
        stratum = F.concat(code, F.lit(":"), F.floor(2 * F.log2(F.length(token))).cast("string"))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), stratum.alias("stratum"), F.floor(F.least(evidence(token, code), F.lit(30.0)) * BINS).alias("bin"))

    return found.select(*keep, "_base", F.transform(free, tested).alias("_tokens"))


def thresholds(scanned: DataFrame, rate: float = RATE) -> dict[str, int]:
    """By encoding and length class, the least bin that counts as a discovery. Only a
    histogram of at most a few hundred bins for each class leaves the cluster."""
    counts = scanned.select(F.explode("_tokens").alias("t")).groupBy("t.stratum", "t.bin").count().collect()
    out = {}
    for stratum in {r[0] for r in counts}:
        bins = sorted(((r[1], r[2]) for r in counts if r[0] == stratum), reverse=True)
        total, so_far = sum(n for _, n in bins), 0
        for b, n in bins:
            so_far += n
            if b > 0 and 10 ** (-b / BINS) * total <= rate * so_far:
                out[stratum] = b
    return out


def _with_random(found: DataFrame, least: dict[str, int]) -> DataFrame:
    """found with _spans: base spans and discoveries, by start, then kind."""
    limit = F.create_map(*[F.lit(x) for kv in sorted(least.items()) for x in kv]) if least else F.lit(None).cast("map<string,int>")
    random = F.filter("_tokens", lambda s: F.coalesce(s["bin"] >= F.try_element_at(limit, s["stratum"]), F.lit(False)))
    return found.withColumn("_spans", F.array_sort(F.concat("_base", _kind(random, "random"))))


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """(id_col, spans): spans is array<struct<kind, start, end>> in code points, by start, then
    kind. One row per row of docs: repeated rows, null ids and null or empty texts (no spans)
    too. Empty table: no rows. Other columns are not read."""
    names = F.array(*map(F.lit, KINDS))
    plain = lambda s: F.struct(names[s["k"]].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    found = cut(scan(docs, text_col, (id_col,)))
    return _with_random(found, thresholds(found, rate)).select(id_col, F.transform("_spans", plain).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]", rate: float = RATE) -> DataFrame:
    """docs with every secret in text_col replaced by mask (overlapping ones by one); null
    stays null, and texts without secrets stay as they are."""
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).cast("string").alias("_t"))  # so that no name clashes
    scanned = scan(rows, "_t", ("row", "_t"))
    least = thresholds(cut(scanned.select("_tokens").where(F.size("_tokens") > 0)), rate)
    found = _with_random(scanned, least)
    found = found.select("row", "_t", F.inline(F.array(F.struct("_spans"))))
    pieces = F.aggregate(
        "_spans", F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")),
        lambda s, x: F.struct(
            F.greatest(s["at"], x["end"]).alias("at"),
            F.when((x["start"] < s["at"]) & (s["at"] > 0), s["out"]).otherwise(F.concat(s["out"], F.substring(F.col("_t"), (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit(mask))).alias("out"),
        ),
    )
    text = F.when(F.col("_t").isNull() | (F.size("_spans") == 0), F.col("_t")).otherwise(F.concat(pieces["out"], F.substring(F.col("_t"), (pieces["at"] + 1).cast("int"), F.length("_t"))))
    return found.select(F.col("row").withField(text_col, text).alias("row")).select("row.*")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns over documents: counts by kind, a digest of the base spans and
    all spans as text."""
    text = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    found = secrets(docs)
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), count("random").alias("n_random"),
        F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"),
    )
