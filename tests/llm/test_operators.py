"""Each operator against SQL, a brute-force version or held-out accuracy, over the smallest tables."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from cairn.llm import decontaminate, embeddings, langid, lines, lm, mixing, pages, secrets, simhash, suffixes
from cairn.llm.common import components, table
from cairn.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").orderBy("doc_id").collect()]


def groups(ids, linked):
    """The smallest id that each one reaches, by union and find."""
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in linked:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name]).df()
    got = QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) > 0
    plain = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype(float).round(9).to_numpy().tolist()))
    assert plain(got) == plain(want)


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(400, 440)]
    got = dict(map(tuple, components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    want = groups({x for p in pairs for x in p}, pairs)
    assert got == {k: v for k, v in want.items() if any(k in p and p[0] != p[1] for p in pairs)}


def test_simhash_brute(spark, docs):
    import xxhash

    def plain(text):
        words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
        grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = {i: plain(t) for i, t in docs}
    ids = sorted(fps)
    want = groups(ids, [(a, b) for k, a in enumerate(ids) for b in ids[:k] if (fps[a] ^ fps[b]).bit_count() <= 3])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op2_simhash"](spark, SF).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in ids}


@pytest.mark.parametrize("bits", [0, 1, 3, 4])
def test_simhash_links(spark, bits):
    rng = np.random.default_rng(bits)
    some = [int(x) for x in rng.integers(0, 1 << 63, 40)]
    some += [x ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 6), replace=False)) for x in some for _ in range(5)]
    fps = sorted(set(some))
    want = {(a, b) for k, b in enumerate(fps) for a in fps[:k] if (a ^ b).bit_count() <= bits}
    got = [tuple(r) for r in simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), bits).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def repeats_brute(rows):
    """rows (id, bytes) in order: (bytes, removed, spans, digest) of each."""
    seen, out = set(), {}
    for i, t in rows:
        gone = bytearray(len(t))
        for at in range(len(t) - 99):
            s = t[at : at + 100]
            if s in seen:
                gone[at : at + 100] = b"\1" * 100
            seen.add(s)
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out[i] = (len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def test_suffixes_brute(spark, docs):
    want = repeats_brute([(i, (t or "").encode()) for i, t in docs])
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op3_suffixes"](spark, SF).collect()}
    assert got == want
    assert any(w[1] for w in want.values())


def test_suffixes_periods(spark):
    """Periods, overlaps in one document, passages that begin and end anywhere."""
    rng = np.random.default_rng(3)
    base = bytes(rng.integers(97, 101, 2000, np.uint8)).decode()
    texts = ["ab" * 300, "a" * 450, base, base[300:1200] + "x" + base[1250:1349] + base[1400:1500], base[:99], base[:100], "ab" * 60 + base[700:850], None, ""]
    got = {r[0]: tuple(r)[1:] for r in suffixes.repeated_bytes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == repeats_brute([(i, (t or "").encode()) for i, t in enumerate(texts)])


def test_secrets_brute(spark, docs):
    kinds = ("assign", "access", "hex")
    patterns = (r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", r"AKIA[A-Z0-9]+", r"[0-9a-f]+")
    made = ["API-key = abcdefghijkl0", "passwd: 'abc+/_.=-defg' token=short Secret=\"0123456789abcdef01\"", "ünï AKIA" + "Q7" * 9 + "x", "deadbeef" * 4 + "G" + "0" * 15, "apikey:" + "k" * 12 + " password = secret=abcdefghijklmnop"]
    docs = docs + [(10**6 + k, t) for k, t in enumerate(made)]
    got = {r["doc_id"]: r for r in secrets.digest(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, t in docs:
        spans = []
        for k, (p, group, least) in enumerate(zip(patterns, (2, 0, 0), (12, 18, 16), strict=True)):
            spans += [(m.start(), k, m.end()) for m in re.finditer(p, t or "") if len(m[group]) >= least]
        text = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(spans))
        r, n = got[i], Counter(k for _, k, _ in spans)
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == (n[0], n[1], n[2], hashlib.sha256(text.encode()).hexdigest())
        assert ",".join(x for x in r["spans"].split(",") if not x.startswith("random")) == text
    assert sum(r["n_assign"] for r in got.values())


def test_secrets_random(spark):
    rng = np.random.default_rng(5)
    code = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    keys = ["".join(code[i] for i in rng.integers(0, 64, 40)) for _ in range(30)]
    plain = ["theQuickBrownFox12JumpsOverTheLazyDogAgain", "InternationalizationOfDocuments2024Edition", "see the words of this line, which hide nothing"]
    df = spark.createDataFrame(list(enumerate([f"use {k} here" for k in keys] + plain * 5)), "doc_id long, text string")
    found = {r[0]: r[1] for r in secrets.secrets(df).collect()}
    assert sum(bool(found[i]) for i in range(30)) >= 24
    assert not any(found[i] for i in range(30, 45))
    masked = {r[0]: r[1] for r in secrets.redact(df).collect()}
    assert masked[44] == plain[2]
    assert all((keys[i] not in masked[i]) == bool(found[i]) for i in range(30))


def test_langid_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = QUERIES["op5_langid"](spark, d).join(table(spark, d, "documents").select("doc_id", "lang", "text"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) and 0 <= r["score"] <= 1 for r in got)
    held = [r["lang_pred"] == r["lang"] for r in got if r["held_out"] and r["lang"] and r["lang_pred"] != "und"]
    assert np.mean(held) > 0.9


def vectors_brute(rows, threshold=0.95):
    ids, x = [i for i, _ in rows], []
    for _, v in rows:
        v = np.array(v if v is not None and None not in v else [0.0], float)
        x.append(v / np.linalg.norm(v) if np.isfinite(v).all() and np.linalg.norm(v) > 0 else None)
    good = [k for k, v in enumerate(x) if v is not None]
    m = np.array([x[k] for k in good])
    near = m @ m.T >= threshold
    np.fill_diagonal(near, False)
    a, b = np.nonzero(near)
    n = dict.fromkeys(range(len(ids)), 0) | dict(zip(good, near.sum(1).tolist(), strict=True))
    up = groups(ids, [(ids[good[i]], ids[good[j]]) for i, j in zip(a, b, strict=True)])
    return {ids[k]: (n[k], up[ids[k]], up[ids[k]] == ids[k]) for k in range(len(ids))}


def test_embeddings_brute(spark):
    rows = [tuple(r) for r in table(spark, SF, "embeddings").select("vec_id", "embedding").collect()]
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op6_embeddings"](spark, SF).collect()}
    assert got == vectors_brute(rows)


def test_embeddings_groups(spark):
    """A large group, a chain, exact copies and vectors that link with nothing."""
    rng = np.random.default_rng(2)
    centre = rng.normal(size=16)
    near = [(centre + rng.normal(size=16) * 0.12).tolist() for _ in range(300)]
    turn = [[float(np.cos(a)), float(np.sin(a)), *[0.0] * 14] for a in np.arange(12) * 0.29]
    odd = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, []]
    rows = list(enumerate(near + turn + [near[3]] * 4 + rng.normal(size=(200, 16)).tolist() + odd))
    got = {r[0]: tuple(r)[1:] for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == vectors_brute(rows)


def test_pages(spark):
    def page(k):
        body = "".join(f"<p>Part {j} of article {k}:\n  it tells of <b>matter {k * 7 + j}</b> &amp; more.</p>" for j in range(1 + k % 4))
        return f"""<html><head><title>T{k}</title><style>p {{}}</style></head><body><nav><ul><li><a href="/">Home</a><li><a href="/x">News</a></ul></nav>
            <div class="content"><h1>Heading {k}</h1>{body}</div><div class="comments"><p>Reader {k} says hello</p></div><script>var a = "<p>no</p>";</script><footer>All rights of host</footer></body></html>"""

    def text(k):
        return "\n".join([f"Heading {k}", *(f"Part {j} of article {k}: it tells of matter {k * 7 + j} & more." for j in range(1 + k % 4))])

    rows = [(k, f"http://host{k % 2}.example/{k}", page(k)) for k in range(30)] + [(30, "http://host0.example/e", ""), (31, None, None)]
    got = {r["page_id"]: r for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k]["text"] == text(k) and got[k]["n_chars"] == len(text(k)) for k in range(30))
    assert got[30]["text"] == got[31]["text"] == ""
    whole = QUERIES["op7_html"](spark, SF).collect()
    assert len(whole) == table(spark, SF, "pages").count()
    assert all(r["text"] and "<p>" not in r["text"] and r["n_chars"] == len(r["text"]) for r in whole)


def test_mixing(spark):
    d = "/root/testdata/sf0.01"
    got = QUERIES["op8_mixing"](spark, d).toPandas()
    assert len(got) == table(spark, d, "documents").count() and (got["rate"] >= 0).all()
    p = np.stack(got["p"])
    assert np.allclose(p.sum(1), 1)
    domains = sorted(mixing.TARGETS)
    n = got["n_tokens"].to_numpy().astype(float)
    start, reached = (p * n[:, None]).sum(0), (p * (n * got["rate"].to_numpy())[:, None]).sum(0)
    goal = np.array([mixing.TARGETS[k] for k in domains]) * n.sum()
    assert np.abs(reached - goal).max() < 0.05 * n.sum()
    assert ((reached - goal) ** 2).sum() <= ((start - goal) ** 2).sum()


def test_lm_base(spark, docs):
    got = {r["doc_id"]: r for r in QUERIES["op9_lm"](spark, SF).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs}
    toks = {i: [*re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split(), b""] for i, t in docs}
    c = Counter(w for i, ws in toks.items() if not held[i] for w in ws)
    n = sum(c.values())
    for i, ws in toks.items():
        base = sum(np.log10((c[w] + 0.1) / (n + 0.1 * (len(c) + 1))) for w in ws)
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9, abs=1e-6)


def test_lm_learns(spark):
    """On held-out text whose next word follows from the last, the model beats the counts."""
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(12)]
    rows = [(k, " ".join(words[(s + j) % 12] for j in range(60))) for k, s in enumerate(rng.integers(0, 12, 400))]
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").toPandas()
    assert len(got) and got["score"].mean() > got["base_score"].mean() + 5


def test_joined_items(spark):
    """Items sent to all tasks and items joined give the same rows."""
    d, i = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    one, other = (sorted(map(tuple, decontaminate.leaks(d, i, broadcast_bytes=n).collect())) for n in (1 << 30, 0))
    assert one == other and one
    item = " ".join(f"w{k}" for k in range(20))
    odd = spark.createDataFrame([(None, f"x {item} y"), (1, item[:40]), (1, item[30:]), (2, item), (2, item), (3, None)], "doc_id long, text string")
    some = spark.createDataFrame([(7, item), (None, "w0 w1"), (7, item)], "item_id long, text string")
    both = [sorted((str(r) for r in decontaminate.leaks(odd, some, broadcast_bytes=n).collect())) for n in (1 << 30, 0)]
    assert both[0] == both[1] and len(both[0]) == 2 * 3 + 4
    gone = {r[0] for r in one}
    assert {r[0] for r in decontaminate.clean(d, i).select("doc_id").collect()} == {r[0] for r in d.select("doc_id").collect()} - gone


def test_vectors_that_bytes_hide(spark):
    """Links between long vectors with one large component, whose other components are less than a byte's step."""
    rng = np.random.default_rng(7)
    rest = rng.normal(size=(40, 1536))
    rest -= 0.0
    rest /= np.linalg.norm(rest, axis=1, keepdims=True)
    pairs = []
    for r in rest:  # cosine of each pair: just over the threshold
        other = 0.744 * r + np.sqrt(1 - 0.744**2) * rng.permutation(r)
        other /= np.linalg.norm(other)
        for x in (r, other):
            v = np.sqrt(1 - 0.9**2) * x
            v[0] = 0.9
            pairs.append(v / np.linalg.norm(v))
    x = np.array(pairs)
    cosine = x @ x.T - 2 * np.eye(len(x))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(df).collect()}
    assert got == {i: int((row >= 0.95).sum()) for i, row in enumerate(cosine)} and sum(got.values()) > 40


def test_lines_cut(spark):
    a, b = "the first line has five words", "another line that has six words"
    df = spark.createDataFrame([(1, f"{a}\n{b}"), (2, f"{b.upper()}\nshort line\n{a}  "), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["removed_spans"]) for r in lines.without_units(df, "line", run_words=5).collect()}
    assert got == {1: (f"{a}\n{b}", []), 2: ("short line\n", ["0:32", "43:74"]), 3: (None, [])}
    assert lines.without_units(df, "line", run_words=7).where("size(removed_spans) > 0").count() == 0


def test_frequent_units(spark, monkeypatch):
    """Digests that are sent to the units give the same rows as those that are joined."""
    df = table(spark, SF, "documents")
    want = sorted(map(tuple, lines.repeated_units(df).collect()))
    monkeypatch.setattr(lines, "FREQUENT", 1e9)
    assert want and sorted(map(tuple, lines.repeated_units(df).collect())) == want


def test_runs_of_units(spark):
    """Sentences repeated in a row count together; rows of one id and text do not count twice."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(12)) + "." for x in "xyz")
    df = spark.createDataFrame([(1, f"{a} {b} {c}"), (2, f"New words. {a} {b}\n{c} More."), (3, f"{a} {b} other {c}"), (4, f"{a} {b}"), (4, f"{a} {b}"), (None, f"{c} {b} {a}")], "doc_id long, text string")
    got = lines.repeated_units(df).collect()
    assert sorted((r["doc_id"] or 0, r["unit"]) for r in got) == [(0, 0), (0, 1), (0, 2), (2, 1), (2, 2), (2, 3)]
    assert sorted((r["doc_id"] or 0) for r in lines.repeated_units(df, run_words=24).collect()) == [0, 0, 0, 2, 2, 2, 3, 3, 4, 4, 4, 4]


# Nulls, empty and long texts, ties, repeated rows, empty tables, columns with clashing names

NAMES = "id t fp h n p w ord rank unit at _id _gone _t _base _tokens _spans rate row component word c uid others lang_pred removed_spans".split()
LONG = "some words of a very long text that goes on and on " * 20_000
ROWS = [(1, None), (2, ""), (3, "a tie of five words here"), (4, "a tie of five words here"), (4, "a tie of five words here"), (None, "a row that has no id"), (None, None), (5, LONG), (6, "\x00 \t\n"), (7, "12 34 ---"), (8, "ünïcödé wörds in a text 日本語")]


@pytest.fixture(scope="module")
def odd(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, t, "en" if k % 2 else None, None, None) for k, (i, t) in enumerate(ROWS)], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(None).cast("string").alias(n) for n in NAMES])


def labels(spark):
    return spark.createDataFrame([(3, 1, 0), (4, 0, 0), (5, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")


def items(spark):
    return spark.createDataFrame([(1, "a tie of five words here"), (2, None), (3, ""), (None, "zwei")], "item_id long, text string")


ALL = {
    "lines": lambda s, d: lines.repeated_units(d, run_words=5), "cut": lambda s, d: lines.without_units(d), "simhash": lambda s, d: simhash.near_duplicates(d), "keep_one": lambda s, d: simhash.keep_one(d),
    "suffixes": lambda s, d: suffixes.repeated_bytes(d), "kept": lambda s, d: suffixes.without_repeats(d), "secrets": lambda s, d: secrets.secrets(d), "digest": lambda s, d: secrets.digest(d), "redact": lambda s, d: secrets.redact(d),
    "langid": lambda s, d: langid.predict(d), "identified": lambda s, d: langid.keep_identified(d), "mix": lambda s, d: mixing.mix(d, mixing.domain_labels(labels(s)), mixing.TARGETS), "rated": lambda s, d: mixing.keep_rated(d, mixing.domain_labels(labels(s))),
    "lm": lambda s, d: lm.score(d), "leaks": lambda s, d: decontaminate.leaks(d, items(s)), "clean": lambda s, d: decontaminate.clean(d, items(s)),
}
#: Rows of the odd table that each one returns; None: any number.
WANT = {"lines": 2, "keep_one": 7, "identified": 6, "rated": None, "leaks": 3, "clean": 8}


@pytest.mark.parametrize("name", sorted(ALL))
def test_odd_rows(spark, odd, name):
    got = ALL[name](spark, odd).collect()
    want = WANT.get(name, len(ROWS))
    assert want is None or len(got) == want


@pytest.mark.parametrize("name", sorted(ALL))
def test_empty_table(spark, odd, name):
    assert ALL[name](spark, odd.limit(0)).count() == 0


def test_odd_vectors_and_pages(spark):
    kind = "vec_id long, embedding array<float>, id long, unit string, v string, n int"
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, 0.0]), (4, [1.0, 0.0]), (None, [1.0, 0.01]), (5, [1.0]), (6, [float("inf"), 1.0])]
    got = embeddings.near_duplicates(spark.createDataFrame([(*r, None, None, None, None) for r in rows], kind)).collect()
    assert sorted((r[1], r[2]) for r in got if r[0] == 4) == [(2, 4), (2, 4)] and len(got) == len(rows)
    assert embeddings.near_duplicates(spark.createDataFrame([], kind)).count() == 0
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.001]), (3, [0.0, 1.0, 0.0]), (4, [0.0, 1.0, 0.001]), (5, [1.0, 0.0, 0.0, 0.0])]
    got = embeddings.near_duplicates(spark.createDataFrame([(*r, None, None, None, None) for r in rows], kind)).collect()
    assert sorted((r[0], r[1], r[2]) for r in got) == [(1, 1, 1), (2, 1, 1), (3, 1, 3), (4, 1, 3), (5, 0, 5)]  # each length by itself
    kind = "page_id long, url string, html string, host string, main string, text string"
    rows = [(1, None, None), (None, "not a url", "<p>x"), (2, "http://[bad", "plain text"), (2, "http://[bad", "plain text"), (3, "http://a/", "<div>" * 3000 + "deep" + "<b>" * 10)]
    got = pages.main_text(spark.createDataFrame([(*r, None, None, None) for r in rows], kind)).collect()
    assert sorted(r["text"] for r in got) == ["", "deep", "plain text", "plain text", "x"]
    assert pages.main_text(spark.createDataFrame([], kind)).count() == 0
