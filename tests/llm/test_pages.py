"""Templates against a brute-force version, split articles, markup that is left open."""

import time
from collections import Counter, defaultdict

import numpy as np

from cairn.llm import pages
from cairn.llm.common import table

KIND = "page_id long, url string, html string"


def templates_brute(rows):
    """host: (main, fixed), by whole occurrence vectors."""
    hosts = defaultdict(list)
    for page, url, source in rows:
        hosts[pages.host_of(url)].append((page, *pages.blocks(source)))
    out = {}
    for host, all_ in hosts.items():
        vectors, chars, depth, texts = defaultdict(list), Counter(), {}, set()
        for page, tree, found in all_:
            for p, (n, _, d) in tree.items():
                vectors[p].append((page, n))
                depth[p] = d
            for p, aside, t in found:
                while not aside:  # every element that the block is in
                    chars[p] += len(t)
                    if p == pages.ROOT:
                        break
                    p = tree[p][1]
            for t, n in Counter(pages._hash(p, t) for p, _, t in found).items():
                vectors[t].append((page, n))
                texts.add(t)
        classes = defaultdict(list)
        for token, v in vectors.items():
            if len(v) >= max(pages.LEAST_PAGES, pages.LEAST_SHARE * len(all_)):
                classes[tuple(sorted(v))].append(token)
        valid = [c for c in classes.values() if sum(1 if t in texts else 2 for t in c) >= 2]
        fixed = {t for c in valid for t in c if t in texts and len(vectors[t]) >= max(pages.TEXT_PAGES, pages.TEXT_SHARE * len(all_))}
        inside = [p for p in depth if chars[p] > 0 and chars[p] >= pages.MAIN_SHARE * chars[pages.ROOT]]
        out[host] = (max(inside, key=lambda p: (depth[p], chars[p], p)) if inside else None, fixed)
    return out


def made(rng, k):
    parts = "".join(f"<div class='c{rng.integers(3)}'><p>word {rng.integers(50)} of {k}</p>Fixed {rng.integers(2)}</div>" for _ in range(rng.integers(0, 6)))
    return f"<body><h2>Always here</h2><h3>And this</h3><section>{parts}</section><footer>Foot {k % 2}</footer></body>"


def test_templates_brute(spark):
    rng = np.random.default_rng(4)
    rows = [(k, f"https://h{k % 3 if k < 60 else 3 + k % 4}.example/{k}", made(rng, k)) for k in range(80)] + [(80, None, None), (81, "https://h0.example/", "")]
    rows += [tuple(r) for r in table(spark, "/root/testdata/sf0.001", "pages").select("page_id", "url", "html").collect()]
    got = {r["host"]: (r["main"], set(r["fixed"] or ())) for r in pages.templates(spark.createDataFrame([(i, u, h) for i, (_, u, h) in enumerate(rows)], "page long, url string, html string")).collect()}
    want = {h: x for h, x in templates_brute([(i, u, h) for i, (_, u, h) in enumerate(rows)]).items() if x[0] is not None}
    assert got == want and any(fixed for _, fixed in got.values())


def test_split_articles(spark):
    """An article in several parts comes whole and in order; texts that all pages share go."""

    def page(k):
        return f"""<body><nav><a href=/>Home {k}</a></nav><div id=wrap><h4>Read more stories on this site</h4><article><h1>Title {k}</h1><section class=intro><p>Lead of {k} in some words.</p></section>
            <section class=body><p>{f"Long part of {k}. " * 12}</p><ul><li>One {k}<li>Two {k}</ul></section><p>The end of {k}.</p></article></div><aside>Other {k}</aside></body>"""

    def text(k):
        return "\n".join([f"Title {k}", f"Lead of {k} in some words.", (f"Long part of {k}. " * 12).strip(), f"One {k}", f"Two {k}", f"The end of {k}."])

    rows = [(k, f"http://{'big' if k < 12 else 'small'}.example/{k}", page(k)) for k in range(14)]
    got = {r["page_id"]: r["text"] for r in pages.main_text(spark.createDataFrame(rows, KIND)).collect()}
    assert got == {k: text(k) for k in range(14)}


def test_joined_templates(spark, monkeypatch):
    """Templates that are sent and templates that are joined give the same rows."""
    df = table(spark, "/root/testdata/sf0.001", "pages")
    want = sorted(map(tuple, pages.main_text(df).collect()))
    monkeypatch.setattr(pages, "BROADCAST_NUMBERS", 0)
    assert want and sorted(map(tuple, pages.main_text(df).collect())) == want


def test_open_markup():
    """Depth, open quotes, open comments and stray ends take time in proportion to the page."""
    start = time.monotonic()
    tree, found = pages.blocks("<div>" * 50_000 + "deep" + "</i></q></section></div>" * 50_000)
    assert len(tree) == 50_001 and [t for *_, t in found] == ["deep"]
    assert pages.choose("<div>" * 50_000 + "deep", None, set()) == "deep"
    assert [t for *_, t in pages.blocks('<a "' * 200_001 + "<p>after</p>")[1]] == ["after"]
    for open_ in ("<div class='", "<!-- ", "<!x ", "<? ", "<", "<script>", "<p title=\"", "&", "</"):
        pages.blocks(open_ * 100_000)
    assert [t for *_, t in pages.blocks("a < b <p title='x>y'>c</p><!-- no")[1]] == ["a < b", "c"]
    assert time.monotonic() - start < 60
