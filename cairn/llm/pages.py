"""Main text of web pages by equivalence-class template deduction.

Tokens are elements, named by their path, and texts of blocks. On the pages of one host,
tokens with the same occurrence vector (how often on which page) form a class; an element
counts as two tokens, its start and its end. A class is valid if it holds two tokens or
more and covers enough of the host's pages. An element is on every page that anything in
it is on, so valid classes nest by path: they are the host's template. Texts of valid
classes are fixed by it; all others fill its slots. The main region is the innermost
element of the template that has MAIN_SHARE of the characters in slots, menus, adverts
and the like aside, and a page's text is what fills all slots in that region, in page
order. Vectors are compared by a sum of hashes over pages and counts, so a host of any
number of pages is aggregated, never gathered.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import cut

NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: What follows a tag's name: quotes may hold the sign that ends it.
REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
LABEL = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "label"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements, and words of classes, ids and roles, that are not the article.
ASIDE_TAGS = {"nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "head"}
ASIDE_WORDS = set(
    "ad ads advert adverts advertisement alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies dialog disclaimer footer header login menu modal"
    " nav navbar navigation newsletter notice notices popup promo related search share sharing sidebar social sponsor sponsored subscribe widget".split()
)
MAIN_WORDS = set("article body content entry main post story".split())
#: A class's least pages and share of its host's pages; of texts in slots' places, more.
LEAST_PAGES, LEAST_SHARE, TEXT_PAGES, TEXT_SHARE = 5, 0.5, 10, 0.9
#: Share of the characters in slots that the main region holds.
MAIN_SHARE = 0.8
#: Templates of at most so many numbers (8 MB) are sent to every task; beyond, pages are joined with them.
BROADCAST_NUMBERS = 1_000_000
#: Hosts of at most so many (27 MB, as a host has 253 characters at most) are sent with their sizes.
BROADCAST_HOSTS = 100_000
ROOT = 0


def _label(tag: str, attributes: str) -> tuple[str, bool]:
    """An element's name in paths, with its class and id, and whether it stands aside."""
    words: list[str] = []
    for m in LABEL.finditer(attributes):
        words += re.findall("[a-z]+", (m[2] or m[3] or m[4] or "").lower())
    aside = tag in ASIDE_TAGS or bool(ASIDE_WORDS & set(words)) and not MAIN_WORDS & set(words)
    return ".".join([tag, *sorted(set(words))]), aside


def _hash(*parts: object) -> int:
    return xxhash.xxh64_intdigest("\0".join(map(str, parts)).encode("utf-8", "surrogatepass")) - (1 << 63)


def blocks(page: str | None) -> tuple[dict[int, list[int]], list[tuple[int, bool, str]]]:
    """(path of each element: [how often, path of its container, depth], containers first;
    (path of the container, aside, text) of each block in page order). A path is a hash of
    the labels down to the element; inline elements are left out, and paragraphs as
    containers. In time linear in the page, whatever is left open in it."""
    page = page or ""
    tree: dict[int, list[int]] = {ROOT: [1, ROOT, 0]}
    out: list[tuple[int, bool, str]] = []
    stack: list[tuple[str, int, bool]] = []  # tag, path, aside
    within: Counter = Counter()  # tags on the stack
    text: list[str] = []
    at, loose = 0, False

    def flush() -> None:
        plain = " ".join("".join(text).split())
        text.clear()
        if plain:
            out.append((stack[-1][1] if stack else ROOT, bool(stack) and stack[-1][2], plain))

    def pop() -> str:
        tag = stack.pop()[0]
        within[tag] -= 1
        return tag

    while (start := page.find("<", at)) >= 0:
        text.append(html.unescape(page[at:start]))
        name = NAME.match(page, start)
        if not name:
            if page.startswith(("<!", "<?"), start):
                mark = "-->" if page.startswith("<!--", start) else ">"
                end = page.find(mark, start)
                at = end + len(mark) if end >= 0 else len(page)
            else:
                text.append("<")
                at = start + 1
            continue
        rest = None if loose else REST.match(page, name.end())
        loose = rest is None  # a quote stays open to the page's end: quotes count no more
        end = page.find(">", name.end()) + 1 if loose else rest.end()
        at = end or len(page)
        tag, attributes = name[2].lower(), page[name.end() : at - 1]
        if tag in INLINE:
            continue
        if tag == "br" or tag == "wbr":
            text.append(" " if tag == "br" else "")
            continue
        flush()
        if name[1]:
            if within[tag]:
                while pop() != tag:
                    pass
            continue
        if stack and stack[-1][0] == "p":  # a paragraph ends where another block begins
            pop()
        while stack and stack[-1][0] in CLOSES.get(tag, ()):
            pop()
        label, aside = _label(tag, attributes)
        _, over, was = stack[-1] if stack else ("", ROOT, False)
        path = _hash(over, label)
        tree.setdefault(path, [0, over, tree[over][2] + 1])[0] += 1
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = close.end() if close else len(page)
        elif tag not in VOID and not attributes.endswith("/"):
            stack.append((tag, over if tag == "p" else path, was or aside))
            within[tag] += 1
    text.append(html.unescape(page[at:]))
    flush()
    return tree, out


def _held(tree: dict[int, list[int]], found: list[tuple[int, int]]) -> Counter:
    """Characters inside each path, given (path, characters) of blocks."""
    held: Counter = Counter()
    for path, n in found:
        held[path] += n
    for path in reversed(tree):
        if path != ROOT:
            held[tree[path][1]] += held[path]
    return held


def host_of(url: str | None) -> str:
    try:
        host = urlsplit(url or "").hostname or ""
        return host if len(host) <= 253 else ""
    except ValueError:
        return ""


def page_tokens(pages: DataFrame) -> DataFrame:
    """(host, page, path, token, n, depth, chars) of pages' (page, url, html): elements, with the
    characters inside them that are not aside; blocks' texts by hash, with a null path."""

    def run(batches):
        for batch in batches:
            rows = []
            for page, url, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                host, (tree, found) = host_of(url), blocks(source)
                held = _held(tree, [(p, len(x)) for p, aside, x in found if not aside])
                rows += ((host, page, p, p, n, depth, held[p]) for p, (n, _, depth) in tree.items())
                rows += ((host, page, None, t, n, 0, 0) for t, n in Counter(_hash(p, x) for p, _, x in found).items())
            kinds = [pa.string(), *[pa.int64()] * 6]
            cols = [*zip(*rows, strict=True)] or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["host", "page", "path", "token", "n", "depth", "chars"])

    return pages.mapInArrow(run, "host string, page long, path long, token long, n long, depth long, chars long")


def templates(pages: DataFrame) -> DataFrame:
    """(host, main, fixed): path of the main region; hashes of texts that the template fixes."""
    vector = F.sum(F.xxhash64("page", "n").cast("decimal(38,0)")).alias("vector")
    seen = cut(page_tokens(pages).groupBy("host", "path", "token").agg(F.count("*").alias("pages"), vector, F.sum("chars").alias("chars"), F.min("depth").alias("depth")))
    whole = cut(seen.where((F.col("path") == ROOT)).select("host", F.col("pages").alias("of"), F.col("chars").alias("total")))
    whole = F.broadcast(whole) if whole.count() <= BROADCAST_HOSTS else whole
    # Texts of one page, as most are, go before anything is dealt by host.
    enough = seen.where(F.col("pages") >= LEAST_PAGES).join(whole, "host").where(F.col("pages") >= LEAST_SHARE * F.col("of"))
    size = F.sum(F.when(F.col("path").isNull(), 1).otherwise(2))
    classes = enough.groupBy("host", "vector").agg(size.alias("tokens")).where("tokens >= 2")
    fixed = enough.where(F.col("path").isNull() & (F.col("pages") >= TEXT_PAGES) & (F.col("pages") >= TEXT_SHARE * F.col("of")))
    fixed = fixed.join(classes, ["host", "vector"], "left_semi").groupBy("host").agg(F.sort_array(F.collect_set("token")).alias("fixed"))
    inside = seen.where(F.col("path").isNotNull() & (F.col("chars") > 0)).join(whole, "host").where(F.col("chars") >= MAIN_SHARE * F.col("total"))
    main = inside.groupBy("host").agg(F.max_by("path", F.struct("depth", "chars", "path")).alias("main"))
    return main.join(fixed, "host", "left")


def choose(source: str | None, main: int | None, fixed: set[int]) -> str:
    """What fills the page's slots in the main region, in page order. Of a page that has nothing
    there: in its own innermost element with MAIN_SHARE of its characters in slots."""
    tree, found = blocks(source)
    free = [(p, t) for p, aside, t in found if not aside and (not fixed or _hash(p, t) not in fixed)]

    def within(top: int) -> list[str]:
        inside = {top}
        for p, (_, over, _) in tree.items():
            if over in inside:
                inside.add(p)
        return [t for p, t in free if p in inside]

    got = within(main) if main in tree else []
    if not got and free:
        held = _held(tree, [(p, len(t)) for p, t in free])
        got = within(max((p for p in tree if held[p] >= MAIN_SHARE * held[ROOT]), key=lambda p: (tree[p][2], held[p], p)))
    return "\n".join(got)


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of pages (page_id, url, html; other columns
    are not read).

    Null and empty html: empty text. Null urls, and urls without a host, are one host.
    Hosts of fewer than TEXT_PAGES pages have no fixed texts; their main region is found
    alike. Repeated rows count as pages of their own. Empty table: no rows.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    found = cut(templates(rows.select(F.coalesce("page_id", F.lit(-1)).alias("page"), "url", "html")))
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    host = F.when(F.length(host) <= 253, host).otherwise("")
    small = (found.agg(F.sum(F.greatest(F.size("fixed"), F.lit(0)) + 2)).first()[0] or 0) <= BROADCAST_NUMBERS
    both = rows.withColumn("host", host).join(F.broadcast(found) if small else found, "host", "left")

    def run(batches):
        kept: dict = {}
        for batch in batches:
            out = []
            ids, urls, sources, hosts, mains = (batch.column(i).to_pylist() for i in range(5))
            for i, h in enumerate(hosts):
                if h not in kept:
                    if len(kept) > 1000:
                        kept.clear()
                    kept[h] = set(batch.column(5)[i].as_py() or ())
                out.append(choose(sources[i], mains[i], kept[h]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return both.select("page_id", "url", "html", "host", "main", "fixed").mapInArrow(run, "page_id long, url string, text string, n_chars long")
