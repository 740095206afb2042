"""Substring deduplication by a distributed difference-cover suffix sort.

Every byte that lies in a string of WIDTH bytes which also starts earlier is removed.

1. Parsing. Each window of WIDTH bytes has an anchor, the leftmost of its GRAM-byte
   strings with the least hash, so equal windows have equal anchors. The windows of one
   anchor in a row are a phrase; a phrase's context is all their bytes. Phrases are dealt
   by anchor into buckets, of each task one row of arrays for each bucket, without those
   that a task has seen already. Windows of an anchor that has one context anywhere can equal
   only the same windows of that context; so of each context the first occurrence stands
   for all, and only anchors with several contexts leave open which of their windows are
   equal. Windows that start up to PIECE bytes apart before one anchor share a piece of
   WIDTH - PIECE + 1 bytes; those whose piece has no equal are no one's, and the others of
   the first occurrences of those contexts are the dictionary.
2. Suffix sort of the dictionary: the places whose number is 1 or 2 modulo 3 are the
   sample. Its suffixes are sorted by their first WIDTH bytes, which is as deep as windows
   go, and named by their rank, so no names are left to sort by recursion; the other
   suffixes are merged in by their first byte and the rank behind it (against class 1), or
   first two and the rank behind them (against class 2).
3. Neighbours in the merged order whose WIDTH-byte prefixes are equal are one string; all
   but its first occurrence are removed.

Sorts are range-partitioned, names and ranks are ids that ascend over sorted partitions,
and only one row for each partition of a sort reaches the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import Scratch, cut

WIDTH, GRAM, PIECE = 100, 56, 9
#: Bytes of a region behind the start of its last window: suffixes one and two behind it are ranked too.
DEEP = WIDTH + 2
#: Bytes of text that are hashed at once, at least one document; few, as a dozen arrays of longs are made of them.
CHUNK = 1 << 17
#: Phrases that a task deals at once; buckets at least, and phrases in a bucket about, if that takes more.
BLOCK, BUCKETS, BUCKET = 400_000, 1024, 2_000_000
#: One of so many documents is looked through for frequent anchors: those that more than one of FREQUENT phrases have.
LOOK, FREQUENT = 32, 2000
_RNG = np.random.default_rng(20)
_VALUE = _RNG.integers(0, 1 << 64, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_POWERS: dict[int, np.ndarray] = {}  # in each task, of the bases so far, for two chunks


def _powers(base: int, n: int) -> np.ndarray:
    if n <= 2 * CHUNK and base in _POWERS:
        return _POWERS[base][: n + 1]
    powers = np.full(max(n, 2 * CHUNK) + 1, base, np.uint64)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    if n <= 2 * CHUNK:
        _POWERS[base] = powers
    return powers[: n + 1]


class Hashes:
    """Polynomial hashes of any substrings of one buffer."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        powers, inverse = (_powers(b, n) for b in (_BASE, _INVERSE))
        self.inverse = inverse
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUE[data] * powers[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def all(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return (self.sums[width:] - self.sums[:n]) * self.inverse[:n]


def phrases(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor hash, context hash, document, first window's place in it, windows, bytes from there
    to the anchor) of each phrase of the documents that end at ends in data."""
    starts = np.r_[0, ends[:-1]]
    if len(data) < WIDTH:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    hashes = Hashes(data)
    grams = _mix(hashes.all(GRAM))
    place = np.arange(len(grams), dtype=np.uint64)
    least = (grams >> np.uint64(24) << np.uint64(24)) | place
    size, span = 1, WIDTH - GRAM + 1
    while size * 2 <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < span:
        least = np.minimum(least[: len(least) - (span - size)], least[span - size :])
    n = len(data) - WIDTH + 1
    anchor = (least[:n] & np.uint64((1 << 24) - 1)).astype(np.int64)
    doc = np.repeat(np.arange(len(ends)), ends - starts)[:n]
    valid = np.arange(n) + WIDTH <= ends[doc]
    new = np.ones(n, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new & valid)
    if not len(first):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    stop = np.minimum(np.r_[np.flatnonzero(new), n][np.searchsorted(np.flatnonzero(new), first, side="right")], ends[doc[first]] - WIDTH + 1)
    context = _mix(hashes.of(first, stop - 1 + WIDTH) ^ (stop - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return grams[anchor[first]].view(np.int64), context.view(np.int64), doc[first], first - starts[doc[first]], stop - first, anchor[first] - first


def _chunks(texts: list[bytes]):
    """(offset in texts, texts) of chunks of CHUNK bytes at most unless one text is longer."""
    lo = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield lo, texts[lo:k]
            lo, size = k, 0
        size += len(t)
    if lo < len(texts):
        yield lo, texts[lo:]


def _long_text(text: bytes):
    """Pieces of a text of any length as (offset, piece), overlapping by a window less one."""
    step = (1 << 20) - WIDTH
    for at in range(0, max(1, len(text) - WIDTH + 1), step):
        yield at, text[at : at + step + WIDTH - 1]


def _found(batches):
    """Of documents (ord, t), a chunk at a time: anchor, context, ord, first window's place, windows and
    bytes from there to the anchor of their phrases."""
    for batch in batches:
        ords, texts = batch.column(0).to_numpy(zero_copy_only=False), [x or b"" for x in batch.column(1).to_pylist()]
        for lo, some in _chunks(texts):
            pieces = [(lo + k, at, p) for k, t in enumerate(some) for at, p in _long_text(t)]
            for part in (pieces,) if len(pieces) == len(some) else ([p] for p in pieces):
                data = np.frombuffer(b"".join(p for *_, p in part), np.uint8)
                g, c, d, at, w, back = phrases(data, np.cumsum([len(p) for *_, p in part]))
                if len(d):
                    yield g, c, ords[np.array([i for i, *_ in part])[d]], at + np.array([o for _, o, _ in part])[d], w, back


def occurrences(docs: DataFrame) -> DataFrame:
    """(anchor, ctx, ord, at, windows, back) of docs' (ord, t): one row for each phrase."""
    names = ["anchor", "ctx", "ord", "at", "windows", "back"]

    def run(batches):
        for cols in _found(batches):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names)

    return docs.select("ord", "t").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _shared(anchor: np.ndarray, ctx: np.ndarray, ord_: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(their numbers, which are the first of their context, which have an anchor of several contexts)
    of the phrases whose anchor another one has."""
    by = np.argsort(anchor)
    same = anchor[by[1:]] == anchor[by[:-1]]
    by = by[np.r_[same, False] | np.r_[False, same]] if len(by) else by
    by = by[np.lexsort((at[by], ord_[by], ctx[by], anchor[by]))]
    a, c = anchor[by], ctx[by]
    new = np.r_[True, a[1:] != a[:-1]][: len(by)]
    first = new | np.r_[True, c[1:] != c[:-1]][: len(by)]
    return by, first, np.bincount(np.cumsum(new) - 1, first)[np.cumsum(new) - 1] > 1 if len(by) else new


#: A bucket's phrases of one block. Windows below zero: known to come later than an equal phrase.
_DEALT = [("anchor", pa.int64()), ("ctx", pa.int64()), ("ord", pa.int64()), ("at", pa.int32()), ("windows", pa.int8()), ("back", pa.int8())]


def _dealer(bits: int, frequent: np.ndarray):
    """A function from documents (ord, t) to (bucket, arrays of phrases): all of an anchor in one bucket,
    or all of a context where the anchor is one of frequent, which are sorted."""

    def deal(parts: list[tuple]):
        anchor, ctx, ord_, at, windows, back = (np.concatenate(x) for x in zip(*parts, strict=True))
        by, first, _ = _shared(anchor, ctx, ord_, at)
        again = np.sort(by[~first])
        key = _mix(anchor.view(np.uint64))  # anchors are least hashes, so small ones are many
        if len(frequent):
            often = frequent[np.minimum(np.searchsorted(frequent, anchor), len(frequent) - 1)] == anchor
            key[often] = _mix(key[often] ^ _mix(ctx[often].view(np.uint64)))
        bucket = (key >> np.uint64(64 - bits)).astype(np.int64)
        bucket[again] = (np.arange(len(again)) << bits) // max(1, len(again))
        anchor[again] = ctx[again] = 0
        windows[again] *= -1
        order = np.argsort(bucket, kind="stable")
        start = np.flatnonzero(np.r_[True, np.diff(bucket[order]) > 0])
        offsets = pa.array(np.r_[start, len(order)].astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x[order].astype(t.to_pandas_dtype()), t)) for x, (_, t) in zip((anchor, ctx, ord_, at, windows, back), _DEALT, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[order][start].astype(np.int32)), *lists], ["bucket", *(n for n, _ in _DEALT)])

    def run(batches):
        parts: list[tuple] = []
        n = 0
        for cols in _found(batches):
            parts.append(cols)
            n += len(cols[0])
            if n >= BLOCK:
                yield deal(parts)
                parts, n = [], 0
        if parts:
            yield deal(parts)

    return run


def _marker(frequent: np.ndarray):
    """A function from what a _dealer gives, sorted by bucket, to (ord, at, windows, back, is_first): the
    phrases that have an earlier equal, and the first ones of contexts of anchors with several."""

    def mark(parts: list[list[np.ndarray]]):
        anchor, ctx, ord_, at, windows, back = (np.concatenate(x) for x in zip(*parts, strict=True))
        known = np.flatnonzero(windows < 0)
        left = np.flatnonzero(windows > 0)
        by, first, several = _shared(anchor[left], ctx[left], ord_[left], at[left])
        opened = np.zeros(len(left), bool)
        opened[by] = first & several
        if len(frequent):  # theirs are in several buckets; of one context or not, their windows are compared
            opened |= frequent[np.minimum(np.searchsorted(frequent, anchor[left]), len(frequent) - 1)] == anchor[left]
            opened[by[~first]] = False
        gone, kept = np.r_[known, left[by[~first]]], left[opened]
        rows = np.r_[gone, kept]
        cols = (ord_[rows], at[rows], np.abs(windows[rows].astype(np.int64)), back[rows].astype(np.int64))
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in cols), pa.array(np.arange(len(rows)) >= len(gone))], ["ord", "at", "windows", "back", "is_first"])

    def run(batches):
        parts: list[list[np.ndarray]] = []
        bucket = None
        for batch in batches:
            buckets = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.r_[True, np.diff(buckets) != 0, True]) if len(buckets) else np.zeros(0, int)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if parts and buckets[a] != bucket:
                    yield mark(parts)
                    parts = []
                bucket = buckets[a]
                # copies: a batch goes once it is read
                parts.append([batch.column(k).slice(a, b - a).flatten().to_numpy().copy() for k in range(1, 7)])
        if parts:
            yield mark(parts)

    return run


def marked_phrases(docs: DataFrame, tables: Scratch) -> DataFrame:
    """(ord, at, windows, back, is_first) of docs (ord, t): phrases with an earlier equal, not is_first;
    the first phrases of contexts whose windows may be equal to others', is_first."""
    some = occurrences(docs.where(F.pmod(F.xxhash64("ord"), F.lit(LOOK)) == 0)).groupBy("anchor").agg(F.count("*").alias("n"))
    some = tables.write(some, "anchors")
    total = some.agg(F.sum("n")).first()[0] or 0
    frequent = np.sort(np.array([r[0] for r in some.where(F.col("n") > max(4, total / FREQUENT)).select("anchor").collect()], np.int64))  # FREQUENT at most
    tables.drop("anchors")
    bits = max(BUCKETS, total * LOOK // BUCKET).bit_length() - 1
    kinds = "bucket int, anchor array<bigint>, ctx array<bigint>, ord array<bigint>, at array<int>, windows array<tinyint>, back array<tinyint>"
    dealt = docs.select("ord", "t").mapInArrow(_dealer(bits, frequent), kinds).repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(_marker(frequent), "ord long, at long, windows long, back long, is_first boolean")


def _strings(parts: list[np.ndarray]) -> pa.Array:
    """Rows of bytes, one width for all, as an Arrow array."""
    rows = np.concatenate(parts) if parts else np.zeros((0, 0), np.uint8)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _cuts(batches):
    """Of regions (rid, windows, text): (rid, o, s) of the sampled suffixes, cut at WIDTH bytes."""
    for batch in _slices(batches):
        rids, places, strings = [], [], []
        for rid, m, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            at = np.arange(m + 2)
            at = at[at % 3 > 0]
            strings.append(np.lib.stride_tricks.sliding_window_view(np.frombuffer(text + bytes(DEEP), np.uint8), WIDTH)[at])
            rids.append(np.full(len(at), rid))
            places.append(at)
        if rids:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rids), pa.int64()), pa.array(np.concatenate(places), pa.int64()), _strings(strings)], ["rid", "o", "s"])


def _own(batches):
    """Of regions (rid, windows, text, ranks): of each window's suffix its first byte, its first two,
    its prefix, its own rank (-1 for none) and those one and two bytes behind it."""
    names = ["rid", "o", "one", "two", "prefix", "kind", "rank", "r1", "r2"]
    for batch in _slices(batches):
        cols: list[list[np.ndarray]] = [[] for _ in names]
        for k, (rid, m, text) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True)):
            data, at = np.frombuffer(text + bytes(DEEP), np.uint8), np.arange(m)
            ranks = np.full(m + 2, -1)
            flat = batch.column(3)[k].values
            ranks[flat.field(0).to_numpy()] = flat.field(1).to_numpy()
            one = data[: m + 1].astype(np.int64)
            parts = (np.full(m, rid), at, one[:m], one[:m] << 8 | one[1:], _mix(Hashes(data).of(at, at + WIDTH)).view(np.int64), at % 3, ranks[:m], ranks[1 : m + 1], ranks[2:])
            for col, part in zip(cols, parts, strict=True):
                col.append(part)
        if cols[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in cols], names)


def _matrix(column: pa.Array) -> np.ndarray:
    """The bytes of a column of longs, or of strings of one length, as one row each."""
    if pa.types.is_integer(column.type):
        return np.ascontiguousarray(column.to_numpy(zero_copy_only=False)).view(np.uint8).reshape(-1, 8)
    size = len(column[0].as_py())
    start = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], np.uint8)[start : start + len(column) * size].reshape(-1, size)


def _runs(rows: DataFrame, key: str, order: list[str], tables: Scratch, name: str, alone: bool = True) -> DataFrame:
    """(run, rid, o) of rows sorted by order, equal keys in a row being one run; run ascends.

    alone: whether rows whose key no neighbour has are returned. Runs may cross partitions,
    so no key fills a task.
    """
    names = ["run", "rid", "o", "part", "first", "last"]

    def number(batches):
        kept: list = [None, None, -1, False]  # the last row's key, the row, its run, whether it goes out
        first = part = None

        def out(run, rid, o):
            return pa.RecordBatch.from_arrays([pa.array(run, pa.int64()), pa.array(rid, pa.int64()), pa.array(o, pa.int64()), *[pa.nulls(len(run), t) for t in (pa.int64(), pa.binary(), pa.binary())]], names)

        for batch in batches:
            if not len(batch):
                continue
            keys = _matrix(batch.column(0))
            rid, o = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            if part is None:
                first, part = keys[0].tobytes(), int(batch.column(3)[0].as_py())
            same = np.r_[kept[0] is not None and keys[0].tobytes() == kept[0], (keys[1:] == keys[:-1]).all(1)]
            run = kept[2] + np.cumsum(~same)
            if kept[0] is not None and (kept[3] or same[0]):
                yield out([(part << 33) + kept[2]], [kept[1][0]], [kept[1][1]])
            goes = same | np.r_[same[1:], False] | (run == 0) | alone
            yield out(((part << 33) + run[:-1])[goes[:-1]], rid[:-1][goes[:-1]], o[:-1][goes[:-1]])
            kept = [keys[-1].tobytes(), (int(rid[-1]), int(o[-1])), int(run[-1]), bool(goes[-1])]
        if part is not None:  # the last row, and the partition's number of runs with its first and last key
            yield out([(part << 33) + kept[2]], [kept[1][0]], [kept[1][1]])
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((kept[2] + 1, -1, -1, part, first, kept[0]), (*[pa.int64()] * 4, pa.binary(), pa.binary()), strict=True)], names)

    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(key, "rid", "o", F.spark_partition_id().cast("long").alias("part"))
    placed = tables.write(sorted_.mapInArrow(number, "run long, rid long, o long, part long, first binary, last binary"), name)
    inherit: list[tuple[int, int]] = []  # the first run of a partition that goes on with the last one's
    before, run_of = None, -1
    for part, first, last, runs in sorted(map(tuple, placed.where("rid = -1").select("part", "first", "last", "run").collect())):
        same = before is not None and first == before
        if same:
            inherit.append((part << 33, run_of))
        run_of = (run_of if same else part << 33) if runs == 1 else (part << 33) + runs - 1
        before = last
    sent = F.broadcast(rows.sparkSession.createDataFrame(inherit, "run long, whole long"))  # one row for each partition at most
    return placed.where("rid >= 0").join(sent, "run", "left").select(F.coalesce("whole", "run").alias("run"), "rid", "o")


def _before(rows: DataFrame, tables: Scratch, name: str) -> DataFrame:
    """Of rows (key, behind, kind, rid, o, rank, prefix), sorted by key and behind: for those of kind 0,
    the rank of the last sampled row before them, as pred, and their own place in the order."""
    by = ["key", "behind", "kind", "rid", "o"]
    sorted_ = rows.repartitionByRange(*by).sortWithinPartitions(*by).select("kind", "rid", "o", "rank", "prefix", F.spark_partition_id().cast("long").alias("part"), F.monotonically_increasing_id().alias("place"))
    names = ["rid", "o", "pred", "prefix", "part", "place"]

    def run(batches):
        at, part = -1, None
        for batch in batches:
            kind, rank = batch.column(0).to_numpy(), batch.column(3).to_numpy().copy()
            if len(rank):
                part = int(batch.column(5)[0].as_py())
                rank[0] = max(rank[0], at)
                pred = np.maximum.accumulate(rank)
                at = int(pred[-1])
                own = pa.array(kind == 0)
                yield pa.RecordBatch.from_arrays([batch.column(k).filter(own) for k in (1, 2)] + [pa.array(pred[kind == 0])] + [batch.column(k).filter(own) for k in (4, 5, 6)], names)
        if part is not None:  # the partition's last rank, for the partitions behind it
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (-1, -1, at, 0, part, -1)], names)

    placed = tables.write(sorted_.mapInArrow(run, ", ".join(f"{n} long" for n in names)), name)
    carried, last = [], -1
    for part, most in sorted(map(tuple, placed.where("rid = -1").select("part", "pred").collect())):
        carried.append((part, last))
        last = max(last, most)
    sent = F.broadcast(rows.sparkSession.createDataFrame(carried, "part long, carried long"))  # one row for each partition
    return placed.where("rid >= 0").join(sent, "part").select("rid", "o", F.greatest("pred", "carried").alias("pred"), "prefix", "place")


def equal_windows(regions: DataFrame, tables: Scratch) -> DataFrame:
    """(run, ord, at): the windows of the dictionary whose string of WIDTH bytes another one has, run
    numbering the strings; a few that are alone may be among them."""
    texts = regions.select("rid", "windows", "text")
    ranks = _runs(texts.mapInArrow(_cuts, "rid long, o long, s binary"), "s", ["s", "rid", "o"], tables, "ranks")
    ranked = ranks.groupBy("rid").agg(F.collect_list(F.struct("o", F.col("run").alias("rank"))).alias("ranks"))
    kinds = "rid long, o long, one long, two long, prefix long, kind long, rank long, r1 long, r2 long"
    wide = tables.write(texts.join(ranked, "rid").mapInArrow(_own, kinds), "wide")
    tables.drop("ranks")
    more = ["kind", "rid", "o", "rank", "prefix"]
    one = _before(wide.where("kind <> 2").select(F.col("one").alias("key"), F.col("r1").alias("behind"), *more), tables, "one")
    two = _before(wide.where("kind <> 1").select(F.col("two").alias("key"), F.col("r2").alias("behind"), *more), tables, "two")
    merged = one.join(two.select("rid", "o", F.col("pred").alias("pred2")), ["rid", "o"])
    merged = merged.select("rid", "o", "prefix", F.greatest("pred", "pred2").alias("major"), F.lit(1).alias("minor"), "place")
    sample = wide.where("kind <> 0").select("rid", "o", "prefix", F.col("rank").alias("major"), F.lit(0).alias("minor"), F.lit(0).cast("long").alias("place"))
    full = tables.write(sample.unionByName(merged), "full")
    tables.drop("wide", "one", "two")
    runs = _runs(full, "prefix", ["major", "minor", "place", "rid", "o"], tables, "order", alone=False)
    tables.drop("full")
    return runs.join(regions.select("rid", "ord", "start"), "rid").select("run", "ord", (F.col("start") + F.col("o")).alias("at"))


def _slices(batches, rows: int = 1000):
    """Batches of so many rows at most: what is built of one in a task stays small."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def _regions(batches):
    """Of documents (ord, t, open): the open contexts with their text, those that touch as one, and
    their phrases as (o, windows, back)."""
    for batch in _slices(batches):
        out: list[tuple] = []
        for ord_, text, phrases_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            start = stop = None
            inner: list[dict] = []
            for x in [*sorted(phrases_, key=lambda x: x["at"]), None]:
                if x and stop == x["at"]:
                    stop += x["windows"]
                    inner.append({"o": x["at"] - start, "windows": x["windows"], "back": x["back"]})
                    continue
                if start is not None:
                    out.append((ord_, start, text[start : stop - 1 + DEEP], inner))
                if x:
                    start, stop = x["at"], x["at"] + x["windows"]
                    inner = [{"o": 0, "windows": x["windows"], "back": x["back"]}]
        cols = [*zip(*out, strict=True)] or [()] * 4
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([(n, pa.int64()) for n in ("o", "windows", "back")]))]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["ord", "start", "text", "phrases"])


def _pieces(batches):
    """Of contexts (cid, text, phrases): (cid, o, windows, piece) for the windows of each phrase that
    share a piece, which is a hash of it."""
    for batch in _slices(batches):
        text = [t + bytes(DEEP) for t in batch.column(1).to_pylist()]
        at = np.cumsum([0, *map(len, text)])[:-1]
        flat, of = batch.column(2).flatten(), np.repeat(np.arange(len(text)), batch.column(2).value_lengths().to_numpy())
        o, windows, back = (flat.field(k).to_numpy() for k in range(3))
        hashes = Hashes(np.frombuffer(b"".join(text), np.uint8))
        cols: list[list[np.ndarray]] = [[], [], [], []]
        for q in range(-(-(WIDTH - GRAM + 1) // PIECE)):
            most = np.minimum(back, q * PIECE + PIECE - 1)  # bytes before the anchor, of the first window and the last one
            least = np.maximum(back - windows + 1, q * PIECE)
            has = np.flatnonzero(most >= least)
            anchor = o[has] + back[has]
            start = at[of[has]] + anchor - q * PIECE
            h = _mix(hashes.of(start, start + WIDTH - PIECE + 1) ^ np.uint64((q + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1)).view(np.int64)
            for col, part in zip(cols, (batch.column(0).to_numpy()[of[has]], anchor - most[has], most[has] - least[has] + 1, h), strict=True):
                col.append(part)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in cols], ["cid", "o", "windows", "piece"])


def _kept(batches):
    """Of contexts (ord, start, text, pieces): (ord, start, windows, text) of the windows of pieces, those
    that touch as one."""
    for batch in _slices(batches):
        out: list[tuple] = []
        for ord_, at, text, pieces in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            start = stop = None
            for x in [*sorted(pieces, key=lambda x: x["o"]), None]:
                if x and stop == x["o"]:
                    stop += x["windows"]
                    continue
                if start is not None:
                    out.append((ord_, at + start, stop - start, text[start : stop - 1 + DEEP]))
                if x:
                    start, stop = x["o"], x["o"] + x["windows"]
        cols = [*zip(*out, strict=True)] or [()] * 4
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["ord", "start", "windows", "text"])


def dictionary(contexts: DataFrame, tables: Scratch) -> DataFrame:
    """(rid, ord, start, windows, text) of contexts (ord, start, text, phrases): the windows whose
    piece another one has. A piece that is alone is in no other window, so only windows that
    no other equals go."""
    contexts = tables.write(contexts.withColumn("cid", F.monotonically_increasing_id()), "texts")
    pieces = tables.write(contexts.select("cid", "text", "phrases").mapInArrow(_pieces, "cid long, o long, windows long, piece long"), "pieces")
    shared = pieces.groupBy("piece").agg(F.count("*").alias("n")).where("n > 1").select("piece")
    kept = pieces.join(shared, "piece", "left_semi").groupBy("cid").agg(F.collect_list(F.struct("o", "windows")).alias("pieces"))
    regions = contexts.join(kept, "cid").select("ord", "start", "text", "pieces").mapInArrow(_kept, "ord long, start long, windows long, text binary")
    regions = tables.write(regions.withColumn("rid", F.monotonically_increasing_id()), "regions")
    tables.drop("texts", "pieces")
    return regions


def later_windows(docs: DataFrame) -> DataFrame:
    """(ord, at, windows): of docs (ord, t), the windows whose string starts earlier. ord: a
    distinct long for each row; smaller is earlier."""
    tables = Scratch(docs.sparkSession)
    marked = tables.write(marked_phrases(docs, tables), "marked")
    by_doc = marked.where("is_first").groupBy("ord").agg(F.collect_list(F.struct("at", "windows", "back")).alias("open"))
    contexts = docs.join(by_doc, "ord").select("ord", "t", "open").mapInArrow(_regions, "ord long, start long, text binary, phrases array<struct<o:bigint,windows:bigint,back:bigint>>")
    regions = dictionary(contexts, tables)
    runs = tables.write(equal_windows(regions, tables), "runs")
    tables.drop("regions", "order")
    place = F.struct("ord", "at")
    least = runs.groupBy("run").agg(F.min(place).alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = tables.write(runs.join(least, "run").where(place != F.col("least")).select("ord", "at", F.lit(1).cast("long").alias("windows")), "later")
    tables.drop("runs")
    return marked.where("not is_first").select("ord", "at", "windows").unionByName(later)


def _digest(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, str]:
    """(bytes removed, maximal removed runs, SHA-256 of the rest)."""
    at, rest = 0, hashlib.sha256()
    for start, end in spans:
        rest.update(text[at:start])
        at = end
    rest.update(text[at:])
    return sum(b - a for a, b in spans), len(spans), rest.hexdigest()


def spans_of(windows: pa.Array) -> list[list[tuple[int, int]]]:
    """Of a column of arrays of (at, windows): each row's maximal removed runs of bytes, end exclusive."""
    flat, of = windows.flatten(), np.repeat(np.arange(len(windows)), windows.value_lengths().fill_null(0).to_numpy())
    at = flat.field(0).to_numpy()
    end = at + flat.field(1).to_numpy() - 1 + WIDTH
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(windows))]
    if len(at):
        row = of * (int(end.max()) + 2)  # rows lie one behind the other, none touching the next
        order = np.argsort(row + at)
        start, stop = (row + at)[order], np.maximum.accumulate((row + end)[order])
        new = np.flatnonzero(np.r_[True, start[1:] > stop[:-1]])
        last = np.r_[new[1:], len(start)] - 1
        shift = row[order][new]
        for k, a, b in zip(of[order][new].tolist(), (start[new] - shift).tolist(), (stop[last] - shift).tolist(), strict=True):
            out[k].append((a, b))
    return out


def _ordered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(ord, id, t): ord is the id where ids are distinct and not null, else the rank by id, text."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"))
    ids = rows.groupBy("id").count().agg(F.coalesce(F.max("count"), F.lit(1)).alias("most"), F.count(F.when(F.col("id").isNull(), 1)).alias("nulls")).first()
    if ids["most"] == 1 and ids["nulls"] == 0:
        return rows.select(F.col("id").alias("ord"), "id", "t")
    by = [F.col("id").asc_nulls_last(), F.col("t")]
    return cut(rows.repartitionByRange(*by).sortWithinPartitions(*by).select(F.monotonically_increasing_id().alias("ord"), "id", "t"))


def _with_windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = _ordered(docs, id_col, text_col)
    gone = later_windows(rows.select("ord", "t")).groupBy("ord").agg(F.collect_list(F.struct("at", "windows")).alias("w"))
    return rows.join(gone, "ord", "left").select("id", "t", "w")


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256), one row per row of docs.

    Texts are UTF-8 bytes; null is empty, and empty texts lose nothing. Earlier: smaller id,
    then earlier start; rows that repeat an id are ranked by their text, null ids come
    last. Empty table: no rows. Other columns are not read.
    """

    def run(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            got = [_digest(t, s) for t, s in zip(texts, spans_of(batch.column(2)), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.string())],
                [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return _with_windows(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, kept binary, spans array<struct<start, end>>): the bytes that stay, which may no
    longer be whole UTF-8 characters, and the places in the original of those that went."""

    def run(batches):
        for batch in batches:
            kept, spans = [], []
            for t, gone in zip(batch.column(1).to_pylist(), spans_of(batch.column(2)), strict=True):
                cuts = [0, *(x for s in gone for x in s), len(t or b"")]
                kept.append(b"".join((t or b"")[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)))
                spans.append([{"start": a, "end": b} for a, b in gone])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], [id_col, "kept", "spans"])

    return _with_windows(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` long, kept binary, spans array<struct<start:bigint,end:bigint>>")
