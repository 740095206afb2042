"""Embedding near-duplicates by NN-descent.

A graph of each vector's nearest neighbours starts from sorts along random hyperplane
codes and is refined by comparing the neighbours of each vector, and the vectors it is a
neighbour of, with each other, until few lists change. These steps take a byte for each
component, and every pair that is ever found so near the threshold that the bytes may
hide a link is a candidate: what they can change a cosine by follows from the largest
distance of a vector to its bytes, which is measured. Lists that candidates connect are enlarged to the whole component: it is
compared in double precision, block by block, so that no link inside it is lost and none
below the threshold stays. Recall is audited against brute force over a sample; while it
is low, more sorts are made. Exact copies are one vector with a weight throughout.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import components, cut, sampled

LOG = logging.getLogger(__name__)

#: Neighbours in a list; sorts of the first graph and neighbours compared in each; rounds.
K, TABLES, NEXT, ROUNDS = 10, 16, 6, 3
#: The audit's queries, and the recall at which no more sorts are made.
AUDIT, ENOUGH = 256, 0.99
BLOCK = 512
EDGE = "src long, dst long, sim double"


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, dim)


def _small(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of length 1 from a byte for each component."""
    x = np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(-1, dim).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def small_vectors(nodes: DataFrame, dim: int) -> DataFrame:
    """(id, small, far) of nodes' id and unit: each component's share of the largest one, from -127 to
    127; far: the distance of what the bytes stand for, at length 1, to the vector."""

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            small = np.rint(127 * x / np.abs(x).max(1, keepdims=True)) if len(x) else x
            far = np.linalg.norm(small / np.linalg.norm(small, axis=1, keepdims=True) - x, axis=1) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in small.astype(np.int8)], pa.binary()), pa.array(far)], ["id", "small", "far"])

    return nodes.select("id", "unit").mapInArrow(run, "id long, small binary, far double")


def _edges(src, dst, sim) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64()), pa.array(sim, pa.float64())], ["src", "dst", "sim"])


def unit_vectors(rows: DataFrame) -> DataFrame:
    """(id, unit) of rows' id and v: little-endian doubles of length 1, null where the vector is
    null, empty, zero, or has a null or non-finite component."""

    def run(batches):
        for batch in batches:
            out = []
            for v in batch.column(1).to_pylist():
                x = np.array(v if v and None not in v else [], np.float64)
                norm = np.linalg.norm(x) if len(x) and np.isfinite(x).all() else 0.0
                if not np.isfinite(norm):
                    x = x / np.abs(x).max()
                    norm = np.linalg.norm(x)
                out.append((x / norm).astype("<f8").tobytes() if norm > 0 else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "unit"])

    return rows.mapInArrow(run, "id long, unit binary")


def sorted_pairs(nodes: DataFrame, dim: int, tables: int, seed: int, threshold: float) -> DataFrame:
    """(src, dst, sim): each node with the nearest of those that follow it in sorts by codes of
    random hyperplanes, both ways, and every pair seen at the threshold."""
    planes = np.random.default_rng(seed).normal(size=(tables, dim, 48))
    sent = nodes.sparkSession.sparkContext.broadcast(planes)

    def code(batches):
        for batch in batches:
            x = _small(batch.column(1), dim)
            for t, p in enumerate(sent.value):
                bits = np.packbits(x @ p > 0, axis=1)
                key = pa.array([b.tobytes() for b in bits], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([t] * len(x), pa.int32()), key, batch.column(0), batch.column(1)], ["table", "code", "id", "small"])

    def compare(batches):
        last: tuple | None = None
        for batch in batches:
            table, ids, x = batch.column(0).to_numpy(), batch.column(2).to_numpy(), _small(batch.column(3), dim)
            if last:
                table, ids, x = (np.concatenate(p) for p in zip(last, (table, ids, x), strict=True))
            new = len(last[1]) if last else 0
            src, dst, sim = [], [], []
            for d in range(1, min(NEXT, len(ids) - 1) + 1):
                at = np.arange(max(0, new - d), len(ids) - d)
                at = at[table[at] == table[at + d]]
                src.append(ids[at])
                dst.append(ids[at + d])
                sim.append(np.einsum("ij,ij->i", x[at], x[at + d]))
            if src:
                src, dst, sim = np.concatenate(src), np.concatenate(dst), np.concatenate(sim)
                order = np.lexsort((-sim, src))
                first = np.ones(len(order), bool)
                first[1:] = src[order][1:] != src[order][:-1]
                pick = order[first | (sim[order] >= threshold)]
                yield _edges(np.concatenate([src[pick], dst[pick]]), np.concatenate([dst[pick], src[pick]]), np.tile(sim[pick], 2))
            last = (table[-NEXT:], ids[-NEXT:], x[-NEXT:])

    coded = nodes.select("id", "small").mapInArrow(code, "table int, code binary, id long, small binary")
    return coded.repartitionByRange("table", "code", "id").sortWithinPartitions("table", "code", "id").mapInArrow(compare, EDGE)


def best(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest of each src."""
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("sim"), "dst"))
    return pairs.groupBy("src", "dst").agg(F.max("sim").alias("sim")).withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def local_join(graph: DataFrame, nodes: DataFrame, dim: int, k: int, threshold: float) -> DataFrame:
    """Pairs of members of one node's neighbourhood that are nearer than the farthest neighbour
    one of them has, or at the threshold."""
    farthest = graph.groupBy("src").agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(-1.0).alias("far"))
    back = best(graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "sim"), k)
    around = graph.select("src", "dst").unionByName(back.select("src", "dst")).distinct()
    known = nodes.join(farthest, nodes["id"] == farthest["src"]).select(F.col("id").alias("dst"), "small", "far")
    rows = around.join(known, "dst").select("src", "dst", "far", "small")

    def compare(batches):
        def group(ids, far, x):
            s = x @ x.T
            near = np.triu((s > far[:, None]) | (s > far[None, :]) | (s >= threshold), 1)
            a, b = np.nonzero(near)
            return ids[a], ids[b], s[a, b]

        held = None
        for batch in batches:
            part = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(), _small(batch.column(3), dim)]
            if held:
                part = [np.concatenate(p) for p in zip(held, part, strict=True)]
            starts = np.flatnonzero(np.r_[True, part[0][1:] != part[0][:-1]])
            got = [group(part[1][a:b], part[2][a:b], part[3][a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
            held = [p[starts[-1] :] for p in part]
            if got:
                a, b, s = (np.concatenate(x) for x in zip(*got, strict=True))
                yield _edges(np.r_[a, b], np.r_[b, a], np.r_[s, s])
        if held:
            a, b, s = group(*held[1:])
            yield _edges(np.r_[a, b], np.r_[b, a], np.r_[s, s])

    return rows.repartition("src").sortWithinPartitions("src").mapInArrow(compare, EDGE)


def brute(nodes: DataFrame, queries: list[tuple[int, bytes]], dim: int, threshold: float) -> DataFrame:
    """(src, dst): links of the queries, against all nodes, in blocks."""
    sent = nodes.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        ids = np.array([q for q, _ in sent.value], np.int64)
        q = np.frombuffer(b"".join(bytes(u) for _, u in sent.value), "<f8").reshape(-1, dim)
        for batch in batches:
            other = batch.column(0).to_numpy()
            a, b = np.nonzero(q @ _matrix(batch.column(1), dim).T >= threshold)
            keep = ids[a] != other[b]
            yield pa.RecordBatch.from_arrays([pa.array(ids[a][keep]), pa.array(other[b][keep])], ["src", "dst"])

    return nodes.select("id", "unit").mapInArrow(run, "src long, dst long")


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect all that the links in near (rows with columns) connect, fewer than both."""
    out: list[tuple[int, int]] = []
    free = [np.ones(n, bool) for n in near.shape]
    by = (near, near.T)
    for first in range(len(near)):
        if free[0][first]:
            free[0][first] = False
            todo = [(0, first)]
            while todo:
                side, i = todo.pop()
                new = np.flatnonzero(by[side][i] & free[1 - side])
                free[1 - side][new] = False
                out += ((j, i) if side else (i, j) for j in new.tolist())
                todo += ((1 - side, j) for j in new.tolist())
    return out


def in_components(members: DataFrame, dim: int, threshold: float) -> DataFrame:
    """Of members (component, id, copies, unit): rows (src, n), the copies of some of src's links
    in its component, and rows (src, dst), links that connect all that are linked. A
    component is dealt into blocks; each pair of blocks is one task's row."""
    size = members.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = members.join(size, "component").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    dealt = dealt.repartition("component", "blocks", "block")  # else a component stays whole where its size was joined
    packed = cut(dealt.groupBy("component", "blocks", "block").agg(F.collect_list(F.struct("id", "copies", "unit")).alias("m")))
    left = packed.select("component", "block", "m", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other"))
    pairs = left.join(packed.select("component", F.col("block").alias("other"), F.col("m").alias("with")), ["component", "other"])

    def run(batches):
        for batch in batches:
            src, dst, n = [], [], []
            for lower, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = (np.frombuffer(b"".join(r["unit"] for r in m), "<f8").reshape(-1, dim) for m in (a, b))
                ids, other = np.array([r["id"] for r in a]), np.array([r["id"] for r in b])
                near = (x @ y.T >= threshold) & (ids[:, None] != other[None, :])
                src += ids.tolist()
                dst += [None] * len(ids)
                n += (near @ np.array([r["copies"] for r in b], np.int64)).tolist()
                links = forest(near) if lower else []
                src += (ids[i] for i, _ in links)
                dst += (other[j] for _, j in links)
                n += [0] * len(links)
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64()), pa.array(n, pa.int64())], ["src", "dst", "n"])

    return pairs.select((F.col("block") <= F.col("other")).alias("lower"), "m", "with").mapInArrow(run, "src long, dst long, n long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, k: int = K, tables: int = TABLES, rounds: int = ROUNDS) -> DataFrame:
    """(id_col, n_links, component_id, kept), one row per row of vectors.

    n_links: other rows linked directly; component_id: the smallest id reachable; kept:
    it is the row's own. Null, empty and zero vectors, and vectors with null or non-finite
    components link with nothing; vectors link with vectors of their own length only, each
    length by itself. Rows that repeat an id count as rows of their own; a null id is never
    the smallest, unless all are null. Empty table: no rows. Other columns are not read.
    The recall over the audit's vectors is logged, as a warning where it is under ENOUGH.
    """
    rows = cut(unit_vectors(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))).withColumn("size", F.octet_length("unit")))
    sizes = sorted(r[0] for r in rows.where("unit IS NOT NULL").groupBy("size").count().where("count > 1").select("size").collect())
    others = rows.where(~F.coalesce(F.col("size").isin(sizes), F.lit(False))) if sizes else rows
    out = others.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    for size in sizes:
        out = out.unionByName(_of_length(rows.where(F.col("size") == size).select("id", "unit"), size // 8, id_col, threshold, k, tables, rounds))
    return out


def _of_length(rows: DataFrame, dim: int, id_col: str, threshold: float, k: int, tables: int, rounds: int) -> DataFrame:
    nodes = cut(rows.groupBy("unit").agg(F.min("id").alias("least"), F.count("*").alias("copies")).repartition("unit").withColumn("id", F.monotonically_increasing_id()))
    small = cut(small_vectors(nodes, dim))
    far, total_nodes = small.agg(F.max("far"), F.count("*")).first()
    small = small.select("id", "small")
    near = threshold - (2 * far + far * far) - 1e-6  # |<u, v> - <u', v'>| is at most far + far + far * far
    edges = graph = None
    for more in range(3):
        pairs = cut(sorted_pairs(small, dim, tables, more, near))
        edges = pairs if edges is None else edges.withColumn("sim", F.lit(1.0)).unionByName(pairs)
        graph = cut(best(pairs if graph is None else graph.unionByName(pairs), k))
        for _ in range(rounds):
            found = cut(local_join(graph, small, dim, k, near))
            edges = edges.unionByName(found)
            better = cut(best(graph.unionByName(found), k))
            size, same = better.join(graph.select("src", "dst", F.lit(1).alias("had")), ["src", "dst"], "left").agg(F.count("*"), F.count("had")).first()
            changed, graph = size - same, better
            if changed <= 0.01 * size:
                break
        edges = cut(edges.where((F.col("sim") >= near) & (F.col("src") < F.col("dst"))).select("src", "dst").distinct())
        group = cut(components(edges, "src", "dst"))
        linked = group.select(F.col("node").alias("id")).join(nodes.select("id", "unit"), "id")  # half of the audit: vectors with candidates
        some = sampled(linked, "id", AUDIT // 2, group.count()).unionByName(sampled(nodes.select("id", "unit"), "id", AUDIT // 2, total_nodes)).dropDuplicates(["id"])
        queries = [(r[0], bytes(r[1])) for r in some.collect()]
        truth = brute(nodes, queries, dim, threshold)
        of = lambda c: group.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in"))
        seen, total = truth.join(of("src"), "src", "left").join(of("dst"), "dst", "left").agg(F.count(F.when(F.col("src_in") == F.col("dst_in"), 1)), F.count("*")).first()
        if total == 0 or seen >= ENOUGH * total:
            break
    enough = total and seen >= ENOUGH * total
    (LOG.info if enough else LOG.warning)("links of %d audited vectors found: %d of %d%s", len(queries), seen, total, "" if total else ", so recall is not measured")

    exact = cut(in_components(group.select(F.col("node").alias("id"), "component").join(nodes, "id").select("component", "id", "copies", "unit"), dim, threshold))
    links = exact.where("dst is null").groupBy(F.col("src").alias("id")).agg(F.sum("n").alias("n"))
    group = components(exact.where("dst is not null"), "src", "dst")
    by_node = nodes.select("id", "least", "copies", "unit").join(group.withColumnRenamed("node", "id"), "id", "left").join(links, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = by_node.groupBy("component").agg(F.min("least").alias("component_id"))
    final = cut(by_node.join(least, "component").select("unit", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    return rows.join(final, "unit").select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
