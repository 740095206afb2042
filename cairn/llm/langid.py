"""Language identification by a bidirectional gated recurrent network over bytes.

Trained in numpy by backpropagation through time on a bounded sample of labelled
documents; predicts in Arrow batches. A text is read in windows of WINDOW bytes. Both
directions read every byte of a window, every position gets a probability of each
language, and the document's probabilities are the mean over its letters' positions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import crc_mod, sampled

WINDOW = 64
#: Labelled rows that the network is fitted on, about, at most; one window of each.
SAMPLE_ROWS = 8000
HIDDEN = 8
#: The class of text in no language, learned from corrupted windows, and the probability of it from which on a text is rejected.
JUNK, REJECT = "\0", 0.9
#: With fewer labelled windows than this, rejection is not learned.
LEAST_ROWS = 50
_B = np.arange(256)
_LOWER = np.where((_B >= 65) & (_B <= 90), _B + 32, _B).astype(np.uint8)
_LETTER = ((_B >= 97) & (_B <= 122) | (_B >= 128)).astype(np.float32)


def windows(texts: list[bytes], width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(rows of `width` bytes with A-Z lower-cased, the rows of each text). The last row of a
    text is filled up with byte 0, which isn't a letter."""
    n = np.array([-(-len(t) // width) for t in texts], np.int64)
    flat = b"".join(t.ljust(int(k) * width, b"\0") for t, k in zip(texts, n, strict=True))
    return _LOWER[np.frombuffer(flat, np.uint8)].reshape(-1, width), n


def _gates(g: np.ndarray, x: np.ndarray, h: np.ndarray, k: int):
    """One step, from U h and the byte's row of X: reset, update, candidate, new state."""
    rz = 1 / (1 + np.exp(-(g[: 2 * k] + x[: 2 * k])))
    r, z = rz[:k], rz[k:]
    n = np.tanh(x[2 * k :] + r * g[2 * k :])
    return r, z, n, n + z * (h - n)


def fit(texts: list[bytes], labels: list[str], hidden: int = HIDDEN, epochs: int = 6, batch: int = 256, width: int = 32, rate: float = 0.02, seed: int = 0) -> dict:
    """Weights of the network: {"langs", "f": (X, U), "b": (X, U), "W", "c"}. Languages count
    alike, however many rows they have."""
    langs = sorted(set(labels))
    rng = np.random.default_rng(seed)
    rows, n = windows(texts, width)
    y = np.repeat([langs.index(x) for x in labels], n)
    share = np.bincount(y, minlength=len(langs))
    weight = len(y) / (len(langs) * np.maximum(share, 1))
    k, m = hidden, len(langs)
    p = {"fX": rng.normal(0, 0.3, (3 * k, 256)), "bX": rng.normal(0, 0.3, (3 * k, 256)), "fU": rng.normal(0, k**-0.5, (3 * k, k)), "bU": rng.normal(0, k**-0.5, (3 * k, k)), "W": rng.normal(0, 0.3, (m, 2 * k)), "c": np.zeros((m, 1))}
    p = {a: v.astype(np.float32) for a, v in p.items()}
    mean, var, step = {a: np.zeros_like(v) for a, v in p.items()}, {a: np.zeros_like(v) for a, v in p.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            ids, size = rows[pick].T, len(pick)
            kept, hs = {}, {}
            for d, times in (("f", range(width)), ("b", range(width - 1, -1, -1))):
                h, kept[d], hs[d] = np.zeros((k, size), np.float32), {}, np.empty((width, k, size), np.float32)
                for t in times:
                    g = p[d + "U"] @ h
                    r, z, cand, new = _gates(g, p[d + "X"][:, ids[t]], h, k)
                    kept[d][t] = (h, g[2 * k :], r, z, cand)
                    hs[d][t] = h = new
            both = np.concatenate([hs["f"], hs["b"]], 1)
            logits = p["W"] @ both + p["c"]
            e = np.exp(logits - logits.max(1, keepdims=True))
            prob = e / e.sum(1, keepdims=True)
            w = _LETTER[ids] * weight[y[pick]]
            prob[:, y[pick], np.arange(size)] -= 1
            dl = (prob * (w / max(w.sum(), 1))[:, None, :]).astype(np.float32)
            grad = {"W": np.einsum("tmb,tkb->mk", dl, both), "c": dl.sum((0, 2))[:, None]}
            dboth = p["W"].T @ dl
            for d, times in (("f", range(width - 1, -1, -1)), ("b", range(width))):
                dh, dU, dx = np.zeros((k, size), np.float32), np.zeros_like(p[d + "U"]), np.empty((3 * k, width, size), np.float32)
                part = dboth[:, :k] if d == "f" else dboth[:, k:]
                for t in times:
                    h, gn, r, z, cand = kept[d][t]
                    dh = dh + part[t]
                    dn = dh * (1 - z) * (1 - cand * cand)
                    dz = dh * (h - cand) * z * (1 - z)
                    dr = dn * gn * r * (1 - r)
                    dx[:k, t], dx[k : 2 * k, t], dx[2 * k :, t] = dr, dz, dn
                    dg = np.concatenate([dr, dz, dn * r])
                    dU += dg @ h.T
                    dh = dh * z + p[d + "U"].T @ dg
                grad[d + "U"] = dU
                grad[d + "X"] = np.stack([np.bincount(ids.ravel(), v.ravel(), 256) for v in dx])
            step += 1
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            now = rate * (1 - epoch / epochs)
            for a, g in grad.items():
                g = g * min(1, 1 / (norm + 1e-9))
                mean[a] += 0.1 * (g - mean[a])
                var[a] += 0.001 * (g * g - var[a])
                p[a] -= (now * (mean[a] / (1 - 0.9**step)) / (np.sqrt(var[a] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return {"langs": langs, "f": (p["fX"], p["fU"]), "b": (p["bX"], p["bU"]), "W": p["W"], "c": p["c"]}


def position_sums(model: dict, rows: np.ndarray) -> np.ndarray:
    """Of each window, the sum over its letters' positions of each language's probability."""
    k, (count, width) = model["f"][1].shape[1], rows.shape
    ids = np.ascontiguousarray(rows.T)
    half = np.repeat(np.array([0.5, 0.5, 1], np.float32), k)[:, None]  # a sigmoid as a tanh
    fore = np.empty((width, k, count), np.float32)
    total = np.zeros((len(model["langs"]), count), np.float32)
    Wf, Wb = np.ascontiguousarray(model["W"][:, :k]), np.ascontiguousarray(model["W"][:, k:])
    for d, times in (("f", range(width)), ("b", range(width - 1, -1, -1))):
        X, U = (np.ascontiguousarray(a * half) for a in model[d])
        h = np.zeros((k, count), np.float32)
        x, g = np.empty((3 * k, count), np.float32), np.empty((3 * k, count), np.float32)
        for t in times:
            np.take(X, ids[t], axis=1, out=x, mode="clip")
            np.matmul(U, h, out=g)
            rz = x[: 2 * k]
            rz += g[: 2 * k]
            np.tanh(rz, out=rz)
            rz *= 0.5
            rz += 0.5
            n = g[2 * k :]
            n *= rz[:k]
            n += x[2 * k :]
            np.tanh(n, out=n)
            h -= n
            h *= rz[k:]
            h += n
            if d == "f":
                fore[t] = h
            else:
                e = Wf @ fore[t]
                e += Wb @ h
                e += model["c"]
                e -= e.max(0)
                np.exp(e, out=e)
                e *= _LETTER[ids[t]] / e.sum(0)
                total += e
    return total.T


def predict_batch(model: dict, texts: list[bytes], at_once: int = 4096) -> np.ndarray:
    """Of each text, the mean over its letters' positions of each language's probability."""
    rows, n = windows(texts)
    sums = np.concatenate([position_sums(model, rows[a : a + at_once]) for a in range(0, len(rows), at_once)] or [np.zeros((0, len(model["langs"])))])
    ends = np.cumsum(n)
    upto = np.concatenate([np.zeros((1, sums.shape[1])), np.cumsum(sums, 0, dtype=np.float64)])
    out = upto[ends] - upto[ends - n]
    return out / np.maximum(out.sum(1, keepdims=True), 1e-9)


def corrupted(texts: list[bytes], seed: int = 0) -> list[bytes]:
    """Of each text, one that is in no language, by turns: its characters in random order, random
    letters, letters put for others by a random cipher, signs with a few letters, random letters of other scripts."""
    rng = np.random.default_rng(seed)
    letters, signs = "abcdefghijklmnopqrstuvwxyz", list("#$%&*+-/<=>@^_|~!?.,;:0123456789 ")
    scripts = [(0x391, 0x3C9), (0x410, 0x44F), (0x5D0, 0x5EA), (0x627, 0x64A), (0x905, 0x939), (0x3041, 0x3093), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3)]
    out = []
    for i, text in enumerate(texts):
        t = text.decode("utf-8", "ignore").lower() or "x"
        n = len(t)
        if i % 6 == 0:
            t = "".join(rng.permutation(list(t)))
        elif i % 6 == 1:
            t = "".join(rng.choice(list(letters), n))
            gaps = set(np.cumsum(rng.integers(3, 14, n)).tolist()) if i % 2 else set()
            t = "".join(" " if k in gaps else c for k, c in enumerate(t))
        elif i % 6 == 2:
            other = sorted(set(c for c in t if c.isalpha()) | set(letters))
            t = t.translate(str.maketrans("".join(other), "".join(rng.permutation(other))))
        elif i % 6 in (3, 4):
            at = set(rng.choice(n, min(n, int(rng.integers(1, 13))), replace=False).tolist())
            size = int(rng.integers(1, 6))  # of a run of one sign
            t = "".join(rng.choice(list(letters)) if k in at else c for k, c in enumerate("".join(rng.choice(signs) * size for _ in range(n))[:n]))
        else:
            lo, hi = scripts[int(rng.integers(len(scripts)))]
            t = "".join(" " if x < 0.12 else chr(c) for x, c in zip(rng.random(n), rng.integers(lo, hi + 1, n), strict=True))
        out.append(t.encode()[:WINDOW])
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS, reject: bool = False) -> dict | None:
    """The network fitted on the labelled documents whose crc32(id) mod 4 is not 2: one
    window, at a place that the id decides, of about `rows` of them at most, by the id's hash.
    reject: the class JUNK is learned besides, from corrupted windows, as many."""
    at = F.pmod(F.xxhash64(F.lit("at"), id_col), F.greatest(F.length(text_col) - WINDOW, F.lit(1)))
    labelled = docs.where(crc_mod(id_col, 4) != 2).where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    pick = labelled.select(F.col(lang_col).cast("string"), F.substring(text_col, at.cast("int") + 1, F.lit(WINDOW)).cast("binary"), F.xxhash64(id_col).alias("h"))
    count = docs.where(crc_mod(id_col, 4) != 2).where(F.col(lang_col).isNotNull()).count()
    got = sorted((r[0], bytes(r[1]), r[2]) for r in sampled(pick, "h", rows, count).collect())
    texts, langs = [t for _, t, _ in got], [x for x, _, _ in got]
    if reject and len(got) >= LEAST_ROWS:
        # as many passes as fit() makes over 8,000 rows, so that a small sample learns too
        return fit(texts + corrupted(texts), langs + [JUNK] * len(texts), epochs=max(6, min(60, 24_000 // len(texts))))
    return fit(texts, langs) if got else None


def identify(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score), one row per row of docs. Null texts and texts without a
    letter, and all texts where there was nothing to learn from, are `und` with score 0.
    Only the text is read."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        for batch in batches:
            texts = [x or b"" for x in batch.column(1).to_pylist()]
            letters = batch.column(2).to_numpy(zero_copy_only=False)
            prob = predict_batch(model, texts) if model else np.zeros((len(texts), 1))
            best = prob.argmax(1)
            known = letters & (prob.sum(1) > 0)
            lang = [model["langs"][b] if ok else "und" for b, ok in zip(best, known, strict=True)]
            score = np.where(known, np.minimum(prob[np.arange(len(texts)), best], 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang), pa.array(score)], [id_col, "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("binary").alias("t"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("l"))
    return rows.mapInArrow(run, f"`{id_col}` long, lang_pred string, score double")


def predict(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id_col, held_out, lang_pred, score) for every row of docs, by a network that never
    saw the documents with held_out, those whose crc32(id) mod 4 is 2. A null id is not
    held out, and its row is not learned from. Repeated rows count each."""
    found = identify(docs, train(docs, id_col, text_col, lang_col), id_col, text_col)
    return found.select(id_col, F.coalesce(crc_mod(id_col, 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, text_col: str = "text", model: dict | None = None) -> DataFrame:
    """docs, all columns as they came, without rows that have no language: null texts, texts
    without a letter, and texts that the network gives a probability of REJECT or more to be
    junk, in none of the languages it learned. model: by default fitted on docs, with the
    class JUNK; one without it (a table with few labelled rows) rejects no letters."""
    at = docs.columns.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model or train(docs, text_col=text_col, reject=True))

    def run(batches):
        model = sent.value
        junk = model["langs"].index(JUNK) if model and JUNK in model["langs"] else None
        for batch in batches:
            texts = batch.column(at).to_pylist()
            keep = np.array([bool(t) and any(c.isalpha() for c in t) for t in texts], bool)
            if junk is not None:
                keep &= predict_batch(model, [(t or "").encode("utf-8", "surrogatepass") for t in texts])[:, junk] < REJECT
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
