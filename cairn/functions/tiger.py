"""Tiger and its hash tree (leaves of 1024 bytes), for many texts at once in numpy."""

from __future__ import annotations

from base64 import b32encode
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from cairn.functions.codecs import base32_of_hex

#: The first state, the text that the tables are made from, passes over them, the leaf's size.
STATE = (0x0123456789ABCDEF, 0xFEDCBA9876543210, 0xF096A5B4C3B2E187)
SEED = b"Tiger - A Fast New Hash Function, by Ross Anderson and Eli Biham"
PASSES, LEAF = 5, 1024
#: Messages hashed at once, at most.
BLOCK = 1 << 13


def _u(x: int) -> np.uint64:
    return np.uint64(x)


def _schedule(x: list[np.ndarray]) -> None:
    x[0] = x[0] - (x[7] ^ _u(0xA5A5A5A5A5A5A5A5))
    x[1] = x[1] ^ x[0]
    x[2] = x[2] + x[1]
    x[3] = x[3] - (x[2] ^ (~x[1] << _u(19)))
    x[4] = x[4] ^ x[3]
    x[5] = x[5] + x[4]
    x[6] = x[6] - (x[5] ^ (~x[4] >> _u(23)))
    x[7] = x[7] ^ x[6]
    x[0] = x[0] + x[7]
    x[1] = x[1] - (x[0] ^ (~x[7] << _u(19)))
    x[2] = x[2] ^ x[1]
    x[3] = x[3] + x[2]
    x[4] = x[4] - (x[3] ^ (~x[2] >> _u(23)))
    x[5] = x[5] ^ x[4]
    x[6] = x[6] + x[5]
    x[7] = x[7] - (x[6] ^ _u(0x0123456789ABCDEF))


def compress(table: np.ndarray, words: np.ndarray, state: list[np.ndarray]) -> list[np.ndarray]:
    """state after one block for each row of words (n, 8)."""
    x, s = [words[:, i] for i in range(8)], list(state)
    for turn, times in enumerate((5, 7, 9)):
        if turn:
            _schedule(x)
        for i in range(8):
            a, b, c = (k % 3 for k in (i - turn, i - turn + 1, i - turn + 2))
            s[c] = s[c] ^ x[i]
            byte = np.ascontiguousarray(s[c]).view(np.uint8).reshape(-1, 8)
            s[a] = s[a] - (table[0][byte[:, 0]] ^ table[1][byte[:, 2]] ^ table[2][byte[:, 4]] ^ table[3][byte[:, 6]])
            s[b] = (s[b] + (table[3][byte[:, 1]] ^ table[2][byte[:, 3]] ^ table[1][byte[:, 5]] ^ table[0][byte[:, 7]])) * _u(times)
    return [s[0] ^ state[0], s[1] - state[1], s[2] + state[2]]


@cache
def tables() -> np.ndarray:
    """The four tables of 256 words, made by their published rule: columns of bytes are shuffled
    by the digest of the seed under the tables so far."""
    byte = np.repeat(np.arange(256, dtype=np.uint8)[None, :, None], 4, 0).repeat(8, 2).copy()
    words = byte.view("<u8")[..., 0]
    state, seed = [np.array([v], np.uint64) for v in STATE], np.frombuffer(SEED, "<u8")[None]
    column, used = np.arange(8), 2
    for _ in range(PASSES):
        for i in range(256):
            for box in byte:
                used = (used + 1) % 3
                if used == 0:
                    state = compress(words, seed, state)
                other = state[used].view(np.uint8)
                held = box[i].copy()
                box[i] = box[other, column]
                box[other, column] = held
    return words


def digests(messages: list[bytes]) -> list[bytes]:
    """Tiger of each message, 24 bytes."""
    by_size: dict[int, list[int]] = defaultdict(list)
    for k, m in enumerate(messages):
        by_size[(len(m) + 8) // 64 + 1].append(k)
    out = [b""] * len(messages)
    for blocks, which in by_size.items():
        for at in range(0, len(which), max(1, BLOCK // blocks)):
            some = which[at : at + max(1, BLOCK // blocks)]
            padded = b"".join((messages[k] + b"\x01").ljust(64 * blocks - 8, b"\0") + (8 * len(messages[k])).to_bytes(8, "little") for k in some)
            words = np.frombuffer(padded, "<u8").reshape(len(some), blocks, 8)
            state = [np.full(len(some), v, np.uint64) for v in STATE]
            for i in range(blocks):
                state = compress(tables(), words[:, i], state)
            for k, d in zip(some, np.stack(state, 1), strict=True):
                out[k] = d.tobytes()
    return out


def tree_roots(texts: list[bytes]) -> list[bytes]:
    """Root of each text's tree: leaves after a byte 0, pairs of nodes after a byte 1, an odd one goes up as it is."""
    leaves = [[b"\0" + t[i : i + LEAF] for i in range(0, max(1, len(t)), LEAF)] for t in texts]
    found = iter(digests([leaf for own in leaves for leaf in own]))
    level = [[next(found) for _ in own] for own in leaves]
    while any(len(own) > 1 for own in level):
        found = iter(digests([b"\1" + a + b for own in level for a, b in zip(own[::2], own[1::2], strict=False)]))
        level = [[next(found) for _ in range(len(own) // 2)] + own[len(own) // 2 * 2 :] for own in level]
    return [own[0] for own in level]


@pandas_udf(StringType())
def _tree_hash(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        roots, held, size = [], [], 0
        for text in part:
            held.append(bytes(text or b""))
            size += len(held[-1])
            if size > 1 << 22:
                roots, held, size = roots + tree_roots(held), [], 0
        yield pd.Series([b32encode(r).decode().rstrip("=") for r in roots + tree_roots(held)], index=part.index, dtype=object)


def tiger_tree(content: Column) -> Column:
    """Tree hash in base32; null for null."""
    data = content.cast("binary")
    return F.when(data.isNotNull(), _tree_hash(data))


def tiger_urn(content: Column) -> Column:
    return F.concat(F.lit("urn:tree:tiger:"), tiger_tree(content))


def bitprint_urn(content: Column) -> Column:
    """SHA-1 and tree hash of the content in one URN."""
    return F.concat(F.lit("urn:bitprint:"), base32_of_hex(F.sha1(content.cast("binary")), 20), F.lit("."), tiger_tree(content))
