"""Vectorised word splitting and hashing over Arrow string buffers.

A batch of texts is one byte buffer with row offsets; words, their 64-bit hashes and hashes of
word n-grams come from whole-buffer numpy operations, so no Python object is made per word.
The bytes are worked in pieces cut at separators, which bounds memory for texts of any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_PIECE = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply rounds)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inv = pow(_BASE, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up = np.full(size, U64(_BASE), U64)
        up[0] = 1
        down = np.full(size, U64(inv), U64)
        down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def byte_class(pattern: str) -> np.ndarray:
    """Which bytes are word bytes: ``alnum`` (letters, digits and all non-ASCII), ``symbol`` (other printable ASCII) or ``nonspace``."""
    ok = np.zeros(256, bool)
    if pattern == "alnum":
        ok[0x30:0x3A] = ok[0x41:0x5B] = ok[0x61:0x7B] = True
        ok[0x80:] = True
    elif pattern == "symbol":
        ok[0x21:0x7F] = True
        ok[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False
    elif pattern == "nonspace":
        ok[:] = True
        ok[[0x20, *range(0x09, 0x0E)]] = False
    else:
        raise ValueError(pattern)
    return ok


def _fold() -> np.ndarray:
    """A random 64-bit value per byte, the same for A-Z and a-z."""
    v = mix(np.arange(1, 257, dtype=U64) * U64(0xA24BAED4963EE407))
    v[0x41:0x5B] = v[0x61:0x7B]
    return v


CLASSES = {k: byte_class(k) for k in ("alnum", "symbol", "nonspace")}
FOLD = _fold()


@dataclass
class Words:
    """Words of a batch: byte ``starts``/``ends`` in ``buf``, 64-bit ``hashes``; ``rows[i]:rows[i+1]`` are those of row i."""

    buf: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.rows)


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (from 0) of a string array; null counts as the empty text."""
    texts = pc.fill_null(texts, "")
    if pa.types.is_string(texts.type):
        kind = np.int32
    elif pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        texts, kind = texts.cast(pa.large_string()), np.int64
    _, off, data = texts.buffers()
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(off, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, o - o[0]


def split_words(buf: np.ndarray, offsets: np.ndarray, kind: str = "alnum") -> Words:
    ok = CLASSES[kind][buf]
    n = len(buf)
    edge = ok.copy()
    edge[1:] &= ~ok[:-1]
    firsts = offsets[:-1]
    firsts = firsts[firsts < n]
    edge[firsts] = ok[firsts]
    starts = np.flatnonzero(edge)
    edge = ok
    lasts = firsts[firsts > 0] - 1
    keep = edge[lasts]
    edge = edge.copy()
    edge[:-1] &= ~ok[1:]
    edge[lasts] = keep
    ends = np.flatnonzero(edge) + 1
    rows = np.searchsorted(starts, offsets)
    return Words(buf, offsets, starts, ends, rows, hash_spans(buf, starts, ends))


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Case-folded (A-Z) 64-bit hashes of ascending, disjoint byte spans."""
    out = np.empty(len(starts), U64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            lo = starts[at]
            to = max(at + 1, int(np.searchsorted(ends, lo + _PIECE, "right")))
            hi = ends[to - 1]
            size = _PIECE if hi - lo <= _PIECE else 1 << int(hi - lo).bit_length()
            up, down = _powers(size) if size == _PIECE else _powers.__wrapped__(size)
            v = FOLD[buf[lo:hi]]
            v *= up[: hi - lo]
            sums = np.empty(hi - lo + 1, U64)
            sums[0] = 0
            np.cumsum(v, out=sums[1:])
            s, e = starts[at:to] - lo, ends[at:to] - lo
            h = (sums[e] - sums[s]) * down[s]
            out[at:to] = mix(h + (e - s).astype(U64))
            at = to
    return out


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes, by the place of the first; rows are not told apart."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        out = h[:n].copy()
        for j in range(1, k):
            out *= U64(_BASE)
            out += h[j : j + n]
        return mix(out)


def gram_rows(rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k-grams that lie within a row, and the number in each row."""
    counts = np.maximum(np.diff(rows) - (k - 1), 0)
    total = int(counts.sum())
    first = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(first - rows[:-1], counts), counts


def slices(texts: pa.Array, budget: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``budget`` bytes; a longer text is a range of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at, done = 0, 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, done + budget, "right")))
        yield at, to
        done, at = int(ends[to - 1]), to


def renamed(df, prefix: str = "_c"):
    """df with columns named by place, so that added columns can't clash; and the way back."""
    back = list(df.columns)
    return df.toDF(*[f"{prefix}{i}" for i in range(len(back))]), back


def ddl(df) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
