"""Words, word hashes and word-window hashes of Arrow text columns, in numpy.

A word is a run of bytes outside space and 0x09-0x0D; those bytes never occur inside a
UTF-8 sequence, so bytes are enough. All functions take whole texts; work is cut into
chunks of rows by bytes only to bound memory.

Hashes are Rabin-Karp polynomials modulo 2^64 over random byte codes, finished by a
bijective mixer; ``seed`` gives independent families.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_KEEP = np.arange(256, dtype=np.uint8)
_LOWER = _KEEP.copy()
_LOWER[65:91] += 32
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _codes(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def _powers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i for i < n; kept up to a few chunks' length."""
    got = _POWERS.get(seed)
    if got is None or len(got[0]) < n:
        base = int(mix(np.array([seed + 77], np.uint64))[0]) | 1
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            step = np.full(max(n, 1), b, np.uint64)
            step[0] = 1
            out.append(np.cumprod(step, dtype=np.uint64))
        got = (out[0], out[1])
        if n <= 2 * CHUNK_BYTES:
            _POWERS[seed] = got
    return got


def rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of values[starts[i]:ends[i]]; equal slices have equal hashes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    p, inverse = _powers(len(values), seed)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * p[: len(values)], out=total[1:])
    out = total[ends] - total[starts]
    out *= inverse[starts]
    out += (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(out)


class Words:
    """The words of some texts: byte spans, and ``first[d]:first[d + 1]`` are those of text d."""

    def __init__(self, texts: pa.Array, lower: bool = False, space: np.ndarray = _SPACE):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        _, offs, data = texts.buffers()
        self.offsets = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        lo, hi = int(self.offsets[0]), int(self.offsets[-1])
        raw = np.frombuffer(data, np.uint8)[lo:hi] if hi > lo else np.zeros(0, np.uint8)
        self.offsets = self.offsets - lo
        self.data = _LOWER[raw] if lower else raw
        solid = ~space[self.data]
        begin, end = solid.copy(), solid.copy()
        if len(solid):
            begin[1:] &= ~solid[:-1]
            end[:-1] &= ~solid[1:]
            inner = self.offsets[1:-1]
            cut = inner[(inner > 0) & (inner < len(solid))]
            begin[cut] = solid[cut]
            end[cut - 1] = solid[cut - 1]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, self.offsets)

    def hashes(self, seed: int) -> np.ndarray:
        return rolling(_codes(seed)[self.data], self.starts, self.ends, seed + 1)

    def docs(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def windows(self, hashes: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """(first words, hashes) of all windows of k words within one text."""
        left = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.starts))
        at = np.flatnonzero(left >= k)
        return at, rolling(hashes, at, at + k, seed)


def release() -> None:
    """Give freed memory back: Python workers outlive their tasks and are reused."""
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES, last: bool = True) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text each, at least one row. With
    ``last`` the batches are all of a task's, and memory is given back after them."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), np.int64))
        at = 0
        while at < batch.num_rows:
            base = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, base + limit)))
            yield batch.slice(at, to - at)
            at = to
    if last:
        release()


_CODEC = pa.Codec("zstd", compression_level=1)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob."""
    head = np.array([len(arrays), *(x for a in arrays for x in (ord(a.dtype.char), a.nbytes))], np.int64)
    raw = head.tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = _CODEC.decompress(memoryview(blob)[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 1 + 2 * n)
    at, out = 8 * (1 + 2 * n), []
    for i in range(n):
        kind, size = np.dtype(chr(head[1 + 2 * i])), int(head[2 + 2 * i])
        out.append(np.frombuffer(raw, kind, size // kind.itemsize, at))
        at += size
    return out


def delta(x: np.ndarray) -> np.ndarray:
    """Differences (the first value first), which compress well where x is nearly sorted."""
    return np.diff(x, prepend=x.dtype.type(0))


def undelta(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x, dtype=x.dtype)


def int64s(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values (0 where null) and where they are not null."""
    col = batch.column(name).cast(pa.int64())
    return np.asarray(pc.fill_null(col, 0), np.int64), np.asarray(pc.is_valid(col), bool)
