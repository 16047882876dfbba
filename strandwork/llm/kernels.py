"""Vectorised text kernels (numpy) that run inside Python workers."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

U64 = np.uint64

try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another C library: nothing to trim
    _LIBC = None


def release() -> None:
    """Give freed memory back to the system, so that a worker's size follows its present group."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None and hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


BASE = U64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
BASE_INV = U64(pow(int(BASE), -1, 1 << 64))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (the public splitmix64 one), seeded."""
    with np.errstate(over="ignore"):
        x = x + U64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


class Powers:
    """Powers of BASE and of its inverse, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            m = len(self.up)
            with np.errstate(over="ignore"):
                self.up = np.concatenate([self.up, self.up * U64(pow(int(BASE), m, 1 << 64))])
                self.down = np.concatenate([self.down, self.down * U64(pow(int(BASE_INV), m, 1 << 64))])
        return self.up[:n], self.down[:n]


POWERS = Powers()


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix polynomial hash: out[i] covers data[:i]."""
    up, _ = POWERS.upto(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=out[1:])
    return out


def slice_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] that doesn't depend on where the slice stands."""
    _, down = POWERS.upto(len(prefix))
    with np.errstate(over="ignore"):
        return (prefix[end] - prefix[start]) * down[start]


def text_buffers(column: pa.ChunkedArray | pa.Array) -> list[bytes | memoryview]:
    """The UTF-8 bytes of each text; null is empty."""
    out: list = []
    for c in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if len(c) == 0:
            continue
        if not pa.types.is_large_string(c.type) and not pa.types.is_string(c.type):
            c = c.cast(pa.string())
        wide = np.int64 if pa.types.is_large_string(c.type) else np.int32
        _, offsets, data = c.buffers()
        off = np.frombuffer(offsets, wide)[c.offset : c.offset + len(c) + 1]
        view = memoryview(data) if data is not None else memoryview(b"")
        out += [view[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
    return out


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def chunks(sizes: list[int], limit: int = 1 << 19):
    """Ranges of items of about ``limit`` in all, so that the arrays in work stay in the caches."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def shingle_sets(texts: list, n: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its n-word shingles.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased. With fewer than n words
    the whole sequence is one shingle; without words the set is empty.
    """
    out: list[np.ndarray] = []
    place = mix(np.arange(n, dtype=U64), 5) | U64(1)  # unrelated odd factors, so that word order counts
    for a, b in chunks([len(t) for t in texts]):
        part = texts[a:b]
        data = _LOWER[np.frombuffer(b" ".join(part) + b" ", np.uint8)]
        space = _SPACE[data]
        inner = ~space
        starts = np.flatnonzero(inner & np.concatenate([[True], space[:-1]]))
        ends = np.flatnonzero(space & np.concatenate([[False], inner[:-1]]))
        w = mix(slice_hash(prefix_hash(data), starts, ends))
        edge = np.cumsum([0] + [len(t) + 1 for t in part])
        first = np.searchsorted(starts, edge)  # words before each text
        with np.errstate(over="ignore"):
            s = np.zeros(max(0, len(w) - n + 1), U64)
            for k in range(n):
                s += w[k : k + len(s)] * place[k]
            s = mix(s, n)
            for i in range(len(part)):
                lo, hi = int(first[i]), int(first[i + 1])
                if hi - lo >= n:
                    out.append(np.unique(s[lo : hi - n + 1]))
                elif hi > lo:
                    h = U64(hi - lo)
                    for x in w[lo:hi]:
                        h = h * U64(0xD1342543DE82EF95) + x
                    out.append(mix(np.array([h], U64), 77))
                else:
                    out.append(np.zeros(0, U64))
    return out


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... sizes[0] of them, then those of starts[1] ..."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
