"""Vectorised text primitives over Arrow string batches.

A batch's texts are one UTF-8 buffer with offsets. Words are maximal runs of
bytes outside space and \\t..\\r, which never cross a document boundary. All
white space of that class is ASCII, so byte and code point views agree.
"""

from __future__ import annotations

from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes handled at once; only a single longer document raises it.
CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64; a bijection on 64-bit words."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BYTE_CODE = mix64(np.arange(1, 257, dtype=U64) * U64(_BASE))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.full(n, _BASE, U64)
        down = np.full(n, _BASE_INV, U64)
        up[0] = down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    size = CHUNK_BYTES + 1
    while size < n:
        size *= 2
    return _powers(size)


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return d, o


def chunks(offs: np.ndarray, size: int = CHUNK_BYTES):
    """Ranges [i, j) of whole documents with at most size bytes, or of one document."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """Words of documents [i, j): start, end (within .data), doc (0-based in the range)."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, i: int, j: int, lower: bool = False):
        lo, hi = int(offs[i]), int(offs[j])
        self.data = LOWER[data[lo:hi]] if lower else data[lo:hi]
        self.offs = offs[i : j + 1] - lo
        self.n_docs = j - i
        n = hi - lo
        space = SPACE[self.data]
        cut = np.zeros(n + 1, bool)
        cut[self.offs] = True
        begin = np.empty(n, bool)
        stop = np.empty(n, bool)
        if n:
            begin[0] = True
            begin[1:] = space[:-1] | cut[1:-1]
            begin &= ~space
            stop[-1] = True
            stop[:-1] = space[1:] | cut[1:-1]
            stop &= ~space
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, self.offs)  # of each document, and the end
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n_docs), self.count)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span's bytes, from one prefix sum over the buffer."""
    up, down = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        p = np.zeros(len(data) + 1, U64)
        np.cumsum(BYTE_CODE[data] * up[: len(data)], out=p[1:])
        h = (p[end] - p[start]) * down[start]
        return mix64(h + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def ngram_hashes(h: np.ndarray, n: int, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive items and the mask of windows within one document.

    first: index of each document's first item, then the number of items.
    """
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U64), np.zeros(0, bool)
    with np.errstate(over="ignore"):
        g = np.zeros(m, U64)
        for k in range(n):
            g *= U64(0xD1342543DE82EF95)
            g += h[k : k + m]
        g = mix64(g)
    ok = np.ones(m, bool)
    for k in range(1, n):  # a window that starts less than n before a later start
        at = first[1:-1] - k
        ok[at[(at >= 0) & (at < m)]] = False
    return g, ok


def pack(parts: list[np.ndarray], kind: np.dtype) -> bytes:
    """Parallel arrays, the first ascending, as compressed planes of bytes."""
    import zstandard

    first = np.diff(parts[0].astype(np.int64), prepend=0)
    planes = [np.ascontiguousarray(x.astype(kind)).view(np.uint8).reshape(-1, kind.itemsize).T.tobytes() for x in (first, *parts[1:])]
    return len(first).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(blob: bytes, count: int, kind: np.dtype) -> list[np.ndarray]:
    import zstandard

    n, width = int.from_bytes(blob[:8], "little"), kind.itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8:], max(1, count * n * width)), np.uint8)
    out = [np.ascontiguousarray(raw[k * n * width : (k + 1) * n * width].reshape(width, n).T).view(kind).reshape(-1) for k in range(count)]
    out[0] = np.cumsum(out[0], dtype=kind)
    return out


def release() -> None:
    """Hands memory of dropped arrays back to the system: workers stay alive between tasks and share an executor's limit."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def tidy(run):
    """A function of batches that hands its memory back when its task ends, however it ends."""

    @wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return tidied
