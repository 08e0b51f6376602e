"""Elias-Fano sequences over memory-mapped arrays, with vectorised access and successor search.

A monotone sequence of m values below u keeps its low bits packed and its
high bits in unary: value i sets bit (v_i >> low) + i. Counts of set and clear
bits before every few words make selection a binary search and a few word
reads, also where runs of either are long.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
#: Words of high bits for each count in the directories.
SPAN = 4
_EACH, _TOP = U64(0x0101010101010101), U64(0x8080808080808080)
#: Position of the k-th set bit of a byte, at k * 256 + byte.
_IN_BYTE = np.array([([p for p in range(8) if b >> p & 1] + [0] * 8)[k] for k in range(8) for b in range(256)], np.int64)


def _select_in_word(w: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Position of the k-th set bit (from 0) of each word, by sums of its bytes' counts."""
    s = w - ((w >> U64(1)) & U64(0x5555555555555555))
    s = (s & U64(0x3333333333333333)) + ((s >> U64(2)) & U64(0x3333333333333333))
    s = ((s + (s >> U64(4))) & U64(0x0F0F0F0F0F0F0F0F)) * _EACH
    # bytes whose count up to their end doesn't reach beyond k
    passed = np.bitwise_count(((k.astype(U64) * _EACH | _TOP) - s) & _TOP).astype(U64) << U64(3)
    rest = k - (((s << U64(8)) >> passed) & U64(0xFF)).astype(np.int64)
    return passed.astype(np.int64) + _IN_BYTE[(rest << 8) | ((w >> passed) & U64(0xFF)).astype(np.int64)]


class EliasFano:
    """Arrays: head (m, low, u), lows (bytes), bits (words), ones and zeros (bits of either kind before each span of words)."""

    NAMES = ("head", "lows", "bits", "ones", "zeros")

    def __init__(self, arrays: dict[str, np.ndarray], prefix: str):
        self.m, self.low, self.u = (int(x) for x in arrays[f"{prefix}.head"])
        self.lows, self.bits, self.ones, self.zeros = (arrays[f"{prefix}.{x}"] for x in self.NAMES[1:])
        self.spans = self.bits.reshape(-1, SPAN)
        # a word at every byte, for bits from any position on
        self.windows = _windows(self.lows) if self.low else None
        self.high_windows = _windows(self.bits.view(np.uint8))

    @staticmethod
    def build(v: np.ndarray, prefix: str) -> dict[str, np.ndarray]:
        v = np.ascontiguousarray(v, U64)
        m = len(v)
        u = int(v[-1]) + 1 if m else 1
        low = max(0, (u // max(m, 1)).bit_length() - 1)
        high = (v >> U64(low)).astype(np.int64)
        n_bits = m + (u >> low) + 1
        span = 64 * SPAN
        marks = np.zeros(-(-(n_bits + 64) // span) * span, np.uint8)
        at = high + np.arange(m)
        marks[at] = 1
        bits = np.packbits(marks, bitorder="little").view("<u8")
        count = np.bitwise_count(bits).reshape(-1, SPAN).sum(axis=1).astype(np.int64)
        ones = np.cumsum(count) - count
        zeros = np.arange(len(count)) * span - ones
        if n_bits < 1 << 32:
            ones, zeros = ones.astype(np.uint32), zeros.astype(np.uint32)
        lows = np.zeros(0, np.uint8)
        if low:
            planes = np.zeros((m, low), np.uint8)
            for k in range(low):
                planes[:, k] = (v >> U64(k)) & U64(1)
            lows = np.concatenate([np.packbits(planes.reshape(-1), bitorder="little"), np.zeros(8, np.uint8)])
        head = np.array([m, low, u], np.int64)
        return {f"{prefix}.{k}": a for k, a in zip(EliasFano.NAMES, (head, lows, bits, ones, zeros))}

    def _select(self, k: np.ndarray, before: np.ndarray, flip: bool) -> np.ndarray:
        block = np.searchsorted(before, k.astype(before.dtype), "right") - 1
        rest = k - before[block]
        words = self.spans[block]
        if flip:
            words = ~words
        upto = np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int64)
        word = (rest[:, None] >= upto[:, :-1]).sum(axis=1)
        row = np.arange(len(k))
        rest = rest - np.where(word > 0, upto[row, word - 1], 0)
        return ((block * SPAN + word) << 6) + _select_in_word(words[row, word], rest)

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), U64)
        bit = i * self.low
        return (self.windows[bit >> 3] >> (bit & 7).astype(U64)) & U64((1 << self.low) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.zeros(0, U64)
        high = self._select(i, self.ones, False) - i
        return (high.astype(U64) << U64(self.low)) | self._lows(i)

    def find(self, v: np.ndarray) -> np.ndarray:
        """Position of the first element equal to v, or -1: successor search within v's high bits."""
        out = np.full(len(v), -1, np.int64)
        live = np.flatnonzero(v < U64(self.u))
        if not len(live) or not self.m:
            return out
        v = v[live]
        h = (v >> U64(self.low)).astype(np.int64)
        low = v & U64((1 << self.low) - 1)
        # elements of bucket h lie between the clear bits h - 1 and h
        begin = np.zeros(len(h), np.int64)
        some = np.flatnonzero(h > 0)
        begin[some] = self._select(h[some] - 1, self.zeros, True) + 1
        w = self.high_windows[begin >> 3] >> (begin & 7).astype(U64)
        run = np.bitwise_count(w ^ (w + U64(1))).astype(np.int64) - 1
        lo = begin - h
        hi = lo + run
        far = np.flatnonzero(run > 48)  # the run may go on beyond the window
        hi[far] = self._select(h[far], self.zeros, True) - h[far]
        at, stop = lo, hi.copy()
        on = np.flatnonzero(at < stop)
        while len(on):
            mid = (at[on] + stop[on]) >> 1
            less = self._lows(mid) < low[on]
            at[on] = np.where(less, mid + 1, at[on])
            stop[on] = np.where(less, stop[on], mid)
            on = on[at[on] < stop[on]]
        own = np.flatnonzero(at < hi)
        hit = own[self._lows(at[own]) == low[own]]
        out[live[hit]] = at[hit]
        return out


def _windows(raw: np.ndarray) -> np.ndarray:
    return np.ndarray((max(len(raw) - 7, 0),), "<u8", raw.data if len(raw) else b"", 0, (1,))


def save(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays one after another, 64-byte aligned, behind a table of contents."""
    import json

    toc, at = {}, 0
    for name, a in arrays.items():
        toc[name] = (a.dtype.str, len(a), at)
        at += -(-a.nbytes // 64) * 64
    head = json.dumps(toc).encode()
    head = len(head).to_bytes(8, "little") + head
    out = [head, b"\0" * (-len(head) % 64)]
    for a in arrays.values():
        out += [np.ascontiguousarray(a).tobytes(), b"\0" * (-a.nbytes % 64)]
    return b"".join(out)


def load(path: str) -> dict[str, np.ndarray]:
    """The file's arrays, memory-mapped."""
    import json

    raw = np.memmap(path, np.uint8, "r")
    n = int.from_bytes(bytes(raw[:8]), "little")
    toc = json.loads(bytes(raw[8 : 8 + n]))
    base = -(-(8 + n) // 64) * 64
    # plain views of the map: the memmap class would slow every access
    flat = np.frombuffer(raw, np.uint8)
    return {name: flat[base + at : base + at + np.dtype(kind).itemsize * size].view(kind) for name, (kind, size, at) in toc.items()}
