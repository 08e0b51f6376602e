"""Runs of chosen bytes in a batch's texts, and their CRC-32, over whole arrays."""

from __future__ import annotations

import zlib

import numpy as np

#: Spans over this many bytes are handed to zlib one by one; shorter ones advance together, byte by byte.
LOCKSTEP_BYTES = 48


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Mask over the 256 bytes; ranges include both ends."""
    out = np.zeros(256, bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = True
    return out


def runs(keep: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first) of maximal runs of kept bytes that don't cross a text: keep is a mask over the buffer, offs its texts' bounds from 0.

    first is the index of each text's first run, then the number of runs.
    """
    n = len(keep)
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    begin, stop = keep.copy(), keep.copy()
    if n:
        begin[1:] &= ~keep[:-1] | cut[1:-1]
        stop[:-1] &= ~keep[1:] | cut[1:-1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return start, end, np.searchsorted(start, offs)


def gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans' bytes one after another, and the places at which they begin and end."""
    at = np.concatenate([[0], np.cumsum(size)])
    return data[np.repeat(start - at[:-1], size) + np.arange(at[-1])], at


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


_TABLE = _crc_table()


def span_crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """Unsigned CRC-32 of each span's bytes, continued from before (the CRC-32 of what each span follows)."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    state = np.zeros(len(size), np.uint32) if before is None else before[order].astype(np.uint32)
    state = ~state
    s, n = start[order], size[order]
    long = int(np.searchsorted(-n, -LOCKSTEP_BYTES, "left"))
    for k in range(long):
        state[k] = zlib.crc32(data[s[k] : s[k] + n[k]], int(~state[k])) ^ 0xFFFFFFFF
    s, n, left = s[long:], n[long:], state[long:]
    alive = len(n) - np.searchsorted(n[::-1], np.arange(1, int(n[0]) + 1 if len(n) else 1), "left")  # spans of over k bytes
    for k, m in enumerate(alive):
        c = left[:m]
        left[:m] = _TABLE[(c ^ data[s[:m] + k]) & np.uint32(255)] ^ (c >> np.uint32(8))
    out = np.empty(len(size), np.uint32)
    out[order] = ~state
    return out
