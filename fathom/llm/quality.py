"""Compression-band quality rules.

Zstandard ratios (compressed bytes over bytes) of the whole document and of
each of its fixed chunks are held against limits that depend on the length:
a ratio under the band's lower limit means repetitive text, over the upper
limit incompressible text. A last chunk too short for the chunk limits is
judged twice: with what stands before it, as the last ``chunk_bytes`` of the
document, and alone against limits for its length (with the bytes before it up
to ``LEAST_TAIL``). One pass, no shuffle.

Defined cases: null or empty text has no words and fails the base rule; its
ratios are null. Every text that passes the base rule gets a verdict, of
whatever length. Repeated rows are judged alike, an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textkit import Words, chunks, ngram_hashes, text_buffer

#: (from this many bytes, lowest whole ratio, highest whole ratio)
BANDS = (
    (0, 0.55, 1.20),
    (96, 0.45, 1.05),
    (256, 0.48, 0.90),
    (512, 0.46, 0.80),
    (1024, 0.44, 0.72),
    (2048, 0.43, 0.68),
    (4096, 0.41, 0.66),
    (8192, 0.395, 0.65),
    (16384, 0.38, 0.64),
    (65536, 0.35, 0.63),
)
#: A last chunk is judged alone with at least this many bytes.
LEAST_TAIL = 96
#: (bytes, lowest ratio, highest ratio) of a short piece, linear in between: prose stays within, base64 over. Up to some
#: 95 bytes zstandard stores what it can't shorten as it is, with 9 bytes or more of frame, where prose still has matches.
SHORT = ((24, 0.66, 1.14), (48, 0.60, 1.09), (72, 0.57, 1.04), (95, 0.55, 1.02), (96, 0.55, 1.05), (128, 0.52, 0.99), (192, 0.49, 0.91), (256, 0.47, 0.86), (384, 0.45, 0.80), (512, 0.43, 0.76), (768, 0.40, 0.72), (1024, 0.36, 0.70))
#: Whole texts under this have the upper limit of SHORT.
SHORT_WHOLE = 256


@dataclass(frozen=True)
class CompressionRules:
    bands: tuple = field(default=BANDS)
    level: int = 3
    chunk_bytes: int = 2048
    #: A last chunk shorter than this is judged by its own length's limits.
    least_chunk: int = 1024
    chunk_low: float = 0.36
    chunk_high: float = 0.70
    min_words: int = 20
    window: int = 8
    max_repeat_percent: int = 30


SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
COLUMNS = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, whole_ratio double, chunk_min_ratio double, chunk_max_ratio double, reason string, kept boolean"
)


def _line_repeats(lines, w: Words) -> np.ndarray:
    """Per document: lines with a word that equal an earlier line."""
    start, end, doc = lines
    has = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end, doc = start[has], end[has], doc[has]
    from .textkit import mix64, span_hashes

    with np.errstate(over="ignore"):
        key = mix64(span_hashes(w.data, start, end) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, at = np.unique(key, return_index=True)
    n = np.bincount(doc, minlength=w.n_docs)
    n -= np.bincount(doc[at], minlength=w.n_docs)
    return n


def line_spans(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, doc) of the \\n-split lines of each document, in order."""
    nl = np.flatnonzero(w.data == 10)
    start = np.sort(np.concatenate([w.offs[:-1], nl + 1]), kind="stable")
    end = np.sort(np.concatenate([nl, w.offs[1:]]), kind="stable")
    doc = np.repeat(np.arange(w.n_docs), 1 + np.bincount(np.searchsorted(w.offs, nl, "right") - 1, minlength=w.n_docs)[: w.n_docs])
    return start, end, doc


def _repeat_words(w: Words, width: int) -> np.ndarray:
    """Per document: words inside a window of that width found twice or more in the document."""
    g, ok = ngram_hashes(w.hashes(), width, w.first)
    out = np.zeros(w.n_docs, np.int64)
    if not ok.any():
        return out
    at = np.flatnonzero(ok)
    from .textkit import mix64

    with np.errstate(over="ignore"):
        key = mix64(g[at] + w.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    k = key[order]
    same = k[1:] == k[:-1]
    twice = np.zeros(len(k), bool)
    twice[1:] |= same
    twice[:-1] |= same
    step = np.zeros(len(w.start) + 1, np.int64)
    hit = at[order[twice]]
    np.add.at(step, hit, 1)
    np.add.at(step, hit + width, -1)
    covered = np.cumsum(step[:-1]) > 0
    return np.bincount(w.doc[covered], minlength=w.n_docs)


def short_limits(n: int) -> tuple[float, float]:
    at, low, high = zip(*SHORT)
    return float(np.interp(n, at, low)), float(np.interp(n, at, high))


def _measure(data, offs, i, j, rules: CompressionRules, packer):
    w = Words(data, offs, i, j)
    n = w.n_docs
    # code points are the bytes that aren't continuation bytes
    lead = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
    chars = np.zeros(n, np.int64)
    np.add.at(chars, w.doc, lead[w.end] - lead[w.start])
    sym = np.concatenate([[0], np.cumsum(SYMBOL[w.data])])
    words = w.count.astype(np.int64)
    symbols = np.diff(sym[w.offs])
    dup = _line_repeats(line_spans(w), w)
    rep = _repeat_words(w, rules.window)
    base = (words < rules.min_words) | (100 * rep > rules.max_repeat_percent * words)
    starts = [b[0] for b in rules.bands]
    whole, low, high, reason, kept = [], [], [], [], []
    for d in range(n):
        b = w.data[w.offs[d] : w.offs[d + 1]].tobytes()
        if not b:
            whole.append(None), low.append(None), high.append(None)
            reason.append("base"), kept.append(False)
            continue
        r = len(packer.compress(b)) / len(b)
        cs, tail = [], None
        if len(b) > rules.chunk_bytes:
            for k in range(0, len(b), rules.chunk_bytes):
                piece = b[k : k + rules.chunk_bytes]
                if len(piece) >= rules.least_chunk:
                    cs.append(len(packer.compress(piece)) / len(piece))
                else:
                    cs.append(len(packer.compress(b[-rules.chunk_bytes :])) / rules.chunk_bytes)
                    tail = b[-max(len(piece), LEAST_TAIL) :]
        lo, hi = min(cs, default=r), max(cs, default=r)
        why = "base" if base[d] else None
        k = int(np.searchsorted(starts, len(b), "right")) - 1
        if why is None:
            _, least, most = rules.bands[k]
            if len(b) < SHORT_WHOLE:
                most = min(most, short_limits(len(b))[1])
            tail_low, tail_high = short_limits(len(tail)) if tail else (0.0, 0.0)
            tail_ratio = len(packer.compress(tail)) / len(tail) if tail else 0.0
            if r < least:
                why = "whole_repetitive"
            elif r > most:
                why = "whole_incompressible"
            elif cs and (lo < rules.chunk_low or tail_ratio < tail_low):
                why = "chunk_repetitive"
            elif cs and (hi > rules.chunk_high or tail_ratio > tail_high):
                why = "chunk_incompressible"
        whole.append(r), low.append(lo), high.append(hi)
        reason.append(why), kept.append(why is None)
    return [words, chars, symbols, dup, rep, base, whole, low, high, reason, kept]


def compression_quality(docs: DataFrame, rules: CompressionRules = CompressionRules()) -> DataFrame:
    """One row per row of docs (doc_id, text); other columns are ignored."""

    def run(batches):
        import zstandard

        packer = zstandard.ZstdCompressor(level=rules.level)
        for batch in batches:
            ids = batch.column(0)
            data, offs = text_buffer(batch.column(1))
            for i, j in chunks(offs):
                cols = _measure(data, offs, i, j, rules, packer)
                types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.float64(), pa.string(), pa.bool_()]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), *(pa.array(c, t) for c, t in zip(cols, types))],
                    names=[c.split()[0] for c in COLUMNS.split(", ")],
                )

    return docs.select("doc_id", "text").mapInArrow(run, COLUMNS)
