"""Token ids in Simple-8b word-aligned coding.

A 64-bit word holds a selector in its top four bits and, below, as many ids
of one width as fit. Ids over 60 bits follow an escape word raw. Blocks of
``BLOCK`` ids start at word boundaries with their offsets stored, so that
blocks are packed in lockstep and all words of a selector are unpacked at once.

File: magic, then little-endian int64 documents, ids, blocks and words, then
int64 document ids, int64 token counts, int64 first word of each block (and
the end), uint64 words.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import local_path, shared_folder, write_file
from .textkit import chunks, span_hashes, text_buffer

MAGIC = b"FTMS8B01"
BLOCK = 1024
#: (ids in a word, bits of each) by selector; the last stands for an escape.
SELECTORS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 15
U64 = np.uint64


_LOW_CLASS = np.searchsorted([1 << b for _, b in SELECTORS], np.arange(1 << 16), "right").astype(np.uint8)


def _width_class(ids: np.ndarray) -> np.ndarray:
    """The first selector whose width holds each id; ESCAPE - 1 if none does."""
    if ids.max(initial=U64(0)) < U64(1 << 16):
        return _LOW_CLASS[ids]
    return np.searchsorted(np.array([1 << b for _, b in SELECTORS], U64), ids, "right").astype(np.uint8)


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block and the end) of unsigned ids."""
    ids = np.ascontiguousarray(ids, U64)
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, U64), np.zeros(1, np.int64)
    # rows of a block's width classes, zeros after its end: a block's last word may be filled in part
    pad = 60
    padded = np.zeros(blocks * (BLOCK + pad), U64).reshape(blocks, BLOCK + pad)
    flat = np.zeros(blocks * BLOCK, U64)
    flat[:n] = ids
    padded[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    need = _width_class(padded)
    pick = np.full((blocks, BLOCK), ESCAPE, np.uint8)
    widest = {1: need}
    for count, bits in reversed(SELECTORS):
        if count not in widest:
            a = max(x for x in widest if 2 * x >= count or x == max(widest))
            m = widest[a]
            widest[count] = np.maximum(m[:, : m.shape[1] - (count - a)], m[:, count - a :])
        s = SELECTORS.index((count, bits))
        np.copyto(pick, np.uint8(s), where=widest[count][:, :BLOCK] <= s)
    pick = pick.reshape(-1)
    step = np.array([c for c, _ in SELECTORS] + [1, 1], np.int64)
    at = np.arange(blocks) * BLOCK
    end = np.minimum(at + BLOCK, n)
    begun = []
    live = np.arange(blocks)
    while len(live):
        begun.append(at[live])
        at[live] += step[pick[at[live]]]
        live = live[at[live] < end[live]]
    start = np.sort(np.concatenate(begun))
    sel = pick[start].astype(np.int64)
    escaped = sel == ESCAPE
    slot = np.cumsum(1 + escaped) - (1 + escaped)
    total = int(slot[-1] + 1 + escaped[-1])
    words = np.zeros(total, U64)
    cells = padded.reshape(-1)
    place = start + start // BLOCK * pad
    for s, (count, bits) in enumerate(SELECTORS):
        own = np.flatnonzero(sel == s)
        if not len(own):
            continue
        w = np.full(len(own), U64(s) << U64(60), U64)
        for k in range(count):
            w |= cells[place[own] + k] << U64(k * bits)
        words[slot[own]] = w
    own = np.flatnonzero(escaped)
    words[slot[own]] = U64(ESCAPE) << U64(60)
    words[slot[own] + 1] = ids[start[own]]
    first = np.append(slot[np.searchsorted(start, np.arange(blocks) * BLOCK)], total)
    return words, first


def decode(words: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """The n ids of all blocks."""
    out = np.zeros(n, U64)
    if not n:
        return out
    sel = (words >> U64(60)).astype(np.int64)
    lead = np.flatnonzero(sel == ESCAPE)
    skip = np.zeros(len(words), bool)
    if len(lead):
        # a raw word may look like an escape itself: of a run of them, every other one leads
        run = np.arange(len(lead)) - np.maximum.accumulate(np.where(np.diff(lead, prepend=-2) > 1, np.arange(len(lead)), 0))
        lead = lead[run % 2 == 0]
        skip[lead + 1] = True
    use = np.flatnonzero(~skip)
    sel = sel[use]
    count = np.array([c for c, _ in SELECTORS] + [1, 1], np.int64)[sel]
    block = np.searchsorted(first, use, "right") - 1
    total = np.cumsum(count) - count
    head = np.searchsorted(use, first[:-1])
    start = total - total[head][block] + block * BLOCK
    end = np.minimum((block + 1) * BLOCK, n)
    for s, (width, bits) in enumerate(SELECTORS):
        own = np.flatnonzero(sel == s)
        if not len(own):
            continue
        w, at, stop = words[use[own]], start[own], end[own]
        mask = U64((1 << bits) - 1)
        for k in range(width):
            ok = at + k < stop
            out[at[ok] + k] = (w[ok] >> U64(k * bits)) & mask
    own = np.flatnonzero(sel == ESCAPE)
    out[start[own]] = words[use[own] + 1]
    return out


def dump(doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    words, first = encode(ids)
    head = MAGIC + struct.pack("<4q", len(doc_ids), len(ids), len(first) - 1, len(words))
    return b"".join([head, *(np.ascontiguousarray(x, t).tobytes() for x, t in ((doc_ids, "<i8"), (sizes, "<i8"), (first, "<i8"), (words, "<u8")))])


def load(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, token counts, ids) of a file."""
    raw = np.memmap(path, np.uint8, "r")
    if bytes(raw[:8]) != MAGIC:
        raise ValueError(f"{path} isn't a token file")
    docs, n, blocks, words = struct.unpack("<4q", bytes(raw[8:40]))
    body = np.frombuffer(raw, "<i8", offset=40)
    cut = np.cumsum([docs, docs, blocks + 1])
    own, sizes, first = body[: cut[0]], body[cut[0] : cut[1]], body[cut[1] : cut[2]]
    return own, sizes, decode(body[cut[2] : cut[2] + words].view("<u8"), first, n)


#: Pieces of text whose ids a worker keeps; beyond, it starts anew.
KEPT = 1 << 20
#: Code points by class: 0 white space, 1 letter, 2 number, 3 other.
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
WHITE = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    import unicodedata

    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            out[c] = LETTER if kind == "L" else NUMBER
    out[list(WHITE)] = SPACE
    return out


def byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of the code point that each UTF-8 byte belongs to."""
    table = _classes()
    out = table[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        b = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32)
        size = 2 + (b[lead] >= 0xE0) + (b[lead] >= 0xF0)
        for n, keep in ((2, 0x1F), (3, 0x0F), (4, 0x07)):
            at = lead[size == n]
            cp = b[at] & keep
            for k in range(1, n):
                cp = (cp << 6) | (b[at + k] & 0x3F)
            kind = table[np.minimum(cp, 0x10FFFF)]
            for k in range(n):
                out[np.minimum(at + k, len(out) - 1)] = kind
    return out


def piece_starts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where the byte-level pattern's pieces begin, for documents end to end in data.

    Runs of one class, with a blank before them; of white space before other
    text the last character stands apart; English contractions after a quote.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind = byte_classes(data)
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    run = np.empty(n, bool)
    run[0] = True
    run[1:] = (kind[1:] != kind[:-1]) | cut[1:-1]
    start = run.copy()
    # text after white space of the same document
    at = np.flatnonzero(run & (kind != SPACE) & ~cut[:-1])
    at = at[kind[at - 1] == SPACE]
    blank = data[at - 1] == 0x20
    start[at[blank]] = False
    last = at - 1  # the first byte of the white space character before
    for _ in range(2):
        back = (data[last] & 0xC0) == 0x80
        last = np.where(back, last - 1, last)
    start[last] = True
    # contractions, where a piece begins with the quote
    q = np.flatnonzero((data == 0x27) & start)
    if len(q):
        doc_end = offs[np.searchsorted(offs, q, "right")]
        d = np.concatenate([data, np.zeros(2, np.uint8)])
        one, two = d[q + 1], d[q + 2]
        short = ((one == 0x73) | (one == 0x74) | (one == 0x6D) | (one == 0x64)) & (q + 1 < doc_end)
        long = (((one == 0x72) & (two == 0x65)) | ((one == 0x76) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C))) & (q + 2 < doc_end)
        size = np.where(short, 2, np.where(long, 3, 0))
        q, size, doc_end = q[size > 0], size[size > 0], doc_end[size > 0]
        start[q + 1] = False
        after = q + size
        start[after[after < doc_end]] = True
    return np.flatnonzero(start)


class LibraryPieces:
    """The public tokenizer library's ids, asked once for each piece that its pattern cuts.

    Byte-level BPE encodes each piece of its pattern apart, so a text's ids are
    its pieces' ids in turn. Known pieces are found by a 64-bit hash and length.
    """

    def __init__(self, path: str):
        import json
        import os
        import re

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        from .bpe import byte_symbols

        self.lib = Tokenizer.from_file(path)
        self.model = self.lib.model
        spec = json.load(open(path, encoding="utf-8"))
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile(b"|".join(map(re.escape, self.special))) if self.special else None
        self.shown = {b: c for b, c in enumerate(byte_symbols())}
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(4 * KEPT, U64)
        self.slot_of = np.zeros(4 * KEPT, np.int32)
        self.n = 0
        self.at = np.zeros(KEPT + 1, np.int64)
        self.pool = np.zeros(4 * KEPT, np.uint32)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash's piece, or -1."""
        mask = len(self.keys) - 1
        slot = (h & U64(mask)).astype(np.int64)
        key = self.keys[slot]
        out = np.where(key == h, self.slot_of[slot], -1)
        more = np.flatnonzero((key != h) & (key != 0))
        while len(more):
            slot[more] = (slot[more] + 1) & mask
            key = self.keys[slot[more]]
            hit = key == h[more]
            out[more[hit]] = self.slot_of[slot[more[hit]]]
            more = more[~hit & (key != 0)]
        return out

    def _insert(self, h: np.ndarray, pieces: list[bytes]) -> None:
        ids = []
        for b in pieces:
            ids.append([self.special[b]] if b in self.special else [t.id for t in self.model.tokenize(b.decode("latin-1").translate(self.shown))])
        size = np.array([len(x) for x in ids])
        flat = np.array([i for x in ids for i in x], np.uint32)
        begin = self.at[self.n]
        if begin + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(flat)), np.uint32)])
        self.pool[begin : begin + len(flat)] = flat
        own = np.arange(self.n, self.n + len(h))
        self.at[own + 1] = begin + np.cumsum(size)
        self.n += len(h)
        mask = len(self.keys) - 1
        todo, slot = np.arange(len(h)), (h & U64(mask)).astype(np.int64)
        while len(todo):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[todo[free]]
            won = self.keys[slot] == h[todo]
            self.slot_of[slot[won]] = own[todo[won]]
            todo, slot = todo[~won], (slot[~won] + 1) & mask

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each document) for documents end to end in data."""
        start = piece_starts(data, offs)
        own = offs
        if self.cut is not None and (found := [m.span() for m in self.cut.finditer(data.tobytes())]):
            found = [(a, b) for a, b in found if np.searchsorted(offs, a, "right") == np.searchsorted(offs, b - 1, "right")]
            # what stands before and after a special token is cut as texts of their own
            own = np.unique(np.concatenate([offs, np.array(found, np.int64).ravel()]))
            start = piece_starts(data, own)
            inside = np.zeros(len(data) + 1, np.int64)
            for a, b in found:
                inside[a + 1] += 1
                inside[b] -= 1
            start = start[np.cumsum(inside)[start] == 0]
        end = np.append(start[1:], len(data)) if len(start) else start
        h = span_hashes(data, start, end) | U64(1)
        raw = data.tobytes()
        # a slice has no more distinct pieces than the table takes
        parts = [self._ids(raw, start[k : k + KEPT], end[k : k + KEPT], h[k : k + KEPT]) for k in range(0, max(len(h), 1), KEPT)]
        stop = np.cumsum(np.concatenate([size for _, size in parts]))
        cut = np.concatenate([[0], stop])[np.searchsorted(start, offs)]
        return np.concatenate([ids for ids, _ in parts]), np.diff(cut)

    def _ids(self, raw: bytes, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each piece) of at most KEPT pieces."""
        number = self._find(h)
        new = np.flatnonzero(number < 0)
        if len(new):
            u, first = np.unique(h[new], return_index=True)
            if self.n + len(u) > KEPT:
                self._clear()
                u, first = np.unique(h, return_index=True)
                new = np.arange(len(h))
            self._insert(u, [raw[start[k] : end[k]] for k in new[first]])
            number[new] = self._find(h[new])
        size = self.at[number + 1] - self.at[number]
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(stop) else 0
        place = np.arange(total) + np.repeat(self.at[number] - (stop - size), size)
        return self.pool[place], size


@lru_cache(maxsize=2)
def library(path: str) -> LibraryPieces:
    return LibraryPieces(path)


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2) -> list[tuple[str, int, int]]:
    """Encodes docs (doc_id, text) into one file per range of doc_id; (file, documents, ids) in that order.

    Null ids come first, repeated ids by their text's hash. Files are named by their range and replaced whole, so a task that runs again does no harm.
    """
    root = local_path(folder)

    def run(batches):
        from pyspark import TaskContext

        lib = library(tokenizer)
        own, sizes, parts = [], [], []
        narrow = np.uint16 if max(lib.lib.get_vocab_size(), end_id + 1) <= 1 << 16 else np.uint32
        for batch in batches:
            own.append(batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy())
            data, offs = text_buffer(batch.column(1))
            for i, j in chunks(offs):
                ids, n = lib.encode(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                full = np.full(len(ids) + j - i, end_id, narrow)
                keep = np.ones(len(full), bool)
                keep[np.cumsum(n + 1) - 1] = False
                full[keep] = ids
                parts.append(full)
                sizes += (n + 1).tolist()
        if sizes:
            k = TaskContext.get().partitionId()
            name = f"tokens-{k:07d}.s8b"
            ids = np.concatenate(parts)
            write_file(f"{root}/{name}", dump(np.concatenate(own), np.array(sizes), ids))
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([name]), pa.array([len(sizes)]), pa.array([len(ids)])], names=["k", "file", "docs", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tie = F.xxhash64("text")
    dealt = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    made = dealt.mapInArrow(run, "k long, file string, docs long, ids long").collect()  # a row per file
    return [(r["file"], r["docs"], r["ids"]) for r in sorted(made, key=lambda r: r["k"])]


COLUMNS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_tokens(spark: SparkSession, folder: str, files: list[tuple[str, int, int]]) -> DataFrame:
    """Per document of the files: its place in the whole id sequence, token count and a checksum of its ids."""
    before, rows = 0, []
    for name, _, ids in files:
        rows.append((name, before))
        before += ids
    if not rows:
        return spark.createDataFrame([], COLUMNS)
    root = local_path(folder)

    def run(batches):
        import zlib

        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own, sizes, ids = load(f"{root}/{name}")
                cut = np.concatenate([[0], np.cumsum(sizes)])
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
                none = own == np.iinfo(np.int64).min
                yield pa.RecordBatch.from_arrays([pa.array(own, mask=none), pa.array(cut[:-1] + start), pa.array(sizes), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    names = spark.createDataFrame(rows, "file string, start long").repartition(len(rows))
    return names.mapInArrow(run, COLUMNS)


def token_file_digest(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes docs' ids to the shared folder and returns what the files hold."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    return read_tokens(spark, folder, write_tokens(docs, tokenizer, folder, end_id))
