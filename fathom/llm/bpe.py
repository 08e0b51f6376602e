"""Byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

A word's leaves hold (rank, position) of its adjacent pairs; the root is the
leftmost pair of lowest rank. Merging it changes three leaves, each updated
along its path to the root, until the root holds no pair. Short words run in
lockstep, one row of a matrix of trees each; long words run alone.

Defined cases: a null or empty text has no ids and decodes to the empty text.
Special tokens' strings in a text become their ids, as the public library
does. Symbols that the vocabulary lacks are dropped. Repeated rows are encoded
alike, an empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import json
import unicodedata
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import small_batches
from .textkit import chunks, release, text_buffer

#: A leaf or root without a pair. In lockstep a pair is rank * 256 + position.
NONE = np.int32(np.iinfo(np.int32).max)
#: Longest word, in symbols, that runs in lockstep with others.
LOCKSTEP = 256
#: Trees' cells held at once in lockstep.
CELLS = 1 << 17
#: Pieces whose encodings a worker keeps in each of two generations, some 400 bytes each.
KEPT = 50_000
#: Bytes of text encoded together, so that new words share their lockstep.
ENCODE_BYTES = 4 << 20
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(extra)) for b in range(256)]


class WordBpe:
    """A tokenizer file of kind BPE with word-end suffix, NFC, lower case and split words."""

    def __init__(self, path: str):
        import regex

        spec = json.load(open(path, encoding="utf-8"))
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        suffix = spec["model"]["end_of_word_suffix"] or ""
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        pattern = next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split")
        self.split = regex.compile(pattern.replace("\\s", WHITE))
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.space = regex.compile(f"[{WHITE}]+")
        self.odd = regex.compile("[\x1c-\x1f]")
        self.path = path
        self.assigned: set[str] = set()
        self.inner = np.array([vocab.get(c, -1) for c in byte_symbols()], np.int64)
        self.last = np.array([vocab.get(c + suffix, -1) for c in byte_symbols()], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        key = (left << 32) | right
        self.rank_of = dict(zip(key.tolist(), range(len(key))))
        self._table(key)
        self.merged = self.merged.astype(np.int32)
        self.cache: dict[str | int, tuple[str, str, int]] = {}
        self.older: dict[str | int, tuple[str, str, int]] = {}

    def _table(self, key: np.ndarray) -> None:
        """Pairs in an open-addressing table at a load of at most a quarter."""
        self.bits = max(4, int(4 * len(key)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.slot_rank = np.full(1 << self.bits, -1, np.int32)
        todo = np.arange(len(key))
        at = self._slot(key)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = key[todo[free]]
            won = self.slots[at] == key[todo]
            self.slot_rank[at[won]] = todo[won]
            todo, at = todo[~won], (at[~won] + 1) & (len(self.slots) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def units(self, text: str) -> list[str | int]:
        """Pieces of the text between white space, raw; ints are special tokens.

        No word, normalised or not, crosses white space, so pieces can be encoded apart.
        """
        if self.cut is None or self.cut.search(text) is None:
            return self._apart(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += self._apart(text[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self._apart(text[at:])

    def _apart(self, text: str) -> list[str]:
        # str.split() also cuts at four separators that the pattern keeps as symbols
        return text.split() if self.odd.search(text) is None else [x for x in self.space.split(text) if x]

    @cached_property
    def lib(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _unassigned(self, unit: str) -> bool:
        """Whether Python's tables lack one of the unit's code points; those that they have are remembered."""
        if self.assigned.issuperset(unit):
            return False
        if any(unicodedata.category(c) == "Cn" for c in unit):
            return True
        self.assigned.update(unit)
        return False

    def _words(self, unit: str) -> list[str]:
        if not unit.isascii():
            if self._unassigned(unit):
                # code points that this Python's tables don't know: their case and kind are the library's to tell
                unit = self.lib.normalizer.normalize_str(unit)
                return [unit[a:b] for _, (a, b) in self.lib.pre_tokenizer.pre_tokenize_str(unit)]
            # lower case goes by single characters: a final sigma isn't special
            unit = unicodedata.normalize("NFC", unit).replace("\u03a3", "\u03c3")
        unit = unit.lower()
        return [unit] if unit.isalpha() else self.split.findall(unit)

    def _pair_keys(self, a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        key = (a.astype(np.int64) << 32) | b
        slot = self._slot(key)
        got = self.slots[slot]
        out = np.where((got == key) & (b >= 0), (self.slot_rank[slot] << 8) | at, NONE)
        more = np.flatnonzero((got != key) & (got >= 0) & (b >= 0))
        while len(more):
            slot[more] = (slot[more] + 1) & (len(self.slots) - 1)
            got = self.slots[slot[more]]
            hit = more[got == key[more]]
            out[hit] = (self.slot_rank[slot[hit]] << 8) | at[hit]
            more = more[(got != key[more]) & (got >= 0)]
        return out

    def encode_words(self, words: list[str]) -> list[list[int]]:
        raw = [w.encode() for w in words]
        out: list[list[int] | None] = [None] * len(words)
        size = np.array([len(b) for b in raw])
        for i in np.flatnonzero(size > LOCKSTEP):
            out[i] = self._alone(raw[i])
        leaves = 2
        while leaves <= LOCKSTEP:
            low = 0 if leaves == 2 else leaves // 2
            own = np.flatnonzero((size > low) & (size <= leaves))
            rows = max(1, CELLS // leaves)
            for k in range(0, len(own), rows):
                part = own[k : k + rows]
                for i, ids in zip(part, self._lockstep([raw[i] for i in part], leaves)):
                    out[i] = ids
            leaves *= 2
        return [x if x is not None else [] for x in out]

    def _symbols(self, b: bytes) -> list[int]:
        got = self.inner[np.frombuffer(b, np.uint8)]
        got[-1] = self.last[b[-1]]
        return [x for x in got.tolist() if x >= 0]

    def _lockstep(self, raw: list[bytes], leaves: int) -> list[list[int]]:
        n = len(raw)
        size = np.array([len(b) for b in raw])
        flat = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(size)
        code = self.inner[flat]
        code[ends - 1] = self.last[flat[ends - 1]]
        row = np.repeat(np.arange(n), size)
        if (code < 0).any():
            have = code >= 0
            code, row = code[have], row[have]
            size = np.bincount(row, minlength=n)
            ends = np.cumsum(size)
        col = np.arange(len(code)) - np.repeat(ends - size, size)
        sym = np.full((n, leaves + 1), -1, np.int32)
        sym[row, col] = code
        nxt = np.minimum(np.arange(1, leaves + 2), leaves)[None, :].repeat(n, 0)
        nxt = np.where(nxt >= size[:, None], leaves, nxt)  # the spare column ends a word
        prv = np.arange(-1, leaves)[None, :].repeat(n, 0)
        tree = np.full((n, 2 * leaves), NONE, np.int32)
        at = np.arange(leaves, dtype=np.int32)
        tree[:, leaves:] = self._pair_keys(sym[:, :-1].ravel(), sym[:, 1:].ravel(), np.tile(at, n)).reshape(n, leaves)
        k = leaves
        while k > 1:
            half = k // 2
            tree[:, half:k] = np.minimum(tree[:, k : 2 * k : 2], tree[:, k + 1 : 2 * k : 2])
            k = half
        live = np.flatnonzero(tree[:, 1] != NONE)
        while len(live):
            root = tree[live, 1]
            i = root & 255
            j = nxt[live, i]
            new = self.merged[root >> 8]
            after, before = nxt[live, j], prv[live, i]
            sym[live, i] = new
            sym[live, j] = -1
            nxt[live, i] = after
            prv[live, after] = i
            has = before >= 0
            front = np.where(has, before, leaves - 1)
            tree[live, leaves + j] = NONE
            tree[live, leaves + i] = self._pair_keys(new, sym[live, after], i)
            r = live[has]
            if len(r):
                b = before[has]
                tree[r, leaves + b] = self._pair_keys(sym[r, b], new[has], b)
            for x in (j, i, front):
                p = (leaves + x) >> 1
                while p[0]:
                    tree[live, p] = np.minimum(tree[live, 2 * p], tree[live, 2 * p + 1])
                    p = p >> 1
            live = live[tree[live, 1] != NONE]
        keep = sym[:, :-1] >= 0
        ids = sym[:, :-1][keep].tolist()
        cut = np.concatenate([[0], np.cumsum(keep.sum(axis=1))]).tolist()
        return [ids[a:b] for a, b in zip(cut[:-1], cut[1:])]

    def _alone(self, b: bytes) -> list[int]:
        sym = self._symbols(b)
        n = len(sym)
        leaves = 1
        while leaves < max(2, n):
            leaves *= 2
        far = 1 << 62
        rank_of, merged = self.rank_of, self.merged

        def leaf(x: int, y: int, at: int) -> int:
            r = rank_of.get((x << 32) | y)
            return far if r is None else (r << 32) | at

        tree = [far] * (2 * leaves)
        for i in range(n - 1):
            tree[leaves + i] = leaf(sym[i], sym[i + 1], i)
        for k in range(leaves - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        nxt, prv = list(range(1, n + 1)), list(range(-1, n))

        def put(at: int, value: int) -> None:
            k = leaves + at
            tree[k] = value
            k >>= 1
            while k:
                tree[k] = min(tree[2 * k], tree[2 * k + 1])
                k >>= 1

        while tree[1] != far:
            i = tree[1] & 0xFFFFFFFF
            j = nxt[i]
            sym[i] = int(merged[tree[1] >> 32])
            sym[j] = -1
            nxt[i] = nxt[j]
            prv[nxt[j]] = i
            put(j, far)
            put(i, leaf(sym[i], sym[nxt[i]], i) if nxt[i] < n else far)
            if prv[i] >= 0:
                put(prv[i], leaf(sym[prv[i]], sym[i], prv[i]))
        return [x for x in sym if x >= 0]

    def learn(self, units) -> None:
        """Puts the encodings of units into the cache: ids and tokens as text, and their number.

        Two generations: pieces of the older one return to the newer when they occur again.
        """
        if len(self.cache) > KEPT:
            self.older, self.cache = self.cache, {}
        cache, older, new = self.cache, self.older, []
        for u in units:
            if u not in cache:
                if (e := older.get(u)) is not None:
                    cache[u] = e
                else:
                    new.append(u)
        cut = [self._words(u) if isinstance(u, str) else () for u in new]
        words = list({w for ws in cut for w in ws})
        tokens = self.tokens
        known = {w: (" ".join(map(str, own)), " ".join([tokens[i] for i in own]), len(own)) for w, own in zip(words, self.encode_words(words))}
        for u, ws in zip(new, cut):
            if len(ws) == 1:
                cache[u] = known[ws[0]]
            elif isinstance(u, str):
                own = [e for w in ws if (e := known[w])[2]]
                cache[u] = (" ".join([e[0] for e in own]), " ".join([e[1] for e in own]), sum([e[2] for e in own]))
            else:
                cache[u] = (str(u), tokens[u], 1)

    def forget(self) -> None:
        self.cache.clear()
        self.older.clear()

    def encode(self, text: str | None) -> list[int]:
        units = self.units(text or "")
        self.learn(set(units))
        return [int(i) for u in units for i in self.cache[u][0].split()]

    def decode(self, ids) -> str:
        """The library's decoding without a decoder: tokens joined by spaces; unknown ids are left out."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


COLUMNS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, tokenizer: str, with_ids: bool = False) -> DataFrame:
    """Per row of docs (doc_id, text): token count, digests of ids and decoded text, and, if asked, the ids."""

    small_batches(docs.sparkSession)

    def run(batches):
        bpe = load(tokenizer)
        gc.set_threshold(200_000, 50, 100)  # the caches hold no cycles
        try:
            for batch in batches:
                data, offs = text_buffer(batch.column(1))
                for i, j in chunks(offs, ENCODE_BYTES):
                    cut = [bpe.units(data[a:b].tobytes().decode("utf-8", "replace")) for a, b in zip(offs[i:j], offs[i + 1 : j + 1])]
                    bpe.learn(set().union(*cut))
                    got = bpe.cache
                    sizes, ids, texts, lists = [], [], [], []
                    for words in cut:
                        parts = [e for w in words if (e := got[w])[2]]
                        line = " ".join([e[0] for e in parts])
                        sizes.append(sum([e[2] for e in parts]))
                        ids.append(hashlib.sha256(line.encode()).hexdigest())
                        texts.append(hashlib.sha256(" ".join([e[1] for e in parts]).encode()).hexdigest())
                        if with_ids:
                            lists.append([int(x) for x in line.split()])
                    cols = [batch.column(0).slice(i, j - i), pa.array(sizes, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())]
                    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                    if with_ids:
                        cols.append(pa.array(lists, pa.list_(pa.int32())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(cols, names=names)
                    del cut, parts, cols, sizes, ids, texts, lists
                    release()
        finally:
            # idle workers keep the model, not its pieces: the executor's memory is for the next stage
            bpe.forget()
            gc.collect()
            release()

    return docs.select("doc_id", "text").mapInArrow(run, COLUMNS + (", ids array<int>" if with_ids else ""))
