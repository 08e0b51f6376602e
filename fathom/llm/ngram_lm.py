"""N-gram language model in an Elias-Fano trie.

Level 1 is the vocabulary: words by ascending hash, with counts and back-off
weights. Levels 2 and 3 are cut into files by a hash of an n-gram's first two
words, so no file grows with one frequent word. In a file, the first words
that it holds are an Elias-Fano sequence; each points to its successors, and
each of those to its own: monotone pointers and, made monotone by the last
value of the range before, the successors' ids, both in Elias-Fano form, with
16-bit quantised log probabilities and back-off weights. Files lie in the
shared folder and are memory-mapped by every task. A word's node is found by
successor search relative to its context.

Smoothing: absolute discounting with Ney's estimate, interpolated down to the
add-0.1 unigram. A node holds the discounted probability; a query adds to it
the context's back-off weight times the lower order's probability, so that
probabilities of a context sum to one (up to quantisation). All n-grams that
occur are kept.

Texts are read twice to train: once for the vocabulary, once for trigrams,
whose counts tell the bigrams': all but those that end a text go on to one
trigram each. A task sums its n-grams before it sends them, sorted and packed.

Defined cases: a null or empty text is the end token alone; unknown words
have count 0, and no n-gram holds them; rows that repeat count each time;
without training documents every token has the uniform probability 1 of the
one unknown type.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .eliasfano import EliasFano, load, save
from .shared import discard, local_path, ranges_for, remove, settle, shared_folder, write_file
from .textkit import U64, Words, chunks, mix64, pack, release, text_buffer, unpack

#: Tokens whose n-grams a task sums before it sends them, and that it scores together; two words' numbers among them fit 42 bits.
HELD, SCORED = 3 << 19, 1 << 20
RANK_BITS = U64(21)
#: Training tokens for each file of n-grams.
FILE_TOKENS = 4 << 20
STEP = 4096.0  # quantisation: steps per unit of log10
END = 0  # the end token's id; its hash is reserved
#: Slots of a task's table of frequent words.
MEMO = 1 << 17


@dataclass(frozen=True)
class LmRules:
    add: float = 0.1


@dataclass
class Trie:
    """What tasks get: paths and a few sums; the levels themselves stay in files."""

    rules: LmRules
    vocab: list[str] = field(default_factory=list)
    vocab_base: list[int] = field(default_factory=list)
    total: int = 0
    distinct: int = 0
    #: training documents, each with one end token
    end_count: int = 0
    #: files of n-grams by number, and whether their probabilities are there
    ngrams: list[str] = field(default_factory=list)
    ready: bool = False
    #: nodes of the last level
    nodes: int = 0

    def key(self) -> tuple:
        return (*self.vocab[:1], len(self.ngrams), self.ready)


def quantise(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-x * STEP), 0, 65535).astype(np.uint16)


#: 10 to the power of each quantised value.
POWER = 10.0 ** (np.arange(1 << 16) / -STEP)


def _kind(n: int):
    return np.dtype("<u4") if n < 1 << 32 else np.dtype("<u8")


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return (((h >> U64(32)) * U64(shards)) >> U64(32)).astype(np.int64)


def pair_shard(a: np.ndarray, b: np.ndarray, shards: int) -> np.ndarray:
    """The file of n-grams that begin with two words."""
    with np.errstate(over="ignore"):
        out = shard_of(mix64(a.astype(U64) * U64(0x9E3779B97F4A7C15) + b.astype(U64)), shards)
    return out.astype(np.uint16) if shards <= 1 << 16 else out


def by_shard(shard: np.ndarray):
    """(shard, its places) of each shard that occurs; places ascend."""
    order = np.argsort(shard, kind="stable")
    s = shard[order]
    at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, int)
    for a, b in zip(at, np.append(at[1:], len(s))):
        yield int(s[a]), order[a:b]


# --- vocabulary -----------------------------------------------------------


def cell_of(h: np.ndarray, bits: int) -> np.ndarray:
    """A word's cell in its file's directory, from hash bits that don't choose the file."""
    return ((h & U64(0xFFFFFFFF)) >> U64(32 - bits)).astype(np.int64)


class Vocabulary:
    """Word ids by hash: END, then words in ascending order over all files."""

    def __init__(self, trie: Trie):
        self.trie = trie
        self.files = [load(p) for p in trie.vocab]
        self.backs = [load(f"{p}.back")["back"] for p in trie.vocab] if trie.ready else []
        self.base = np.array(trie.vocab_base, np.int64)
        self.memo = np.zeros(MEMO, U64), np.full(MEMO, -1, np.int64), np.zeros(MEMO, np.int64)

    def ids(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, count) of word hashes. The most frequent word of each slot is kept at hand."""
        key, ids, counts = self.memo
        slot = (h & U64(MEMO - 1)).astype(np.int64)
        out, count = ids[slot], counts[slot]
        miss = np.flatnonzero(key[slot] != h)
        if len(miss):
            u, place = np.unique(h[miss], return_inverse=True)
            got, n = self._find(u)
            out[miss], count[miss] = got[place], n[place]
            order = np.argsort(n)  # of one slot the last, most frequent, stays
            u, got, n = u[order], got[order], n[order]
            slot = (u & U64(MEMO - 1)).astype(np.int64)
            more = n > counts[slot]
            slot = slot[more]
            key[slot], ids[slot], counts[slot] = u[more], got[more], n[more]
        return out, count

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out, count = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        for s, own in by_shard(shard_of(h, max(1, len(self.files)))):
            if not self.files:
                break
            f = self.files[s]
            key, bits = h[own], int(f["bits"][0])
            cell = cell_of(key, bits)
            at, stop = f["dir"][cell].astype(np.int64), f["dir"][cell + 1].astype(np.int64)
            live = np.flatnonzero(at < stop)
            while len(live):
                got = f["hash"][at[live]]
                hit = live[got == key[live]]
                out[own[hit]] = at[hit] + self.base[s]
                count[own[hit]] = f["count"][at[hit]]
                live = live[got != key[live]]
                at[live] += 1
                live = live[at[live] < stop[live]]
        return out, count

    def _each(self, ids: np.ndarray):
        s = np.searchsorted(self.base, ids, "right") - 1
        for k in np.unique(s):
            own = np.flatnonzero(s == k)
            yield int(k), own, ids[own] - self.base[k]

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Counts of word ids above END."""
        out = np.zeros(len(ids), np.int64)
        for k, own, at in self._each(ids):
            out[own] = self.files[k]["count"][at]
        return out

    def back(self, ids: np.ndarray) -> np.ndarray:
        """Back-off weights of word ids above END."""
        out = np.ones(len(ids))
        for k, own, at in self._each(ids):
            out[own] = POWER[self.backs[k][at]]
        return out

    def tokens(self, data: np.ndarray, offs: np.ndarray, i: int, j: int, ends: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, with ends times END after each document, counts, tokens of each document) of documents [i, j)."""
        ids, counts, sizes = [], [], []
        for a, b in chunks(offs[i : j + 1]):
            w = Words(data, offs, i + a, i + b, lower=True)
            got, n = self.ids(w.hashes())
            size = w.count + ends
            inner = np.ones(int(size.sum()), bool)
            stop = np.cumsum(size)
            for k in range(1, ends + 1):
                inner[stop - k] = False
            all_ids, all_n = np.full(len(inner), END, np.int64), np.full(len(inner), self.trie.end_count, np.int64)
            all_ids[inner], all_n[inner] = got, n
            ids.append(all_ids), counts.append(all_n), sizes.append(size)
        return np.concatenate(ids), np.concatenate(counts), np.concatenate(sizes)


def _vocabulary(training: DataFrame, folder: str, trie: Trie) -> None:
    root, shards = local_path(folder), ranges_for(training)

    def count(batches):
        for batch in batches:
            data, offs = text_buffer(batch.column(0))
            hs, ns, docs = [], [], 0
            for i, j in chunks(offs):
                w = Words(data, offs, i, j, lower=True)
                docs += j - i
                u, n = np.unique(w.hashes(), return_counts=True)
                hs.append(u), ns.append(n)
            if not docs:
                continue
            u, place = np.unique(np.concatenate(hs), return_inverse=True)
            n = np.bincount(place, np.concatenate(ns), len(u)).astype("<u4")  # a batch's counts fit
            rows = [(s, u[own].tobytes(), n[own].tobytes(), 0) for s, own in by_shard(shard_of(u, shards))] + [(-1, b"", b"", docs)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.int64()))], names=["shard", "h", "n", "docs"])
            release()

    packed = training.select("text").mapInArrow(count, "shard int, h binary, n binary, docs long")

    def merge(table: pa.Table) -> pa.Table:
        s = table.column("shard")[0].as_py()
        docs = sum(table.column("docs").to_pylist())
        h = np.frombuffer(b"".join(table.column("h").to_pylist()), "<u8")
        n = np.frombuffer(b"".join(table.column("n").to_pylist()), "<u4").astype(np.int64)
        path = ""
        if s >= 0:
            h, place = np.unique(h, return_inverse=True)
            n = np.bincount(place, n, len(h)).astype(np.int64)
            bits = min(32, max(0, len(h).bit_length() - 1))
            cell = cell_of(h, bits)
            order = np.lexsort((h, cell))
            h, n, cell = h[order], n[order], cell[order]
            path = f"{root}/level1-{s:06d}.fef"
            start = np.searchsorted(cell, np.arange((1 << bits) + 1))
            write_file(path, save({"bits": np.array([bits], np.int64), "dir": start.astype(np.uint32), "hash": h, "count": n.astype(_kind(int(n.max())))}))
        return pa.table({"shard": pa.array([s], pa.int32()), "path": [path], "words": pa.array([len(h)], pa.int64()), "total": pa.array([int(n.sum()) + docs], pa.int64()), "docs": pa.array([docs], pa.int64())})

    made = packed.groupBy("shard").applyInArrow(merge, "shard int, path string, words long, total long, docs long").collect()  # a row per shard
    by = {r["shard"]: r for r in made}
    empty = f"{root}/level1-none.fef"
    write_file(empty, save({"bits": np.zeros(1, np.int64), "dir": np.zeros(2, np.uint32), "hash": np.zeros(0, np.uint64), "count": np.zeros(0, np.uint32)}))
    write_file(f"{empty}.back", save({"back": np.zeros(0, np.uint16)}))
    at = END + 1
    for s in range(shards):
        trie.vocab.append(by[s]["path"] if s in by else empty)
        trie.vocab_base.append(at)
        at += by[s]["words"] if s in by else 0
    trie.total = sum(r["total"] for r in made)
    trie.end_count = sum(r["docs"] for r in made)
    trie.distinct = at - 1 + (1 if trie.total else 0)


# --- n-grams --------------------------------------------------------------


def _trigrams(ids: np.ndarray):
    """(first, second, third, count) of the distinct trigrams that begin with a word; texts end with two END."""
    for a in range(0, max(0, len(ids) - 2), HELD):
        u, r = np.unique(ids[a : a + HELD + 2], return_inverse=True)
        r = r.astype(U64)
        key = (r[:-2] << (RANK_BITS * U64(2))) | (r[1:-1] << RANK_BITS) | r[2:]
        key, n = np.unique(key[ids[a : a + len(key)] > END], return_counts=True)
        mask = (U64(1) << RANK_BITS) - U64(1)
        yield u[(key >> (RANK_BITS * U64(2))).astype(np.int64)], u[((key >> RANK_BITS) & mask).astype(np.int64)], u[(key & mask).astype(np.int64)], n


def _summed(w1: np.ndarray, w2: np.ndarray, w3: np.ndarray, n: np.ndarray, bits: int) -> tuple[np.ndarray, ...]:
    """Distinct trigrams in order, with the sums of n."""
    if 3 * bits <= 64:
        b = U64(bits)
        key = (((w1.astype(U64) << b) | w2) << b) | w3
        order = np.argsort(key)
        key = key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
    else:
        # ids below 2**32 pack two and two
        pair = (w1.astype(U64) << U64(32)) | w2 if bits <= 32 else None
        order = np.lexsort((w3, pair) if pair is not None else (w3, w2, w1))
        new = np.concatenate([[True], np.any([x[order][1:] != x[order][:-1] for x in ((w3, pair) if pair is not None else (w3, w2, w1))], axis=0)])
    at = np.flatnonzero(new)
    first = order[at]
    return w1[first], w2[first], w3[first], np.add.reduceat(n[order], at)


def _lifted(words: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Ids from 1, raised by the last value of the range before; begins: of each range, none empty."""
    if not len(words):
        return np.zeros(0, np.int64)
    ends = np.append(begins[1:], len(words)) - 1
    lifts = np.concatenate([[0], np.cumsum(words[ends].astype(np.int64) + 1)[:-1]])
    return words.astype(np.int64) + 1 + np.repeat(lifts, np.diff(np.append(begins, len(words))))


def _ngrams(training: DataFrame, folder: str, trie: Trie) -> None:
    """Counts n-grams, writes their files and, when the discounts are known, probabilities and back-off weights."""
    spark, root = training.sparkSession, local_path(folder)
    shards = max(ranges_for(training), -(-trie.total // FILE_TOKENS))
    kind, bits = _kind(trie.distinct), max(1, int(trie.distinct).bit_length())
    base = np.array(trie.vocab_base, np.int64)

    def count(batches):
        v = opened(trie).vocabulary

        def rows(parts):
            out: dict[int, bytes] = {}
            for w1, w2, w3, n in _trigrams(np.concatenate(parts)):
                for s, own in by_shard(pair_shard(w1, w2, shards)):
                    out[s] = pack([x[own] for x in (w1, w2, w3, n)], kind)
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array(list(out.values()), pa.binary())], names=["shard", "blob"])
                out.clear()

        held, size = [], 0
        for batch in batches:
            data, offs = text_buffer(batch.column(0))
            for i, j in chunks(offs):
                held.append(v.tokens(data, offs, i, j, 2)[0])
                size += len(held[-1])
                if size >= HELD:
                    yield from rows(held)
                    held, size = [], 0
                    release()
        if held:
            yield from rows(held)
        held = None
        release()

    def merge(table: pa.Table) -> pa.Table:
        s = table.column("shard")[0].as_py()
        parts = [unpack(b, 4, kind) for b in table.column("blob").to_pylist()]
        w1, w2, w3, n = _summed(*(np.concatenate([p[k] for p in parts]) for k in range(3)), np.concatenate([p[3] for p in parts]).astype(np.int64), bits)
        del parts
        pair = np.flatnonzero(np.concatenate([[True], (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])]))
        n2 = np.add.reduceat(n, pair)
        a, b = w1[pair], w2[pair]
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        # after END there is no third word: such a pair has no successors
        real = w2 != END
        third, n3 = w3[real], n[real]
        begin3 = np.concatenate([[0], np.cumsum(real)])[np.append(pair, len(w1))]
        arrays = EliasFano.build(a[first], "firsts") | EliasFano.build(np.append(first, len(a)), "p2") | EliasFano.build(_lifted(b, first), "words2")
        arrays |= EliasFano.build(begin3, "p3") | EliasFano.build(_lifted(third, begin3[:-1][b != END]), "words3")
        path = f"{root}/ngrams-{s:07d}.fef"
        write_file(path, save(arrays))
        del arrays
        top = max(int(n2.max()), 1)
        small = np.uint8 if top < 256 else np.uint16 if top < 1 << 16 else _kind(top)
        write_file(f"{root}/counts/{s:07d}.fef", save({"n2": n2.astype(small), "n3": n3.astype(small)}))
        sums = [int((x == k).sum()) for x in (n2, n3) for k in (1, 2)]
        # how many words follow each first word here, by the file of the vocabulary
        word, after = a[first].astype(np.int64), np.diff(np.append(first, len(a)))
        rows = [(-1, s, path, *sums, len(n3), b"")]
        for f, own in by_shard(np.searchsorted(base, word, "right") - 1):
            rows.append((f, s, "", 0, 0, 0, 0, 0, pack([word[own], after[own]], kind)))
        release()
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), MADE.values())], names=list(MADE))

    packed = training.select("text").mapInArrow(count, "shard int, blob binary")
    made = settle(packed.groupBy("shard").applyInArrow(merge, "file int, shard int, path string, one2 long, two2 long, one3 long, two3 long, nodes long, blob binary"), "ngrams")
    files = made.filter("file = -1").drop("blob").collect()  # a row per shard

    def discount(one: int, two: int) -> float:
        return min(max(one / (one + 2 * two), 0.05), 0.999) if one + two else 0.5

    d2, d3 = (discount(sum(r[f"one{k}"] for r in files), sum(r[f"two{k}"] for r in files)) for k in (2, 3))
    vocab = trie.vocab

    def backs(table: pa.Table) -> pa.Table:
        f = table.column("file")[0].as_py()
        parts = [unpack(b, 2, kind) for b in table.column("blob").to_pylist()]
        count = load(vocab[f])["count"]
        after = np.bincount(np.concatenate([p[0] for p in parts]).astype(np.int64) - base[f], np.concatenate([p[1] for p in parts]), len(count))
        weight = np.where(after > 0, d2 * after / np.maximum(count, 1), 1.0)
        write_file(f"{vocab[f]}.back", save({"back": quantise(np.log10(weight))}))
        return pa.table({"file": pa.array([f], pa.int32())})

    made.filter("file >= 0").select("file", "blob").groupBy("file").applyInArrow(backs, "file int").collect()  # a row per file of the vocabulary

    def probabilities(batches):
        v = opened(trie).vocabulary
        for batch in batches:
            for s, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                f, n = load(path), load(f"{root}/counts/{s:07d}.fef")
                n2, n3 = n["n2"].astype(np.int64), n["n3"].astype(np.int64)
                firsts, p2, p3 = (EliasFano(f, x) for x in ("firsts", "p2", "p3"))
                total = np.repeat(v.counts(firsts.get(np.arange(firsts.m)).astype(np.int64)), np.diff(p2.get(np.arange(p2.m)).astype(np.int64)))
                after = np.diff(p3.get(np.arange(p3.m)).astype(np.int64))
                out = {"prob2": (n2 - d2) / total, "back2": np.where(after > 0, d3 * after / n2, 1.0), "prob3": (n3 - d3) / np.repeat(n2, after)}
                write_file(f"{path}.prob", save({k: quantise(np.log10(x)) for k, x in out.items()}))
                release()
            yield batch.select(["shard"])

    rows = made.filter("file = -1").select("shard", "path")
    rows.repartition(max(1, min(shards, 4 * spark.sparkContext.defaultParallelism))).mapInArrow(probabilities, "shard int").count()
    remove(spark, f"{folder}/counts")
    discard(made)
    by = {r["shard"]: r["path"] for r in files}
    trie.ngrams = [by.get(s, "") for s in range(shards)]
    trie.nodes = sum(r["nodes"] for r in files)
    trie.ready = True


MADE = dict(file=pa.int32(), shard=pa.int32(), path=pa.string(), one2=pa.int64(), two2=pa.int64(), one3=pa.int64(), two3=pa.int64(), nodes=pa.int64(), blob=pa.binary())


class NgramFile:
    """Levels 2 and 3 of the n-grams of one hash range."""

    def __init__(self, path: str):
        a = load(path)
        self.firsts, self.p2, self.words2, self.p3, self.words3 = (EliasFano(a, x) for x in ("firsts", "p2", "words2", "p3", "words3"))
        p = load(f"{path}.prob")
        self.prob2, self.back2, self.prob3 = p["prob2"], p["back2"], p["prob3"]

    @staticmethod
    def _among(pointers: EliasFano, words: EliasFano, ctx: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Place of each word among the successors of its context, or -1; contexts ascend and are there."""
        new = np.concatenate([[True], ctx[1:] != ctx[:-1]]) if len(ctx) else np.zeros(0, bool)
        own, run = ctx[new], np.cumsum(new) - 1
        begin, end = pointers.get(own).astype(np.int64), pointers.get(own + 1).astype(np.int64)
        before = np.zeros(len(own), U64)
        some = np.flatnonzero(begin > 0)
        before[some] = words.get(begin[some] - 1)
        at = words.find(before[run] + word.astype(U64) + U64(1))
        return np.where((at >= begin[run]) & (at < end[run]), at, -1)

    def pairs(self, w1: np.ndarray, w2: np.ndarray) -> np.ndarray:
        """Nodes of bigrams, or -1; they ascend."""
        new = np.concatenate([[True], w1[1:] != w1[:-1]])
        ctx = self.firsts.find(w1[new].astype(U64))[np.cumsum(new) - 1]
        out, live = np.full(len(w1), -1, np.int64), np.flatnonzero(ctx >= 0)
        out[live] = self._among(self.p2, self.words2, ctx[live], w2[live])
        return out

    def thirds(self, node: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Nodes of trigrams, or -1, by their bigrams' nodes, which ascend."""
        return self._among(self.p3, self.words3, node, word)


class Model:
    """A trie opened by a task."""

    def __init__(self, trie: Trie):
        self.trie = trie
        self.vocabulary = Vocabulary(trie)
        self.files = [NgramFile(p) if p else None for p in trie.ngrams] if trie.ready else []

    def unigram(self, count: np.ndarray) -> np.ndarray:
        t, a = self.trie, self.trie.rules.add
        return (count + a) / (t.total + a * (t.distinct + 1))

    def probabilities(self, ids: np.ndarray, count: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The model's probability of each token; first: where documents begin."""
        prob = self.unigram(count)
        if len(ids) < 2 or not self.files:
            return prob
        u, r = np.unique(ids, return_inverse=True)
        inner = np.ones(len(ids), bool)
        inner[first] = False
        known = ids > END  # a context: a known word, as nothing follows an end
        at = np.flatnonzero(inner[1:] & known[:-1]) + 1
        word, place = np.unique(r[at - 1], return_inverse=True)
        prob[at] *= self.vocabulary.back(u[word])[place]
        # each bigram once and in order: repeats cost nothing, and reads go forward
        at = at[ids[at] >= 0]
        key, place = np.unique((r[at - 1].astype(U64) << RANK_BITS) | r[at].astype(U64), return_inverse=True)
        w1, w2 = u[(key >> RANK_BITS).astype(np.int64)], u[(key & ((U64(1) << RANK_BITS) - U64(1))).astype(np.int64)]
        shard = pair_shard(w1, w2, len(self.files))
        node, p2, back = np.full(len(key), -1, np.int64), np.zeros(len(key)), np.ones(len(key))
        for s, own in by_shard(shard):
            f = self.files[s]
            if f is None:
                continue
            got = f.pairs(w1[own], w2[own])
            hit = got >= 0
            node[own] = got
            p2[own[hit]], back[own[hit]] = POWER[f.prob2[got[hit]]], POWER[f.back2[got[hit]]]
        prob[at] += p2[place]
        bigram = np.full(len(ids), -1, np.int64)  # of each token and the one before
        bigram[at] = np.where(node[place] >= 0, place, -1)
        # a token's context: the bigram that ends before it, whose second word isn't an end
        at = np.flatnonzero(inner[1:] & (bigram[:-1] >= 0) & known[:-1]) + 1
        prob[at] *= back[bigram[at - 1]]
        at = at[ids[at] >= 0]
        key, place = np.unique((bigram[at - 1].astype(U64) << RANK_BITS) | r[at].astype(U64), return_inverse=True)
        pair, word = (key >> RANK_BITS).astype(np.int64), u[(key & ((U64(1) << RANK_BITS) - U64(1))).astype(np.int64)]
        p3 = np.zeros(len(key))
        for s, own in by_shard(shard[pair]):
            f = self.files[s]
            got = f.thirds(node[pair[own]], word[own])
            hit = got >= 0
            p3[own[hit]] = POWER[f.prob3[got[hit]]]
        prob[at] += p3[place]
        return prob


@lru_cache(maxsize=1)
def _open(key: tuple) -> Model:
    return Model(_held[0])


_held: list[Trie] = []


def opened(trie: Trie) -> Model:
    """The task's model; a worker keeps one."""
    _held[:] = [trie]
    return _open(trie.key())


def train(docs: DataFrame, rules: LmRules = LmRules()) -> Trie:
    """A trie of all of docs' texts, written to the shared folder."""
    folder = shared_folder(docs.sparkSession)
    trie = Trie(rules)
    _vocabulary(docs, folder, trie)
    _ngrams(docs, folder, trie)
    return trie


COLUMNS = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def score(docs: DataFrame, trie: Trie) -> DataFrame:
    """Per row of docs (doc_id, text): tokens, known tokens, the unigram base and the model's log10 probability."""

    def run(batches):
        m = opened(trie)
        for batch in batches:
            data, offs = text_buffer(batch.column(1))
            for i, j in chunks(offs, 6 * SCORED):
                ids, n, size = m.vocabulary.tokens(data, offs, i, j, 1)
                k, first = j - i, np.cumsum(size) - size
                doc = np.repeat(np.arange(k), size)
                prob = np.empty(len(ids))
                # a long document is scored in pieces that begin two tokens early
                for a in range(0, len(ids), SCORED):
                    lead = min(a, 2)
                    begins = first[(first >= a - lead) & (first < a + SCORED)] - (a - lead)
                    prob[a : a + SCORED] = m.probabilities(ids[a - lead : a + SCORED], n[a - lead : a + SCORED], np.union1d(begins, [0]))[lead:]
                cols = [size, np.bincount(doc[n > 0], minlength=k), np.bincount(doc, np.log10(m.unigram(n)), k), np.bincount(doc, np.log10(prob), k)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, k), *(pa.array(c) for c in cols)], names=[c.split()[0] for c in COLUMNS.split(", ")])
                del ids, n, doc, prob
                release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, COLUMNS)
