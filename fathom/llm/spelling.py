"""Spelling variants: every word's neighbours at edit distance one, over the corpus's whole vocabulary.

The vocabulary, sorted by Spark, is cut into shards of bounded size, each a
compact trie: edges hold whole strings, children stand side by side in
arrays. Shards are broadcast in rounds of bounded size; in a round each word's
Levenshtein automaton of distance one runs through every shard depth-first.
The automaton spends its edit where a path first departs from the word, so
each neighbour is accepted on one path only, and the rest is compared whole.
What a word's shards yield is summed to its count and best form before the
shuffle that brings rounds together.

A form has at least twice its word's count, so chains of forms end within the
logarithm of the largest count, and pointer jumping finds their ends in the
logarithm of that.

Code points are U+00C0..U+00FF and ASCII letters only, so words are handled as
Latin-1, a byte each. Defined cases: a null text has no words; a null doc_id
counts as an empty one in the hash; repeated rows count again; an empty table
gives no rows; words and texts have any length; other columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, settle, small_batches
from .spans import byte_class, gathered, runs, span_crc32
from .textkit import LOWER, chunks, release, text_buffer

ASCII = byte_class((0x41, 0x5A), (0x61, 0x7A))
#: Leads U+00C0..U+00FF; the byte after it is 0x40 less than the code point.
LEAD = 0xC3
#: Every so many'th run, by hash, loses a code point.
SLIP = 97


@dataclass(frozen=True)
class SpellingRules:
    least_chars: int = 5
    least_count: int = 3
    #: A form's count is at least this many times its word's.
    times: int = 2
    #: Bytes of a trie shard; a single longer word makes a larger one.
    shard_bytes: int = 4 << 20
    #: Bytes of shards broadcast at once.
    round_bytes: int = 48 << 20


# --- words --------------------------------------------------------------------


def word_array(data: np.ndarray, offs: np.ndarray, ids: list, least: int) -> pa.Array:
    """The words of texts (bounds offs, from 0), slips applied, as binary Latin-1; those under least code points are left out."""
    lead = data == LEAD
    second = np.zeros(len(data), bool)
    second[1:] = lead[:-1]
    letter = ASCII[data] | lead | second
    start, end, first = runs(letter, offs)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    # a code point's place is its last byte; ends of runs always are
    place = np.concatenate([[0], np.cumsum(~lead)])
    size = place[end] - place[start]
    held = size >= least
    start, end, doc, size = start[held], end[held], doc[held], size[held]
    before = np.fromiter((zlib.crc32(f"{'' if x is None else x}:".encode()) for x in ids), np.uint32, len(ids))
    h = span_crc32(LOWER[data], start, end, before[doc]).astype(np.int64)
    slips = np.flatnonzero(h % SLIP == 0)
    points = np.where(second, data + np.uint8(0x40), LOWER[data])[~lead]
    flat, at = gathered(points, place[start], size)
    keep = np.ones(len(flat), bool)
    keep[at[slips] + h[slips] % size[slips]] = False
    size = size.copy()
    size[slips] -= 1
    at = np.concatenate([[0], np.cumsum(size)])
    words = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(flat[keep])])
    return words.filter(pa.array(size >= least)) if len(slips) else words


#: Distinct words that a task sums before it hands them on.
HELD_WORDS = 400_000


def vocabulary(docs: DataFrame, rules: SpellingRules = SpellingRules()) -> DataFrame:
    """docs: doc_id, text. word, n of the words that occur often enough."""
    small_batches(docs.sparkSession)

    def count(batches):
        held = []

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

        def out(t: pa.Table):
            for k in range(0, t.num_rows, 1 << 16):
                part = t.slice(k, 1 << 16)
                yield pa.RecordBatch.from_arrays([part["word"].combine_chunks().cast(pa.binary()), part["n"].combine_chunks()], names=["word", "n"])

        for batch in batches:
            data, offs = text_buffer(batch.column(1))
            ids = batch.column(0).to_pylist()
            for i, j in chunks(offs):
                words = word_array(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], ids[i:j], rules.least_chars)
                counts = pc.value_counts(words)
                held.append(pa.table({"word": counts.field(0), "n": counts.field(1)}))
            del data
            if sum(t.num_rows for t in held) > HELD_WORDS:
                held = [summed()]
                if held[0].num_rows > HELD_WORDS // 2:
                    yield from out(held.pop())
            release()
        if held:
            yield from out(summed())

    counted = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(count, "word binary, n long")
    often = counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= rules.least_count)
    return often.select(F.decode("word", "ISO-8859-1").alias("word"), "n")


# --- tries --------------------------------------------------------------------


@dataclass
class Trie:
    """Nodes in breadth-first order, the root first. Node k's children are first[k] to first[k + 1]; the edge into k is pool[at[k] : at[k + 1]], its first byte heads[k]; n[k] is its word's count, 0 if none ends there."""

    heads: bytes
    first: array
    at: array
    pool: bytes
    n: array

    def size(self) -> int:
        return len(self.heads) * 17 + len(self.pool)


def build(words: list[bytes], counts: list[int]) -> Trie:
    """A trie of sorted, distinct words."""
    heads, first, at, pool, n = bytearray(b"\0"), array("I"), array("I", [0, 0]), bytearray(), array("q")
    level = [(0, len(words), 0)]  # words[lo:hi] share their first depth bytes
    while level:
        below = []
        for lo, hi, depth in level:
            ends = lo < hi and len(words[lo]) == depth
            n.append(counts[lo] if ends else 0)
            first.append(len(heads))
            a = lo + ends
            while a < hi:
                head = words[a][depth]
                b = bisect_right(words, head, a, hi, key=lambda w: w[depth])
                x, y = words[a], words[b - 1]
                end = len(x) if b == a + 1 else depth + common(x, y, depth, depth)
                heads.append(head)
                pool += x[depth:end]
                at.append(len(pool))
                below.append((a, b, end))
                a = b
        level = below
    first.append(len(heads))
    return Trie(bytes(heads), first, at, bytes(pool), n)


def common(x: bytes, y: bytes, i: int, j: int) -> int:
    """Length of the common prefix of x[i:] and y[j:]."""
    most = min(len(x) - i, len(y) - j)
    k, step = 0, 8
    while k < most:
        m = min(step, most - k)
        if x[i + k : i + k + m] == y[j + k : j + k + m]:
            k += m
            step *= 2
        elif m == 1:
            return k
        else:
            step = max(1, m // 2)
            most = k + m
    return k


def neighbours(trie: Trie, word: bytes) -> Iterator[tuple[int, bytes]]:
    """(count, word) of the trie's words that differ from word by exactly one edit, depth-first."""
    heads, first, at, pool, n = trie.heads, trie.first, trie.at, trie.pool, trie.n
    length = len(word)

    def rest(node: int, j: int, i: int) -> int:
        """The node at which word[i:] ends, read without an edit from offset j of node's edge on; 0 if there is none or no word ends there."""
        while True:
            label = pool[at[node] + j : at[node + 1]]
            if not word.startswith(label, i):
                return 0
            i += len(label)
            if i == length:
                return node if n[node] else 0
            node = heads.find(word[i], first[node], first[node + 1])
            if node < 0:
                return 0
            j = 0

    def departs(node: int, j: int, i: int) -> Iterator[tuple[int, bytes]]:
        """word[:i] leads to offset j of node's edge, whose byte isn't word[i]: the edit is spent here."""
        head = pool[at[node] + j : at[node] + j + 1]
        if k := rest(node, j + 1, i):
            yield n[k], word[:i] + head + word[i:]
        if i < length:
            if k := rest(node, j + 1, i + 1):
                yield n[k], word[:i] + head + word[i + 1 :]
            if word[i + 1 : i + 2] == head and (k := rest(node, j, i + 1)):
                yield n[k], word[:i] + word[i + 1 :]

    node, i = 0, 0
    while True:
        if n[node] and i == length - 1:
            yield n[node], word[:i]
        lo, hi = first[node], first[node + 1]
        on = heads.find(word[i], lo, hi) if i < length else -1
        for child in range(lo, hi):
            if child != on:
                yield from departs(child, 0, i)
        if on < 0:
            return
        j = common(pool, word, at[on], i) if at[on + 1] - at[on] > 1 else 1
        j = min(j, at[on + 1] - at[on])
        if j < at[on + 1] - at[on]:
            yield from departs(on, j, i + j)
            return
        node, i = on, i + j


#: Words longer than this go through a trie one by one.
BLOCK_CHARS = 62
BLOCK_WORDS = 2048
INSERT, REPLACE, DELETE = range(3)


class Blocks:
    """neighbours() for many words at once: the states of a block of words go down a trie together, as arrays.

    States that have spent their edit are followed to their ends before the
    words go a code point further, so the descent is depth-first in blocks.
    """

    def __init__(self, trie: Trie):
        self.heads = np.frombuffer(trie.heads, np.uint8)
        self.first, self.at = np.array(trie.first, np.int64), np.array(trie.at, np.int64)
        self.pool = np.append(np.frombuffer(trie.pool, np.uint8), np.uint8(0))
        self.n = np.array(trie.n, np.int64)
        self.size = np.diff(self.at)
        bit = self._bit(self.heads)
        self.below = np.zeros(len(self.heads), np.uint64)  # bits of the children's heads
        held = np.flatnonzero(np.diff(self.first))
        if len(held):
            self.below[held] = np.bitwise_or.reduceat(bit, self.first[held])
        self.after = np.where(self.size > 1, self._bit(self.pool[np.minimum(self.at[:-1] + 1, len(self.pool) - 1)]), self.below)
        self.ends = (self.size == 1) & (self.n > 0)

    @staticmethod
    def _bit(c: np.ndarray) -> np.ndarray:
        return np.uint64(1) << (c & 63).astype(np.uint64)

    def _children(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row and the child of each child of node's rows."""
        lo = self.first[node]
        count = self.first[node + 1] - lo
        row = np.repeat(np.arange(len(node)), count)
        return row, np.repeat(lo - np.cumsum(count) + count, count) + np.arange(len(row))

    def _step(self, node: np.ndarray, j: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, node, offset) of the states that read char."""
        inside = j < self.size[node]
        a = np.flatnonzero(inside)
        a = a[self.pool[self.at[node[a]] + j[a]] == char[a]]
        b = np.flatnonzero(~inside)
        row, child = self._children(node[b])
        on = self.heads[child] == char[b][row]
        b, child = b[row[on]], child[on]
        return np.concatenate([a, b]), np.concatenate([node[a], child]), np.concatenate([j[a] + 1, np.ones(len(b), np.int64)])

    def near(self, words: list[bytes]) -> tuple[np.ndarray, ...]:
        """(word's place, neighbour's count, edit, place and byte of the edit) of each neighbour."""
        length = np.array([len(w) for w in words], np.int64)
        width = int(length.max(initial=0)) + 3
        chars = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
        found = []
        q, node, j = np.arange(len(words)), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for i in range(width - 2):
            if not len(q):
                break
            c = chars[q, i]
            inside = j < self.size[node]
            ended = ~inside & (self.n[node] > 0) & (length[q] == i + 1)
            if ended.any():
                self._record(found, q[ended], self.n[node[ended]], DELETE, i, np.zeros(int(ended.sum()), np.uint8))
            a, b = np.flatnonzero(inside), np.flatnonzero(~inside)
            head = self.pool[self.at[node[a]] + j[a]]
            on = head == c[a]
            off = a[~on]
            here, k = j[off] + 1, node[off]
            last = here == self.size[k]
            next_ = np.where(last, self.below[k], self._bit(self.pool[np.minimum(self.at[k] + here, len(self.pool) - 1)]))
            row, child = self._children(node[b])
            heads = self.heads[child]
            same = heads == c[b][row]
            away = ~same
            dep = (
                np.concatenate([q[off], q[b][row[away]]]), np.concatenate([k, child[away]]), np.concatenate([here, np.ones(int(away.sum()), np.int64)]),
                np.concatenate([head[~on], heads[away]]), np.concatenate([next_, self.after[child[away]]]), np.concatenate([last & (self.n[k] > 0), self.ends[child[away]]]),
            )
            self._depart(found, chars, length, i, *dep)
            q, node, j = np.concatenate([q[a[on]], q[b[row[same]]]]), np.concatenate([node[a[on]], child[same]]), np.concatenate([j[a[on]] + 1, np.ones(int(same.sum()), np.int64)])
        return tuple(np.concatenate(x) for x in zip(*found)) if found else tuple(np.zeros(0, np.int64) for _ in range(5))

    @staticmethod
    def _record(found: list, q, n, kind, i, head) -> None:
        found.append((q, n, np.broadcast_to(kind, q.shape), np.full(len(q), i), head))

    def _depart(self, found, chars, length, i, q, node, j, head, next_, ends) -> None:
        """The edit is spent on head, which was read at offset j - 1 of node's edge; next_ and ends say what may follow."""
        size = length[q]
        states = []
        for kind, pos in ((INSERT, i), (REPLACE, i + 1), (DELETE, i + 2)):
            if kind == DELETE:
                may = (i + 1 < size) & (chars[q, i + 1] == head)
            else:
                may = pos <= size
            over = may & (pos == size)
            done = np.flatnonzero(over & ends)
            if len(done):
                self._record(found, q[done], self.n[node[done]], kind, i, head[done])
            c = chars[q, np.minimum(pos, chars.shape[1] - 1)]
            on = np.flatnonzero(may & ~over & ((next_ >> (c & 63).astype(np.uint64)) & np.uint64(1)).astype(bool))
            states.append((q[on], node[on], j[on], np.full(len(on), pos), np.full(len(on), kind), head[on]))
        q, node, j, pos, kind, head = (np.concatenate(x) for x in zip(*states))
        while len(q):
            row, node, j = self._step(node, j, chars[q, pos])
            q, pos, kind, head = q[row], pos[row] + 1, kind[row], head[row]
            over = pos == length[q]
            done = np.flatnonzero(over & (j == self.size[node]) & (self.n[node] > 0))
            if len(done):
                self._record(found, q[done], self.n[node[done]], kind[done], i, head[done])
            go = ~over
            q, node, j, pos, kind, head = (x[go] for x in (q, node, j, pos, kind, head))


def edited(word: bytes, kind: int, i: int, head: int) -> bytes:
    return word[:i] + (b"" if kind == DELETE else bytes([head])) + word[i + (kind != INSERT) :]


def best_near(tries: list[tuple[Trie, Blocks]], words: list[bytes]) -> tuple[list[int], list[int | None], list[bytes | None]]:
    """Number of neighbours, and the best one's count and word, of each word over all tries."""
    total, count, form = [0] * len(words), [None] * len(words), [None] * len(words)

    def better(k: int, n: int, word: bytes) -> None:
        if count[k] is None or (-n, word) < (-count[k], form[k]):
            count[k], form[k] = n, word

    short = sorted((k for k, w in enumerate(words) if len(w) <= BLOCK_CHARS), key=words.__getitem__)
    for lo in range(0, len(short), BLOCK_WORDS):
        block = short[lo : lo + BLOCK_WORDS]
        held = [words[k] for k in block]
        q, n, kind, i, head = (np.concatenate(x) for x in zip(*(b.near(held) for _, b in tries)))
        most = np.zeros(len(block), np.int64)
        np.maximum.at(most, q, n)
        for k, m in zip(block, np.bincount(q, minlength=len(block)).tolist()):
            total[k] = m
        top = n == most[q]
        for x, *edit in zip(*(v[top].tolist() for v in (q, n, kind, i, head))):
            better(block[x], edit[0], edited(held[x], *edit[1:]))
    for k, w in enumerate(words):
        if len(w) > BLOCK_CHARS:
            for trie, _ in tries:
                for n, x in neighbours(trie, w):
                    total[k] += 1
                    better(k, n, x)
    return total, count, form


# --- Spark --------------------------------------------------------------------


def shards(words: DataFrame, rules: SpellingRules) -> DataFrame:
    """shard, size, trie (pickled) over the sorted vocabulary (word, n)."""

    def cut(batches):
        import pickle
        import uuid

        held, counts, size = [], [], 0

        def out():
            trie = build(held, counts)
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([trie.size()], pa.int64()), pa.array([pickle.dumps(trie, 5)], pa.binary())], names=["shard", "size", "trie"])

        for batch in batches:
            for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = w.encode("latin-1")
                cost = len(w) + 34  # a word brings two nodes at most
                if held and size + cost > rules.shard_bytes:
                    yield out()
                    held, counts, size = [], [], 0
                held.append(w)
                counts.append(n)
                size += cost
        if held:
            yield out()

    return words.select("word", "n").repartitionByRange("word").sortWithinPartitions("word").mapInArrow(cut, "shard string, size long, trie binary")


def near_words(words: DataFrame, rules: SpellingRules = SpellingRules()) -> DataFrame:
    """word, n, n_near, best (count, form) of each word of a settled vocabulary; best is null without a neighbour."""
    spark = words.sparkSession
    tries = settle(shards(words, rules), "tries")
    rounds, room = [], 0
    for r in tries.select("shard", "size").orderBy("shard").toLocalIterator():
        if not rounds or room + r["size"] > rules.round_bytes:
            rounds.append([])
            room = 0
        rounds[-1].append(r["shard"])
        room += r["size"]
    parts = []
    for names in rounds:
        held = spark.sparkContext.broadcast([bytes(r["trie"]) for r in tries.filter(F.col("shard").isin(names)).select("trie").collect()])
        parts.append(settle(words.select("word", "n").mapInArrow(_intersect(held), "word string, n long, n_near long, best struct<n: long, form: string>"), "near"))
        held.destroy()
    discard(tries)
    if not parts:
        return words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("struct<n: long, form: string>").alias("best"))
    if len(parts) == 1:
        return parts[0]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    first = F.struct((-F.col("best.n")).alias("n"), F.col("best.form").alias("form"))
    out = out.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min(F.when(F.col("best").isNotNull(), first)).alias("b"))
    return out.select("word", "n", "n_near", F.when(F.col("b").isNotNull(), F.struct((-F.col("b.n")).alias("n"), F.col("b.form").alias("form"))).alias("best"))


def _intersect(held):
    def run(batches):
        import pickle

        tries = [pickle.loads(x) for x in held.value]
        tries = [(t, Blocks(t)) for t in tries]
        for batch in batches:
            total, count, form = best_near(tries, [w.encode("latin-1") for w in batch.column(0).to_pylist()])
            form = [None if x is None else x.decode("latin-1") for x in form]
            struct = pa.StructArray.from_arrays([pa.array(count, pa.int64()), pa.array(form, pa.string())], ["n", "form"], mask=pa.array([c is None for c in count]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(total, pa.int64()), struct], names=["word", "n", "n_near", "best"])

    return run


def spelling_groups(docs: DataFrame, rules: SpellingRules = SpellingRules()) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of the corpus."""
    words = settle(vocabulary(docs, rules), "words")
    near = near_words(words, rules)
    has = F.col("best.n") >= rules.times * F.col("n")
    formed = settle(near.select("word", F.when(has, F.col("best.form")).alias("form"), "n", "n_near", F.when(has, F.col("best.n")).alias("form_n")), "forms")
    links = formed.filter("form is not null").select("word", F.col("form").alias("root"))
    most = formed.agg(F.max("n")).first()[0] or 1
    # after k jumps a pointer spans 2**k forms, of which a chain has at most log2(most)
    for _ in range(most.bit_length().bit_length()):
        on = links.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        jumped = settle(links.join(on, "root", "left").select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("moved")), "roots")
        moved = not jumped.filter("moved").isEmpty()
        links = jumped.select("word", "root")
        if not moved:
            break
    out = formed.join(links, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
