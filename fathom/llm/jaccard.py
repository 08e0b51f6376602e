"""N-gram Jaccard self-join by size-aware heavy-light signatures.

A document's set is its distinct word shingles as 64-bit hashes; equal sets
form one class, and links are sought between classes. Sets are taken in one
global order of shingles: those of cells that all documents fill most last, the
rest by hash. If J(A, B) >= t and |A| <= |B|, the sets share ceil(t*|B|) shingles,
so they meet among their first few in that order.

* Light sets, of at most ``boundary`` shingles, enumerate the subsets of
  ``SUBSET`` shingles of that prefix; two light sets that match share one.
* Heavy sets post each shingle of the prefix into inverted lists, which are
  scanned; light sets large enough to match a heavy one post there too.
* The boundary is the largest size whose subsets cost no more than its lists,
  by the lengths that the lists of a prefix have over all rows.

Within a long list only neighbours in size order and the list's head are
compared at first; after components are known, what remains between different
components is compared too, a long list in pairs of blocks. So no link between
components is lost, and a group of thousands of copies costs links in
proportion to its size. Parity sketches screen candidate pairs, and those that
they can't rule out are verified on the whole shingle sets. Sets and fine
sketches lie in sorted, memory-mapped files: texts are never shuffled, and what
lies between components is judged where its list is read, so that only
links are sent on.

Defined cases: a null or empty text, or one without words, has the empty set
and links with nothing; with fewer words than a shingle the whole sequence is
the one shingle; rows that share a doc_id are nodes of their own by their
sets; a null doc_id never is a component's smallest unless alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .classfiles import class_files, file_of, found_in
from .components import components
from .eliasfano import load, save
from .shared import apart, discard, local_path, ranges_for, remove, settle, shared_folder, together, write_file
from .textkit import U64, Words, chunks, mix64, ngram_hashes, release, text_buffer, tidy

SUBSET = 2
#: Lists up to this long compare all their pairs at once.
SHORT_LIST = 6
#: Pairs that one verification task's group holds.
PAIR_BLOCK = 4096
#: Candidate pairs that a task holds before it sends them.
HELD_PAIRS = 500_000
#: Members of an inverted list in a row, and in a block when what lies between components is compared.
LIST_ROW, LIST_BLOCK = 1 << 16, 1 << 10
#: What the scan of a list's entry costs, next to posting one.
SCAN_COST = 0.05
#: Bytes of shingle sets in a file.
SET_FILE = 16 << 20
#: Cells of a fine sketch for each shingle.
FINE = 8
#: Cells by hash in which a task counts all its documents' shingles, and the cells of a row of counts.
CELLS, CELL_ROW = 1 << 21, 1 << 15


@dataclass(frozen=True)
class JaccardRules:
    words: int = 5
    percent: int = 75
    #: A shingle is frequent that about so many of each so many documents hold.
    per_docs: int = 4000
    frequent: int = 4


def shingle_sets(data: np.ndarray, offs: np.ndarray, i: int, j: int, words: int) -> list[np.ndarray]:
    """The ascending distinct shingle hashes of documents [i, j)."""
    w = Words(data, offs, i, j, lower=True)
    h = w.hashes()
    g, ok = ngram_hashes(h, words, w.first)
    out = []
    for d in range(w.n_docs):
        a, n = int(w.first[d]), int(w.count[d])
        if n >= words:
            out.append(np.unique(g[a : a + n - words + 1]))
        elif n:
            out.append(ngram_hashes(h[a : a + n], n, np.array([0, n]))[0] + U64(n))
        else:
            out.append(np.zeros(0, U64))
    return out


def class_of(s: np.ndarray) -> int:
    """A set's fingerprint as a signed 64-bit class; order-free and independent of its size's hash."""
    with np.errstate(over="ignore"):
        x = mix64(s ^ U64(0xA0761D6478BD642F)).sum(dtype=U64) + U64(len(s)) * U64(0xE7037ED1A0B428DB)
    return int(mix64(np.array([x]))[0].view(np.int64))


def need(n: int, percent: int) -> int:
    """The least overlap of a set of n shingles with one as large or larger."""
    return -(-n * percent // 100)


def sketch(hashes: np.ndarray, size: int) -> bytes:
    """Parities of hashes over a power of two of cells, at least size.

    Shared items cancel, so cells that differ between two sketches are no more
    than the items that do. The longer of two folds to the shorter.
    """
    bits = 64
    while bits < size:
        bits *= 2
    cells = np.bincount((mix64(hashes ^ U64(0x8BB84B93962EACC9)) & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(cells.astype(np.uint8), bitorder="little").tobytes()


def folded(x: np.ndarray, words: int) -> np.ndarray:
    return np.bitwise_xor.reduce(x.reshape(-1, words), axis=0) if len(x) > words else x


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound on the number of items in one alone."""
    x, y = (np.frombuffer(v, "<u8") for v in sorted((a, b), key=len))
    return int(np.bitwise_count(x ^ folded(y, len(x))).sum())


def set_bound(percent: int):
    """Whether sets of two sizes with at least so many differences can be similar."""
    return lambda n_a, n_b, diff: (100 - percent) * (n_a + n_b) >= (100 + percent) * diff


def classes(docs: DataFrame, rules: JaccardRules) -> DataFrame:
    """(doc_id, tie, n, class, sketch, part, counts) per row of docs; tie is the text's hash; class and sketch are null for the empty set.

    Rows with a part hold none of these but counts: those of a range of cells by a task's shingles, all of them.
    """

    @tidy
    def run(batches):
        counts = np.zeros(CELLS, np.int64)
        for batch in batches:
            data, offs = text_buffer(batch.column(1))
            n, c, k = [], [], []
            for i, j in chunks(offs):
                sets = shingle_sets(data, offs, i, j, rules.words)
                held = np.concatenate(sets) if sets else np.zeros(0, U64)
                np.add.at(counts, cell_of(held), 1)
                for s in sets:
                    n.append(len(s))
                    c.append(class_of(s) if len(s) else None)
                    k.append(sketch(s, len(s)) if len(s) else None)
            none = pa.nulls(len(n))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(c, pa.int64()), pa.array(k, pa.binary()), none.cast(pa.int32()), none.cast(pa.binary())], names=names)
        for at in np.flatnonzero(counts.reshape(-1, CELL_ROW).any(axis=1)).tolist():
            row = counts[at * CELL_ROW : (at + 1) * CELL_ROW].astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())), pa.array([at], pa.int32()), pa.array([row], pa.binary())], names=names)

    names = ["doc_id", "tie", "n", "class", "sketch", "part", "counts"]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie")).mapInArrow(run, "doc_id long, tie long, n long, class long, sketch binary, part int, counts binary")


def cell_of(s: np.ndarray) -> np.ndarray:
    return (mix64(s ^ U64(0x3C6EF372FE94F82B)) & U64(CELLS - 1)).astype(np.int64)


def screened(pairs: DataFrame, sketches: DataFrame, bound) -> DataFrame:
    """The pairs that their sketches don't rule out; sketches: (class, n, sketch). No similar pair is lost."""
    of = lambda x: sketches.select(F.col("class").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))

    @tidy
    def run(batches):
        for batch in batches:
            n_a, n_b, s_a, s_b = (batch.column(k).to_pylist() for k in range(2, 6))
            keep = [bool(bound(x, y, least_difference(u, v))) for x, y, u, v in zip(n_a, n_b, s_a, s_b)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(run, "a long, b long")


def frequent_cells(counted: DataFrame, rows: int, rules: JaccardRules) -> tuple[np.ndarray, float]:
    """(bits of the cells of frequent shingles; length over all rows of the list that a rare shingle meets), by the counts of all documents' shingles.

    A cell's shingles are frequent or rare together, so any set's order is the
    same everywhere. Cells come in pairs that a hash bit tells apart: two rare
    shingles add to their difference or take from it, so its square is, on
    average, the sum of the squares of the list lengths.
    """

    def total(table: pa.Table) -> pa.Table:
        held = sum(np.frombuffer(x, "<u4").astype(np.int64) for x in table.column("counts").to_pylist())
        return pa.table({"part": table.column("part").slice(0, 1), "counts": pa.array([held.tobytes()], pa.binary())})

    counts = np.zeros(CELLS, np.int64)
    for r in counted.select("part", "counts").groupBy("part").applyInArrow(total, "part int, counts binary").toLocalIterator():  # CELLS numbers in all
        counts[r["part"] * CELL_ROW : (r["part"] + 1) * CELL_ROW] = np.frombuffer(r["counts"], np.int64)
    hot = counts >= counts.sum() / CELLS + rules.frequent * max(1.0, rows / rules.per_docs)
    pairs, rare = counts.reshape(-1, 2), ~hot.reshape(-1, 2).any(axis=1)
    held = int(pairs[rare].sum())
    squares = float(((pairs[rare, 0] - pairs[rare, 1]).astype(float) ** 2).sum())
    return np.packbits(hot, bitorder="little"), max(1.0, squares / held if held else 1.0)


def cost_boundary(percent: int, list_length: float) -> int:
    """The largest size at which enumerating subsets costs no more than posting to lists and scanning them.

    A prefix of p shingles has p * (p - 1) / 2 subsets; without subsets it is
    one shorter and costs as many postings, each with a scan of its list.
    """
    most = int(2 * (1 + SCAN_COST * list_length)) - SUBSET  # of n - need(n), which is n * (100 - percent) // 100
    return -(-(most + 1) * 100 // (100 - percent)) - 1


def _ordered_prefix(s: np.ndarray, hot: np.ndarray, size: int) -> np.ndarray:
    """The first shingles in the global order: rare ones by hash, then frequent ones by hash."""
    size = min(size, len(s))
    if not len(hot):
        return s[:size]
    cell = cell_of(s)
    is_hot = (hot[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
    rare = s[~is_hot]
    return rare[:size] if len(rare) >= size else np.concatenate([rare, s[is_hot][: size - len(rare)]])


def signatures(s: np.ndarray, hot: np.ndarray, boundary: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, whether each also serves the smaller set of a pair) of one set."""
    n = len(s)
    o = need(n, percent)
    sig, small = [], []
    if n > boundary or 100 * n >= percent * (boundary + 1):
        prefix = _ordered_prefix(s, hot, n - o + 1)
        sig.append(mix64(prefix))  # prefixes hold the smallest hashes: mixed, they spread over the shards
        # with the other set at least as large the overlap is higher, and the smaller set's prefix shorter
        least = -(-2 * percent * n // (100 + percent))
        small.append(np.arange(len(prefix)) < n - least + 1)
    if n <= boundary:
        if o < SUBSET:  # a match may share less than a subset: single shingles too
            sig.append(mix64(s ^ U64(0x1111)))
            small.append(np.ones(n, bool))
        if n >= SUBSET:
            prefix = np.sort(_ordered_prefix(s, hot, n - o + SUBSET))
            a, b = np.triu_indices(len(prefix), 1)
            with np.errstate(over="ignore"):
                sig.append(mix64(prefix[a] * U64(3) + mix64(prefix[b])))
            small.append(np.ones(len(a), bool))
    return (np.concatenate(sig), np.concatenate(small)) if sig else (np.zeros(0, U64), np.zeros(0, bool))


ENTRY = np.dtype([("sig", "<u4"), ("n", "<u4"), ("class", "<i8"), ("small", "u1")])


def entry_rows(sig: np.ndarray, n, cls, small) -> np.ndarray:
    e = np.empty(len(sig), ENTRY)
    e["sig"], e["n"], e["class"], e["small"] = (sig & U64(0xFFFFFFFF)), n, cls, small
    return e


def packed_entries(sig: np.ndarray, e: np.ndarray, shards: int) -> pa.RecordBatch:
    """Entries dealt to shards by their signature's high half, a blob for each."""
    shard = ((sig >> U64(32)) * U64(shards)) >> U64(32)
    order = np.argsort(shard, kind="stable")
    cut = np.searchsorted(shard[order], np.arange(shards + 1, dtype=U64))
    e = e[order]
    own = np.flatnonzero(np.diff(cut))
    # fields apart: like bytes stand together for the shuffle's compression
    blobs = [b"".join(np.ascontiguousarray(e[name][cut[k] : cut[k + 1]]).tobytes() for name in ENTRY.names) for k in own]
    return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(blobs, pa.binary())], names=["shard", "blob"])


def entries(docs: DataFrame, hot: np.ndarray, boundary: int, shards: int, rules: JaccardRules) -> DataFrame:
    """(shard, blob): signature entries packed by shard, so that the shuffle moves bytes rather than rows."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)  # a bit a cell

    @tidy
    def run(batches):
        for batch in batches:
            data, offs = text_buffer(batch.column(0))
            for i, j in chunks(offs, 8 << 20):
                parts = []
                for a, b in chunks(offs[i : j + 1]):
                    for s in shingle_sets(data, offs, i + a, i + b, rules.words):
                        if len(s):
                            sig, small = signatures(s, shared.value, boundary, rules.percent)
                            parts.append((sig, entry_rows(sig, len(s), class_of(s), small)))
                if parts:
                    yield packed_entries(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), shards)

    return docs.select("text").mapInArrow(run, "shard int, blob binary")


def _unpack(blobs: list[bytes]) -> np.ndarray:
    sizes = [len(b) // ENTRY.itemsize for b in blobs]
    out = np.empty(sum(sizes), ENTRY)
    at = 0
    for b, n in zip(blobs, sizes):
        k = 0
        for name in ENTRY.names:
            kind = ENTRY[name]
            out[name][at : at + n] = np.frombuffer(b, kind, n, k)
            k += n * kind.itemsize
        at += n
    return out


LISTS = "list long, base long, over int, classes array<long>, sizes array<long>, small array<boolean>"


def candidate_lists(packed: DataFrame, percent: int) -> DataFrame:
    """Inverted lists with two classes or more: (list, base, over, classes, sizes, small), equal lists once a shard.

    Classes ascend by size, then by class. A long list is cut into rows of
    LIST_ROW from place ``base``, whose first ``over`` members are the list's
    head and the last one before.
    """

    def run(table: pa.Table) -> pa.Table:
        e = _unpack(table.column("blob").to_pylist())
        del table
        e = e[np.lexsort((1 - e["small"], e["class"], e["n"], e["sig"]))]
        new = np.ones(len(e), bool)
        new[1:] = (e["sig"][1:] != e["sig"][:-1]) | (e["class"][1:] != e["class"][:-1])
        e = e[new]
        start = np.flatnonzero(np.concatenate([[True], e["sig"][1:] != e["sig"][:-1]])) if len(e) else np.zeros(0, int)
        size = np.diff(np.append(start, len(e)))
        start, size = start[size > 1], size[size > 1]
        with np.errstate(over="ignore"):
            code = mix64(e["class"].astype(U64) * U64(2) + e["small"].astype(U64))
            total = np.concatenate([[0], np.cumsum(code)]).astype(U64)
            key = mix64(total[start + size] - total[start] + size.astype(U64))
        _, first = np.unique(key, return_index=True)
        start, size, key = start[first], size[first], key[first]
        # rows: of a list's places [base, base + LIST_ROW)
        rows = -(-size // LIST_ROW)
        own = np.repeat(np.arange(len(size)), rows)
        base = (np.arange(len(own)) - np.repeat(np.cumsum(rows) - rows, rows)) * LIST_ROW
        over = np.where(base > 0, 2, 0)
        length = np.minimum(size[own] - base, LIST_ROW) + over
        cut = np.concatenate([[0], np.cumsum(length)])
        place = np.arange(cut[-1]) + np.repeat(start[own] + base - over - cut[:-1], length)
        place[cut[:-1][over > 0]] = start[own][over > 0]
        lists = [pa.LargeListArray.from_arrays(pa.array(cut, pa.int64()), pa.array(e[name][place].astype(t))).cast(pa.list_(k)) for name, t, k in (("class", np.int64, pa.int64()), ("n", np.int64, pa.int64()), ("small", bool, pa.bool_()))]
        release()
        return pa.Table.from_arrays([pa.array(key.view(np.int64)[own]), pa.array(base.astype(np.int64)), pa.array(over.astype(np.int32)), *lists], names=[c.split()[0] for c in LISTS.split(", ")])

    return packed.groupBy("shard").applyInArrow(run, LISTS).dropDuplicates(["list", "base"])


def pairs_batch(found: list[np.ndarray]) -> pa.RecordBatch:
    p = np.concatenate(found, axis=1)
    order = np.lexsort((p[1], p[0]))
    p = p[:, order]
    new = np.ones(p.shape[1], bool)
    new[1:] = (p[0, 1:] != p[0, :-1]) | (p[1, 1:] != p[1, :-1])
    return pa.RecordBatch.from_arrays([pa.array(p[0][new]), pa.array(p[1][new])], names=["a", "b"])


def list_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Distinct candidate pairs (a, b), a before b by size and class: all pairs of short lists, else neighbours and pairs with the head."""

    @tidy
    def run(batches):
        for batch in batches:
            found, held = [], 0
            for base, c, n, s in zip(*(batch.column(k).to_pylist() for k in range(4))):
                c, n, s = np.array(c, np.int64), np.array(n, np.int64), np.array(s, bool)
                m = len(c)
                if not base and m <= SHORT_LIST:
                    a, b = np.triu_indices(m, 1)
                else:
                    a = np.concatenate([np.arange(m - 1), np.zeros(m - 2, int)])
                    b = np.concatenate([np.arange(1, m), np.arange(2, m)])
                ok = (100 * n[a] >= percent * n[b]) & s[a]
                found.append(np.stack([c[a[ok]], c[b[ok]]]))
                held += int(ok.sum())
                if held >= HELD_PAIRS:
                    yield pairs_batch(found)
                    found, held = [], 0
            if found:
                yield pairs_batch(found)

    return lists.select("base", "classes", "sizes", "small").mapInArrow(run, "a long, b long").distinct()


def _nearest(found: list[np.ndarray], few: int) -> list[np.ndarray]:
    """The few pairs of least difference between each two components; rows: components, difference, a, b."""
    p = np.concatenate(found, axis=1)
    p = p[:, np.lexsort((p[2], p[1], p[0]))]
    new = np.ones(p.shape[1], bool)
    new[1:] = (p[0, 1:] != p[0, :-1]) | (p[1, 1:] != p[1, :-1])
    at = np.arange(p.shape[1])
    return [p[:, at - np.maximum.accumulate(np.where(new, at, 0)) < few]]


def block_pairs(members: DataFrame) -> DataFrame:
    """Pairs of blocks of lists that hold different components, as rows (cut, e): e's first cut members are one block, the rest the other.

    members: list, k, class, n, small, comp and others. Blocks go by component,
    so that those of one large component don't meet each other. A block that
    meets itself has no rest.
    """
    place = F.row_number().over(Window.partitionBy("list").orderBy("comp", "k")) - 1
    dealt = members.withColumn("block", F.floor(place / LIST_BLOCK).cast("long"))
    ends = dealt.groupBy("list", "block").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    # a list has a block for each LIST_BLOCK members: they meet in its row, and those of one component don't
    ends = ends.groupBy("list").agg(F.collect_list(F.struct("block", "lo", "hi")).alias("ends"))
    met = ends.select("list", "ends", F.explode("ends").alias("i")).select("list", "i", F.explode(F.filter("ends", lambda j: (F.col("i.block") <= j["block"]) & (F.col("i.lo") < j["hi"]))).alias("j"))
    met = met.select("list", F.col("i.block").alias("i"), F.col("j.block").alias("j"), F.explode(F.array_distinct(F.array("i.block", "j.block"))).alias("block"))
    # few bytes ask for many comparisons: rows are dealt to a fixed number of tasks, which adaptive execution doesn't fold
    # by size (members may be a join, whose size Spark takes for the product of its tables')
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = dealt.join(met, ["list", "block"]).repartition(parts, "list", "i", "j")
    fields = F.struct((F.col("block") != F.col("i")).alias("second"), "k", *[c for c in members.columns if c not in ("list", "k")])
    return one.groupBy("list", "i", "j").agg(F.array_sort(F.collect_list(fields)).alias("e"))


def pairs_between(members: DataFrame, percent: int, bound, few: int | None) -> DataFrame:
    """Pairs of lists' members in different components that their sketches don't rule out.

    members: as for block_pairs, and sketch. With few, only so many between each two
    components of a pair of blocks, those with the nearest sketches.
    """
    names = ("second", "k", "class", "n", "small", "comp", "sketch")
    rows = block_pairs(members).select(*[F.col(f"e.{name}").alias(name) for name in names])

    @tidy
    def run(batches):
        for batch in batches:
            for second, k, c, n, s, g, sk in zip(*(batch.column(x).to_pylist() for x in range(7))):
                k, c, n, s, g = np.array(k, np.int64), np.array(c, np.int64), np.array(n, np.int64), np.array(s, bool), np.array(g, np.int64)
                cut = len(second) - sum(second)
                words = min(map(len, sk)) // 8
                x = np.stack([folded(np.frombuffer(v, "<u8"), words) for v in sk])
                found, held = [], 0
                for a in range(cut):
                    # the other block, or what follows in the same one
                    b = np.arange(cut if cut < len(k) else a + 1, len(k))
                    before = k[b] > k[a]  # a comes first by size
                    ok = (g[b] != g[a]) & np.where(before, s[a], s[b]) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
                    b, before = b[ok], before[ok]
                    if not len(b):
                        continue
                    diff = np.bitwise_count(x[b] ^ x[a]).sum(axis=1).astype(np.int64)
                    ok = bound(n[a], n[b], diff)
                    b, before, diff = b[ok], before[ok], diff[ok]
                    if not len(b):
                        continue
                    one, two = np.minimum(g[a], g[b]), np.maximum(g[a], g[b])
                    found.append(np.stack([one, two, diff, np.where(before, c[a], c[b]), np.where(before, c[b], c[a])]))
                    held += len(b)
                    if held >= HELD_PAIRS:
                        if few is not None:
                            found = _nearest(found, few)
                            held = found[0].shape[1]
                        if held >= HELD_PAIRS // 2:
                            yield pairs_batch([p[3:] for p in found])
                            found, held = [], 0
                if found:
                    yield pairs_batch([p[3:] for p in (_nearest(found, few) if few is not None else found)])

    return rows.mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, texts: DataFrame, matches) -> DataFrame:
    """The pairs that match; texts: (class, text), one row a class; matches(texts by class as a table, a, b) -> booleans.

    Pairs go to blocks of PAIR_BLOCK in order, and each block gets every text it
    needs once. The order keeps pairs together that share the smallest class
    two steps away, so a group's texts go to few blocks.
    """
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    far = both.join(near.select(F.col("a").alias("b"), "m"), "b").groupBy("a").agg(F.min("m").alias("near"))
    pairs = pairs.join(far, "a")

    @tidy
    def block(batches):
        from pyspark import TaskContext

        k, n = TaskContext.get().partitionId() << 36, 0
        for batch in batches:
            own = k + (n + np.arange(batch.num_rows)) // PAIR_BLOCK
            n += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(own), batch.column(0), batch.column(1)], names=["block", "a", "b"])

    dealt = settle(pairs.repartitionByRange("near", "a", "b").sortWithinPartitions("near", "a", "b").select("a", "b").mapInArrow(block, "block long, a long, b long"), "pairs")
    ends = dealt.select(F.col("block").alias("to"), F.explode(F.array("a", "b")).alias("class")).distinct()
    sent = ends.join(texts, "class").select("to", "class", "text")

    def check(p: pa.Table, t: pa.Table) -> pa.Table:
        return p.select(["a", "b"]).filter(pa.array(matches(t, p.column("a").to_pylist(), p.column("b").to_pylist()), pa.bool_()))

    return dealt.groupBy("block").cogroup(sent.groupBy("to")).applyInArrow(check, "a long, b long")


def set_files(docs: DataFrame, sized: DataFrame, members: DataFrame, rules: JaccardRules) -> tuple[dict[int, str], int, str]:
    """Sorted, memory-mapped files of the members' shingle sets: a path for each range of classes, the ranges' number, the folder.

    One row of each class is looked for by its text's hash, so the sets of no other text are built.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark)
    root = local_path(folder)
    chosen = settle(sized.join(members, "class", "left_semi").groupBy("class").agg(F.min("tie").alias("tie"), F.first("n").alias("n")), "chosen")
    rows, total = chosen.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    files = max(1, ranges_for(docs), int(8 * total) // SET_FILE)
    ties = class_files(chosen.select(F.col("tie").alias("class"), F.col("class").alias("set")), folder, "ties", files)
    discard(chosen)

    @tidy
    def build(batches):
        for batch in batches:
            tie = batch.column(0).to_numpy()
            hits = [own for own, _, _ in found_in(ties, tie.view(U64), files)]
            own = np.sort(np.concatenate(hits)) if hits else np.zeros(0, np.int64)
            _, once = np.unique(tie[own], return_index=True)
            data, offs = text_buffer(batch.column(1).take(pa.array(np.sort(own[once]))))
            out: dict[int, bytes] = {}
            for i, j in chunks(offs):
                for s in shingle_sets(data, offs, i, j, rules.words):
                    if len(s):
                        out[class_of(s)] = s.tobytes()
            c = np.array(list(out), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(file_of(c.view(U64), files).astype(np.int32)), pa.array(c), pa.array(list(out.values()), pa.binary())], names=["file", "class", "items"])

    def write(table: pa.Table) -> pa.Table:
        key = table.column("file")[0].as_py()
        c, first = np.unique(table.column("class").to_numpy(), return_index=True)
        items = table.column("items").take(pa.array(first)).to_pylist()
        path = f"{root}/sets-{key:07d}.fef"
        fine = [sketch(np.frombuffer(x, U64), FINE * (len(x) // 8)) for x in items]
        at, fine_at = (np.concatenate([[0], np.cumsum([len(x) // 8 for x in xs])]).astype(np.int64) for xs in (items, fine))
        write_file(path, save({"class": c, "begin": at, "items": np.frombuffer(b"".join(items), U64), "fine_begin": fine_at, "fine": np.frombuffer(b"".join(fine), U64)}))
        release()
        return pa.table({"file": pa.array([key], pa.int32()), "path": [path]})

    built = docs.select(F.xxhash64("text").alias("tie"), "text").filter("text is not null").mapInArrow(build, "file int, class long, items binary")
    paths = {r["file"]: r["path"] for r in built.groupBy("file").applyInArrow(write, "file int, path string").collect()}  # a row per file
    return paths, files, folder


class SetFiles:
    """A task's view of set files."""

    def __init__(self, paths: dict[int, str], files: int):
        self.paths, self.files, self.held = paths, files, {}

    def of(self, c: np.ndarray) -> list[tuple[dict, int]]:
        """The file and the place in it of each class."""
        out: list = [None] * len(c)
        at = file_of(c.view(U64), self.files)
        for k in np.unique(at).tolist():
            if k not in self.held:
                self.held[k] = load(self.paths[k])
            f = self.held[k]
            own = np.flatnonzero(at == k)
            for x, e in zip(own.tolist(), np.searchsorted(f["class"], c[own]).tolist()):
                out[x] = (f, e)
        return out

    @staticmethod
    def items(at: tuple[dict, int]) -> np.ndarray:
        f, e = at
        return f["items"][f["begin"][e] : f["begin"][e + 1]]

    @staticmethod
    def fine(at: tuple[dict, int]) -> np.ndarray:
        f, e = at
        return f["fine"][f["fine_begin"][e] : f["fine_begin"][e + 1]]


def similar(u: np.ndarray, v: np.ndarray, percent: int) -> bool:
    """Whether two ascending sets are."""
    at = np.searchsorted(v, u)
    at[at == len(v)] = 0
    both = int((v[at] == u).sum())
    return 100 * both >= percent * (len(u) + len(v) - both)


def similar_sets(pairs: DataFrame, paths: dict[int, str], files: int, rules: JaccardRules) -> DataFrame:
    """The pairs of classes whose sets, in files, are similar."""
    parts = ranges_for(pairs)

    @tidy
    def run(batches):
        held = SetFiles(paths, files)
        for batch in batches:
            a, b = (held.of(batch.column(k).to_numpy()) for k in range(2))
            yield batch.filter(pa.array([similar(held.items(x), held.items(y), rules.percent) for x, y in zip(a, b)], pa.bool_()))

    return pairs.repartitionByRange(parts, "a", "b").sortWithinPartitions("a", "b").select("a", "b").mapInArrow(run, "a long, b long")


class FineSketches:
    """Fine sketches of a row's members, by their length in words."""

    def __init__(self, sketches: list[np.ndarray]):
        self.words = np.array([len(x) for x in sketches])
        self.row = np.zeros(len(sketches), np.int64)
        self.by: dict[int, np.ndarray] = {}
        for w in np.unique(self.words).tolist():
            own = np.flatnonzero(self.words == w)
            self.row[own] = np.arange(len(own))
            self.by[w] = np.stack([sketches[k] for k in own])

    def differences(self, a: int, b: np.ndarray) -> np.ndarray:
        """Lower bounds on the items that a and each of b don't share."""
        out = np.zeros(len(b), np.int64)
        mine = self.by[int(self.words[a])][self.row[a]]
        for w in np.unique(self.words[b]).tolist():
            own = np.flatnonzero(self.words[b] == w)
            least = min(w, len(mine))
            theirs = self.by[w][self.row[b[own]]]
            theirs = np.bitwise_xor.reduce(theirs.reshape(len(own), -1, least), axis=1)
            out[own] = np.bitwise_count(theirs ^ folded(mine, least)).sum(axis=1)
        return out


def links_between(members: DataFrame, paths: dict[int, str], files: int, rules: JaccardRules) -> DataFrame:
    """Links that join all components of lists that any link joins; members as for block_pairs.

    Pairs within a component, known or found here, need no judgement.
    """
    names = ("second", "k", "class", "n", "small", "comp")
    rows = block_pairs(members).select(*[F.col(f"e.{name}").alias(name) for name in names])
    bound, percent = set_bound(rules.percent), rules.percent

    @tidy
    def run(batches):
        held = SetFiles(paths, files)
        for batch in batches:
            found = []
            for second, *cols in zip(*(batch.column(x).to_pylist() for x in range(6))):
                k, c, n, s, g = (np.array(x, t) for x, t in zip(cols, (np.int64, np.int64, np.int64, bool, np.int64)))
                cut = len(second) - sum(second)
                at = held.of(c)
                fine = FineSketches([held.fine(x) for x in at])
                for a in range(cut):
                    # the other block, or what follows in the same one
                    b = np.arange(cut if cut < len(k) else a + 1, len(k))
                    ok = (g[b] != g[a]) & np.where(k[b] > k[a], s[a], s[b]) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
                    b = b[ok]
                    if not len(b):
                        continue
                    diff = fine.differences(a, b)
                    ok = bound(n[a], n[b], diff)
                    mine = held.items(at[a])
                    for x in b[ok][np.argsort(diff[ok], kind="stable")].tolist():
                        if g[x] != g[a] and similar(mine, held.items(at[x]), percent):
                            found.append((c[a], c[x]))
                            g[g == g[x]] = g[a]
            links = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def _short(lists: DataFrame):
    return (F.col("base") == 0) & (F.size("classes") <= SHORT_LIST)


def candidates(lists: DataFrame, percent: int, sketches: DataFrame, bound) -> DataFrame:
    """The first candidate pairs: neighbours in lists and pairs with heads that the sketches (class, n, sketch) don't rule out."""
    return settle(screened(list_pairs(lists, percent), sketches, bound), "candidates")


def classes_linked(lists: DataFrame, tested: DataFrame, judge, between: list) -> DataFrame:
    """(node, component) of the classes in candidate lists, by pairs that match; classes without a match are left out.

    tested: the first candidates, of which judge gives those that match. Then
    each of between gives links between the components that longer lists still
    hold, from their members (list, k, class, n, small, comp); the last one
    leaves none out.
    """
    links = settle(judge(tested), "links")
    found = settle(components(links), "components")
    discard(links)
    fields = F.posexplode(F.arrays_zip("classes", "sizes", "small")).alias("k", "e")
    flat = lists.filter(~_short(lists)).select("list", "base", "over", fields).filter("k >= over")
    flat = settle(flat.select("list", (F.col("base") + F.col("k") - F.col("over")).alias("k"), F.col("e.classes").alias("class"), F.col("e.sizes").alias("n"), F.col("e.small").alias("small")), "flat")
    for step in between:
        named = flat.join(found.withColumnRenamed("node", "class"), "class", "left").withColumn("comp", F.coalesce("component", "class")).drop("component")
        mixed = named.groupBy("list").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("list")
        # written once: a list's members are read for their blocks, the blocks' ends and their sketches
        mixed = settle(named.join(mixed, "list", "left_semi").select("list", "k", "class", "n", "small", "comp"), "mixed")
        links = settle(step(mixed), "links")
        discard(mixed)
        if not links.isEmpty():
            found = _merged(found, links)
        discard(links)
    discard(flat)
    return found


def _merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """found with more links: components that they join become one."""
    of = lambda x: found.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
    ends = links.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
    ends = settle(ends.select("a", "b", F.coalesce("c_a", "a").alias("x"), F.coalesce("c_b", "b").alias("y")), "ends")
    joined = settle(components(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))), "joined")
    new = ends.select(F.col("a").alias("node"), F.col("x").alias("component")).union(ends.select("b", "y")).distinct()
    every = found.select("node", "component").union(new).distinct()
    named = every.join(joined.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left")
    out = settle(named.select("node", F.coalesce("top", "component").alias("component")), "components")
    discard(ends, joined, found)
    return out


def jaccard_components(docs: DataFrame, rules: JaccardRules = JaccardRules()) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id (smallest doc_id reachable)."""
    return _labelled(docs, rules).select("doc_id", "n_shingles", "component_id")


def _labelled(docs: DataFrame, rules: JaccardRules) -> DataFrame:
    """jaccard_components with each row's tie and its component's number, null for the empty set."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = settle(classes(docs, rules), "classes")
    sized = made.filter("part is null").drop("part", "counts")
    least = sized.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"))
    hot, length = frequent_cells(made.filter("part is not null"), sized.count(), rules)
    boundary = cost_boundary(rules.percent, length)
    lists = settle(candidate_lists(entries(docs, hot, boundary, ranges_for(docs), rules), rules.percent), "lists")
    sketches = settle(sized.filter("class is not null").groupBy("class").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")), "sketches")
    tested = candidates(lists, rules.percent, sketches, set_bound(rules.percent))
    # whatever may be judged: the first candidates, and the members of longer lists
    member = tested.select(F.explode(F.array("a", "b")).alias("class")).union(lists.filter(~_short(lists)).select(F.explode("classes").alias("class"))).distinct()
    paths, files, folder = set_files(docs, sized, member, rules)
    found = classes_linked(lists, tested, lambda pairs: similar_sets(pairs, paths, files, rules), [lambda members: links_between(members, paths, files, rules)])
    discard(lists, sketches, tested)
    remove(docs.sparkSession, folder)
    named = found.join(least.withColumnRenamed("class", "node"), "node")
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    label = named.join(smallest, "component").select(F.col("node").alias("class"), "component", "component_id")
    label = least.join(label, "class", "left").select("class", F.coalesce("component", "class").alias("component"), F.coalesce("component_id", "least").alias("component_id"))
    out = sized.join(label, "class", "left")
    return out.select("doc_id", "tie", "component", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each_group(docs: DataFrame, rules: JaccardRules = JaccardRules()) -> DataFrame:
    """docs with one row of each group: that of the smallest doc_id, then text hash, null ids last; texts without words all stay.

    Rows are told apart by doc_id and text, so a row that shares its id with a copy but not the text stays.
    """
    columns = docs.columns
    docs = apart(docs, "doc_id", "text")
    label = settle(_labelled(docs, rules).filter("n_shingles > 0"), "labels")
    stays = label.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tie")).alias("at"))
    gone = label.join(stays, "component").filter("not (doc_id <=> at.doc_id and tie = at.tie)").select(F.col("doc_id").alias("__doc"), F.col("tie").alias("__tie")).distinct()
    tie = F.xxhash64("text")
    left = docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["__doc"]) & (tie == gone["__tie"]), "left_anti")
    # rows that repeat a kept id and text
    order = Window.partitionBy("doc_id", tie).orderBy(F.lit(0))
    left = left.withColumn("__k", F.row_number().over(order)).filter(F.expr("__k = 1 or text is null") | F.col("doc_id").isNull() & ~F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return together(left, columns)
