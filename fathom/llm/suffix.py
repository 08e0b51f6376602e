"""Removal of repeated byte strings by distributed, pruned prefix doubling.

Every string of ``length`` bytes that also starts earlier (smaller doc_id, or
same document, earlier start) has its bytes removed. Doubling over all
positions at once would sort many times the input, so positions that a first
sort settles leave before:

1. Rank by a prefix of ``PREFIX`` bytes, at the positions where content puts
   the smallest hash of each window: two equal strings have the same such
   anchor. Strings around an anchor whose rank is unique are unique and leave.
2. Rerank by the anchor's whole context (all its windows at once). A context
   that occurred before is wholly repeated; its first occurrence goes on
   only if the anchor has other contexts.
3. What is left, a few per cent, is sorted by document and place, cut into
   blocks, and doubled: in each round Spark deals the pairs (rank at p, rank at
   p + offset) of all positions by hash range and sorts them; a pair that
   is unique leaves, the others get a new rank, which goes back to the blocks.
   Offsets grow (25, 50 for 100 bytes) until ranks cover the length; then all
   but the earliest of each rank are repeats.

The ranks that the doubling begins with are 64-bit hashes, as is a pair's key.
Rows are packed by hash range, so a shuffle moves bytes; a task first drops
repeats within its own batch or block, so a passage in a third of all documents
adds one entry a batch. Fringe and spans reach the documents as sorted,
memory-mapped files in the shared folder: texts are never shuffled, but for
the contexts of the fringe.

Defined cases: a null text is empty; texts under ``length`` bytes lose
nothing; rows sharing a doc_id are told apart by their text's hash and ordered
by it; rows that repeat id and text get the same result; a null doc_id comes
first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .eliasfano import load, save
from .shared import discard, local_path, ranges_for, settle, shared_folder, write_file
from .textkit import BYTE_CODE, U64, chunks, mix64, pack, powers, release, text_buffer, unpack

PREFIX = 32
#: The doubling's first ranks cover so many bytes at least.
LEAST_SEED = 24
#: Bytes of a block of the fringe, at least.
BLOCK = 1 << 19
#: Positions that a hash range of a round gets, about; blocks aren't longer.
RANGE_POSITIONS = 2 << 20
#: Positions of a block for each hash range: a round's rows, one for a block and a range, don't get short as the input grows.
ROW_POSITIONS = 1 << 10
#: Blocks are long rows: Parquet looks at the size of each, and a file's row groups are read by several tasks.
LONG_ROWS = {"parquet.block.size": str(32 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}
#: Bytes whose anchors, or whose fringe, are worked on at once.
PIECE = 1 << 19
#: Bytes of text whose entries are sent together; repeats among them are dropped first.
GROUP = 12 << 20
LEAST = np.iinfo(np.int64).min
ENTRY = (("g", "<u4"), ("c", "<u8"), ("d", "<u4"), ("s", "<u4"))
PACKED = "key int, g binary, c binary, d binary, s binary, n binary, docs binary, ties binary"


def _prefix_sums(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(len(x) + 1)
    p = np.zeros(len(x) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum(BYTE_CODE[x] * up[: len(x)], out=p[1:])
    return p, down


def _prefix(length: int) -> int:
    return min(PREFIX, -(-length // 3))


def _count_kind(length: int) -> np.dtype:
    """The type for the number of windows that share an anchor."""
    return np.min_scalar_type(length - _prefix(length) + 1).newbyteorder("<")


def _repeated(g: np.ndarray) -> np.ndarray:
    """Indexes, ascending, of the values that occur more than once."""
    order = np.argsort(g)
    same = g[order[1:]] == g[order[:-1]]
    more = np.zeros(len(g), bool)
    more[order[1:][same]] = True
    more[order[:-1][same]] = True
    return np.flatnonzero(more)


def _kinds(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first index of each distinct key, number of each entry's key, entries of each key), keys ascending."""
    order = np.argsort(key)
    new = np.ones(len(key), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    start = np.flatnonzero(new)
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(new) - 1
    return np.minimum.reduceat(order, start) if len(key) else start, rank, np.diff(np.append(start, len(key)))


def anchors(x: np.ndarray, offs: np.ndarray, length: int):
    """(anchor rank, context rank, document, first window, windows) of each anchor's run of windows.

    x: documents end to end; starts count from the buffer's begin.
    """
    none = np.zeros(0, np.int64)
    prefix = _prefix(length)
    m, width = len(x) - length + 1, length - prefix + 1
    if m <= 0:
        return none.astype(U64), none.astype(U64), none, none, none
    p, down = _prefix_sums(x)
    with np.errstate(over="ignore"):
        g = mix64((p[prefix:] - p[:-prefix]) * down[: len(x) - prefix + 1])
    # the leftmost smallest hash of each window, by doubling window sizes
    low = ((g >> U64(32)) << U64(32)) | np.arange(len(g), dtype=U64)
    size = 1
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < width:
        low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
    at = (low[:m] & U64(0xFFFFFFFF)).astype(np.int64)
    ok = np.zeros(m, bool)
    for a, b in zip(offs[:-1], offs[1:]):
        if b - a >= length:
            ok[a : b - length + 1] = True
    start_of_doc = np.zeros(m, bool)
    start_of_doc[offs[:-1][offs[:-1] < m]] = True
    edge = np.ones(m, bool)
    edge[1:] = (at[1:] != at[:-1]) | (ok[1:] != ok[:-1]) | start_of_doc[1:]
    first = np.flatnonzero(edge)
    stop = np.append(first[1:], m)
    own = ok[first]
    first, stop = first[own], stop[own]
    a = at[first]
    with np.errstate(over="ignore"):
        c = (p[stop - 1 + length] - p[first]) * down[first]
        c = mix64(c + (a - first).astype(U64) * U64(0x9E3779B97F4A7C15) + (stop - first).astype(U64) * U64(0xD6E8FEB86659FD93))
    # the smallest hashes crowd at the low end: mixed again they spread over the shards
    return mix64(g[a]), c, np.searchsorted(offs, first, "right") - 1, first, stop - first


def _deal(key: np.ndarray, shards: int, parts: list[np.ndarray]) -> tuple[np.ndarray, list[list[bytes]]]:
    order = np.argsort(key, kind="stable")
    cut = np.searchsorted(key[order], np.arange(shards + 1))
    own = np.flatnonzero(np.diff(cut))
    return own, [[p[order[cut[k] : cut[k + 1]]].tobytes() for k in own] for p in parts]


def _file_of(doc: np.ndarray, tie: np.ndarray, files: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = mix64(doc.view(U64) * U64(0x9E3779B97F4A7C15) + tie.view(U64))
    return ((h >> U64(32)) * U64(files) >> U64(32)).astype(np.int64)


def _span_rows(doc, tie, start, size, files: int) -> pa.RecordBatch:
    """Spans packed by the file that their document's spans go to."""
    doc, tie = np.ascontiguousarray(doc, np.int64), np.ascontiguousarray(tie, np.int64)
    own, (d, t, s, n) = _deal(_file_of(doc, tie, files), files, [doc, tie, np.asarray(start, np.int64), np.asarray(size, np.int64)])
    none = [b""] * len(own)
    cols = [pa.array((-1 - own).astype(np.int32)), *(pa.array(x, pa.binary()) for x in (none, none, none, s, n, d, t))]
    return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in PACKED.split(", ")])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("doc"), F.coalesce(F.xxhash64("text"), F.lit(0).cast("long")).alias("tie"), "text")


def _packed_entries(data, offs, doc, tie, length: int, shards: int):
    """Spans and entries of some documents."""
    parts = []
    for i, j in chunks(offs, PIECE):
        g, c, d, s, n = anchors(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], length)
        parts.append((g, c, d + i, s - (offs[d + i] - offs[i]), n))
    if not parts:
        return
    g, c, d, s, n = (np.concatenate(x) for x in zip(*parts))
    # of equal contexts in this batch only the earliest competes; the others repeat it
    k = _repeated(g)
    k = k[np.lexsort((s[k], tie[d[k]], doc[d[k]], c[k], g[k]))]
    again = np.zeros(len(k), bool)
    again[1:] = (g[k[1:]] == g[k[:-1]]) & (c[k[1:]] == c[k[:-1]])
    if again.any():
        # rows that repeat id, text and place are one
        at = np.stack([doc[d[k]], tie[d[k]], s[k]])
        same = np.zeros(len(k), bool)
        same[1:] = again[1:] & (at[:, 1:] == at[:, :-1]).all(axis=0)
        lead = np.maximum.accumulate(np.where(again, -1, np.arange(len(k))))
        real = k[again & ~same & ~(at == at[:, lead]).all(axis=0)]
        yield _span_rows(doc[d[real]], tie[d[real]], s[real], n[real] + length - 1, shards)
        left = np.ones(len(g), bool)
        left[k[again]] = False
        g, c, d, s, n = (x[left] for x in (g, c, d, s, n))
    shard = ((g >> U64(32)) * U64(shards) >> U64(32)).astype(np.min_scalar_type(shards))
    order = np.argsort(shard, kind="stable")  # neighbours compress well
    cut = np.searchsorted(shard[order], np.arange(shards + 1))
    own = np.flatnonzero(np.diff(cut))
    cols: list[list[bytes]] = [[] for _ in range(7)]
    for k in own:
        o = order[cut[k] : cut[k + 1]]
        used, back = np.unique(d[o], return_inverse=True)
        for col, x in zip(cols, (g[o].astype("<u4"), c[o], back.astype("<u4"), s[o].astype("<u4"), n[o].astype(_count_kind(length)), doc[used], tie[used])):
            col.append(np.ascontiguousarray(x).tobytes())
    yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), *(pa.array(x, pa.binary()) for x in cols)], names=[c.split()[0] for c in PACKED.split(", ")])


def _entries(docs: DataFrame, length: int, shards: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            doc, tie = (batch.column(k).to_numpy().astype(np.int64) for k in range(2))
            data, offs = text_buffer(batch.column(2))
            for begin, end in chunks(offs, GROUP):
                yield from _packed_entries(data, offs[begin : end + 1], doc[begin:end], tie[begin:end], length, shards)
                release()

    return _keyed(docs).mapInArrow(run, PACKED)


def _ranked(packed: DataFrame, length: int, files: int) -> DataFrame:
    """Steps 1 and 2: spans of repeated contexts (key < 0, by file) and the fringe (key = file)."""

    def run(table: pa.Table) -> pa.Table:
        key = table.column("key")[0].as_py()
        if key < 0:
            return table
        cols = {name: table.column(name).to_pylist() for name in table.column_names if name != "key"}
        e = {name: np.frombuffer(b"".join(cols[name]), kind) for name, kind in (*ENTRY, ("n", _count_kind(length)))}
        docs, ties = (np.frombuffer(b"".join(cols[x]), "<i8") for x in ("docs", "ties"))
        shift = np.concatenate([[0], np.cumsum([len(b) // 8 for b in cols["docs"]])])[:-1]
        own = _repeated(e["g"])  # strings around an anchor that occurs once are unique
        d = (e["d"].astype(np.int64) + np.repeat(shift, [len(b) // 4 for b in cols["d"]]))[own]
        g, c, s, n = e["g"][own], e["c"][own], e["s"][own].astype(np.int64), e["n"][own].astype(np.int64)
        doc, tie = docs[d], ties[d]
        order = np.lexsort((s, tie, doc, c, g))
        g, c, s, n, doc, tie = (x[order] for x in (g, c, s, n, doc, tie))
        del e, d, own, cols
        fresh_g = np.ones(len(g), bool)
        fresh_g[1:] = g[1:] != g[:-1]
        fresh = fresh_g.copy()
        fresh[1:] |= c[1:] != c[:-1]
        lead = np.maximum.accumulate(np.where(fresh, np.arange(len(g)), 0))
        again = ~fresh & ~((s == s[lead]) & (doc == doc[lead]) & (tie == tie[lead]))
        group = np.cumsum(fresh_g) - 1
        fringe = fresh & (np.bincount(group[fresh])[group] > 1)
        spans = _span_rows(doc[again], tie[again], s[again], n[again] + length - 1, files)
        release()
        doc, tie, s, n = doc[fringe], tie[fringe], s[fringe], n[fringe]
        own, (ss, ns, ds, ts) = _deal(_file_of(doc, tie, files), files, [s, n, doc, tie])
        none = [b""] * len(own)
        cols = [pa.array(own.astype(np.int32)), *(pa.array(x, pa.binary()) for x in (none, none, none, ss, ns, ds, ts))]
        return pa.Table.from_batches([spans, pa.RecordBatch.from_arrays(cols, names=spans.schema.names)])

    return packed.groupBy("key").applyInArrow(run, PACKED)


def _joined(table: pa.Table, name: str) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), "<i8")


def _side_files(rows: DataFrame, folder: str, name: str, union: bool) -> dict[int, str]:
    """One sorted file for each key, of fields doc, tie, start, size; with union, spans merged. A path for each key."""
    root = local_path(folder)

    def run(table: pa.Table) -> pa.Table:
        key = table.column("key")[0].as_py()
        doc, tie, start, size = (_joined(table, x) for x in ("docs", "ties", "s", "n"))
        order = np.lexsort((start, tie, doc))
        doc, tie, start, size = (x[order] for x in (doc, tie, start, size))
        arrays = {"doc": doc, "tie": tie, "start": start, "size": size}
        if union and len(doc):
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1])
            # ends rise within a document once each is raised to those before it
            part = np.cumsum(new) - 1
            lift = part * (int((start + size).max()) + 1)
            reach = np.maximum.accumulate(start + size + lift)
            split = np.ones(len(doc), bool)
            split[1:] = new[1:] | (start[1:] + lift[1:] > reach[:-1])
            at = np.flatnonzero(split)
            end = np.append(reach[at[1:] - 1], reach[-1]) - lift[at]
            arrays = {"doc": doc[at], "tie": tie[at], "start": start[at], "size": end - start[at]}
        path = f"{root}/{name}-{key + (1 << 20):07d}.fef"
        write_file(path, save(arrays))
        release()
        return pa.table({"key": pa.array([key], pa.int32()), "path": [path]})

    return {r["key"]: r["path"] for r in rows.groupBy("key").applyInArrow(run, "key int, path string").collect()}  # a row per file


def _look(paths: dict[int, str], doc: np.ndarray, tie: np.ndarray, files: int):
    """Per file with any: (row of doc for each found entry, entry's index, the file's arrays)."""
    at = _file_of(doc, tie, files)
    for k in np.unique(at):
        path = paths.get(int(k)) or paths.get(-1 - int(k))
        if path is None:
            continue
        f = load(path)
        own = np.flatnonzero(at == k)
        lo, hi = np.searchsorted(f["doc"], doc[own], "left"), np.searchsorted(f["doc"], doc[own], "right")
        size = hi - lo
        row = np.repeat(own, size)
        entry = np.arange(int(size.sum())) + np.repeat(lo - (np.cumsum(size) - size), size)
        right = f["tie"][entry] == tie[row]
        yield row[right], entry[right], f


def _contexts(docs: DataFrame, paths: dict[int, str], length: int, files: int) -> DataFrame:
    """The fringe's contexts: (doc, tie, start, text), a row each."""

    def run(batches):
        for batch in batches:
            doc, tie = (batch.column(k).to_numpy().astype(np.int64) for k in range(2))
            # rows that repeat id and text bring their contexts once
            _, once = np.unique(np.stack([doc, tie]), axis=1, return_index=True) if len(doc) else (None, np.zeros(0, int))
            data, offs = text_buffer(batch.column(2))
            for r, e, f in _look(paths, doc[once], tie[once], files):
                row, s = once[r], f["start"][e]
                begin = offs[row] + s
                texts = [data[a:b].tobytes() for a, b in zip(begin.tolist(), (begin + f["size"][e] + length - 1).tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array(tie[row]), pa.array(s.astype(np.int64)), pa.array(texts, pa.binary())], names=["doc", "tie", "start", "text"])

    return _keyed(docs).mapInArrow(run, "doc long, tie long, start long, text binary")


#: What a block's rows in a round carry of its contexts.
LAYOUT = np.dtype([("size", "<u4"), ("start", "<i8"), ("doc", "<i8"), ("tie", "<i8")])


def _block_bytes(shards: int) -> int:
    """Bytes of a block, so that it has enough positions for each of the hash ranges."""
    return min(max(BLOCK, ROW_POSITIONS * shards), max(BLOCK, RANGE_POSITIONS))


def _blocks(contexts: DataFrame, least: int) -> DataFrame:
    """Contexts sorted by document and place, in blocks of about ``least`` bytes: (block, layout, text). Blocks ascend in that order."""

    def run(batches):
        from pyspark import TaskContext

        base, last = TaskContext.get().partitionId() << 32, None
        held, texts, size = [], [], 0

        def block():
            sizes = [len(t) for t in texts]
            layout = np.empty(len(held), LAYOUT)
            layout["size"] = sizes
            for k, name in enumerate(("doc", "tie", "start")):
                layout[name] = [h[k] for h in held]
            return pa.RecordBatch.from_arrays([pa.array([base]), pa.array([layout.tobytes()]), pa.array([b"".join(texts)])], names=["block", "layout", "text"])

        for batch in batches:
            for *at, text in zip(*(c.to_pylist() for c in batch.columns)):
                if at == last:
                    continue  # rows that repeat id and text, in other batches
                last = at
                held.append(at), texts.append(text)
                size += len(text)
                if size >= least:
                    yield block()
                    held, texts, size, base = [], [], 0, base + 1
        if held:
            yield block()

    parts = ranges_for(contexts)
    return contexts.repartitionByRange(parts, "doc", "tie", "start").sortWithinPartitions("doc", "tie", "start").mapInArrow(run, "block long, layout binary, text binary")


def doubling_sizes(length: int) -> list[int]:
    """Bytes that ranks cover, round by round: each at most twice the one before."""
    k = 1
    while -(-length >> (k + 1)) >= LEAST_SEED:
        k += 1
    return [-(-length >> i) for i in range(k, -1, -1)]


#: A block's layout and, packed, its positions that are left with the two halves of their ranks.
STATE = "block long, layout binary, at binary, seeded boolean"
SENT = "key int, block long, a binary, b binary"


def _seeded(layout: bytes, text: bytes, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's positions with their first ranks, hashes of as many bytes as the seed says."""
    x = np.frombuffer(text, np.uint8)
    at = np.flatnonzero(_room(layout) >= seed)
    p, down = _prefix_sums(x)
    with np.errstate(over="ignore"):
        return at, mix64((p[at + seed] - p[at]) * down[at])


def _ranks(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    at, low, high = unpack(packed, 3, U4)
    return at.astype(np.int64), low.astype(U64) | (high.astype(U64) << U64(32))


def _room(layout: bytes) -> np.ndarray:
    """Bytes from each position of a block to its context's end."""
    size = np.frombuffer(layout, LAYOUT)["size"].astype(np.int64)
    return np.repeat(np.cumsum(size), size) - np.arange(int(size.sum()))


def _pairs(state: DataFrame, size: int, after: int, shards: int) -> DataFrame:
    """SENT rows of a round, of STATE or, in the first, of the blocks themselves: by hash range, a block's distinct pairs (key, with its earliest position and whether it has more); with key < 0, its layout and the other positions of such pairs."""

    def run(batches):
        for batch in batches:
            for block, layout, *held in zip(*(c.to_pylist() for c in batch.columns)):
                at, rank = _seeded(layout, *held, size) if len(held) == 1 else _ranks(held[0])
                room = _room(layout)
                place = np.full(len(room) + 1, -1, np.int64)
                place[at] = np.arange(len(at))
                own = np.flatnonzero(room[at] >= after)
                other = place[at[own] + after - size]
                own, other = own[other >= 0], other[other >= 0]  # a unique half makes a unique whole
                with np.errstate(over="ignore"):
                    key = mix64(rank[own] * U64(0x9E3779B97F4A7C15) + mix64(rank[other] + U64(1)))
                at = at[own]
                first, rank, n = _kinds(key)
                earliest = at[first[rank]]
                more = earliest != at
                many = np.zeros(len(key), bool)
                many[first] = n > 1
                # by range, then by place
                shard = (key[first] >> U64(32)) * U64(shards) >> U64(32)
                mixed = np.sort(shard << U64(32) | first.astype(U64))
                first = (mixed & U64(0xFFFFFFFF)).astype(np.int64)
                u, lead, many = key[first], at[first], many[first]
                cut = np.searchsorted(mixed >> U64(32), np.arange(shards + 1, dtype=U64))
                rows = [(k, block, u[cut[k] : cut[k + 1]].tobytes(), pack([lead[cut[k] : cut[k + 1]], many[cut[k] : cut[k + 1]]], U4)) for k in np.flatnonzero(np.diff(cut)).tolist()]
                rows.append((-1 - block % shards, block, layout, pack([at[more], earliest[more]], U4)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=[c.split()[0] for c in SENT.split(", ")])
                release()

    return state.mapInArrow(run, SENT)


U4 = np.dtype("<u4")


def _reranked(sent: DataFrame, last: bool) -> DataFrame:
    """SENT rows by block: positions whose pair isn't unique with the number of their rank in the range; in the last round, those whose pair is found earlier."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("key")[0].as_py()
        if shard < 0:
            return table
        table = table.sort_by("block")  # blocks ascend by document and place
        keys = [np.frombuffer(b, U64) for b in table.column("a").to_pylist()]
        at, many = zip(*(unpack(b, 2, U4) for b in table.column("b").to_pylist()))
        at, many, size = np.concatenate(at), np.concatenate(many) > 0, [len(k) for k in keys]
        key = np.concatenate(keys)
        del keys
        first, rank, n = _kinds(key)
        keep = np.arange(len(key)) != first[rank] if last else many | (n[rank] > 1)
        cut = np.concatenate([[0], np.cumsum(size)])
        a, b = [], []
        for i, j in zip(cut[:-1], cut[1:]):
            own = keep[i:j]
            a.append(pack([at[i:j][own], rank[i:j][own]], U4)), b.append(b"")
        release()
        return pa.Table.from_arrays([table.column("key"), table.column("block"), pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=table.column_names)

    return sent.groupBy("key").applyInArrow(run, SENT)


def _gathered(table: pa.Table) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's (layout, positions, ranks, other positions of their pairs, whose earliest)."""
    layout, at, rank, more = b"", [np.zeros(0, U4)], [np.zeros(0, U64)], None
    for key, a, b in zip(*(table.column(c).to_pylist() for c in ("key", "a", "b"))):
        if key < 0:
            layout, more = a, unpack(b, 2, U4)
        else:
            own, low = unpack(a, 2, U4)
            at.append(own)
            rank.append(low.astype(U64) | U64(key << 32))
    return layout, np.concatenate(at), np.concatenate(rank), *more


def _next_state(ranked: DataFrame) -> DataFrame:
    """STATE after a round: the positions that are left, each with its pair's new rank."""

    def run(table: pa.Table) -> pa.Table:
        layout, at, rank, more, lead = _gathered(table)
        place = np.zeros(len(_room(layout)), np.int64)
        place[at] = np.arange(len(at))
        every, ranks = np.concatenate([at, more]), np.concatenate([rank, rank[place[lead]]])
        order = np.argsort(every)
        ranks = ranks[order]
        packed = pack([every[order], ranks & U64(0xFFFFFFFF), ranks >> U64(32)], U4)
        return pa.table({"block": table.column("block").slice(0, 1), "layout": pa.array([layout]), "at": pa.array([packed]), "seeded": pa.array([False])})

    return ranked.groupBy("block").applyInArrow(run, STATE)


def _repeats(ranked: DataFrame, length: int, files: int) -> DataFrame:
    """Spans, packed by file, of the positions that the last round found to be repeats: all but each rank's earliest."""

    def run(table: pa.Table) -> pa.Table:
        layout, at, _, more, _ = _gathered(table)
        own = np.frombuffer(layout, LAYOUT)
        begin = np.concatenate([[0], np.cumsum(own["size"].astype(np.int64))])
        at = np.sort(np.concatenate([at, more])).astype(np.int64)
        row = np.searchsorted(begin, at, "right") - 1
        new = np.ones(len(at), bool)
        new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
        k = np.flatnonzero(new)
        n = np.diff(np.append(k, len(at)))
        row = row[k]
        return pa.Table.from_batches([_span_rows(own["doc"][row], own["tie"][row], own["start"][row] + at[k] - begin[row], n + length - 1, files)])

    return ranked.groupBy("block").applyInArrow(run, PACKED)


def _doubled(contexts: DataFrame, length: int, files: int) -> DataFrame:
    """Step 3: spans of the fringe's repeated strings, packed by file."""
    total = contexts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    shards = max(files, -(-total // RANGE_POSITIONS))
    blocks = settle(_blocks(contexts, _block_bytes(shards)), "blocks", LONG_ROWS)
    discard(contexts)
    sizes = doubling_sizes(length)
    state = blocks
    for size, after in zip(sizes, sizes[1:]):
        ranked = _reranked(_pairs(state, size, after, shards), after == length)
        made = settle(_repeats(ranked, length, files) if after == length else _next_state(ranked), f"rank{after}", LONG_ROWS)
        discard(state)
        state = made
    return state


COLUMNS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def dedup_bytes(docs: DataFrame, length: int = 100, with_text: bool = False) -> DataFrame:
    """Per row of docs (doc_id, text): bytes, bytes removed, removed runs, digest of what is left (and, if asked, the bytes left)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    folder = shared_folder(spark)
    shards = files = ranges_for(docs)
    ranked = settle(_ranked(_entries(docs, length, shards), length, files), "ranked")
    fringe = _side_files(ranked.filter("key >= 0"), folder, "fringe", False)
    extra = _doubled(settle(_contexts(docs, fringe, length, files), "contexts"), length, files)
    spans = _side_files(ranked.filter("key < 0").union(extra), folder, "spans", True)
    discard(ranked, extra)

    def run(batches):
        for batch in batches:
            doc, tie = (batch.column(k).to_numpy().astype(np.int64) for k in range(2))
            data, offs = text_buffer(batch.column(2))
            cut: dict[int, list] = {}
            for row, e, f in _look(spans, doc, tie, files):
                for r, a, n in zip(row.tolist(), f["start"][e].tolist(), f["size"][e].tolist()):
                    cut.setdefault(r, []).append((a, n))
            sizes, removed, runs, digests, left = [], [], [], [], []
            for r in range(len(doc)):
                b = data[offs[r] : offs[r + 1]].tobytes()
                gone, at, h, parts = 0, 0, hashlib.sha256(), []
                for a, n in cut.get(r, ()):
                    h.update(b[at:a])
                    if with_text:
                        parts.append(b[at:a])
                    gone += n
                    at = a + n
                h.update(b[at:])
                sizes.append(len(b)), removed.append(gone), runs.append(len(cut.get(r, ()))), digests.append(h.hexdigest())
                if with_text:
                    left.append(b"".join([*parts, b[at:]]))
            cols = [pa.array(doc, mask=doc == LEAST), *(pa.array(x, pa.int64()) for x in (sizes, removed, runs)), pa.array(digests, pa.string())]
            names = [c.split()[0] for c in COLUMNS.split(", ")]
            if with_text:
                cols.append(pa.array(left, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return _keyed(docs).mapInArrow(run, COLUMNS + (", kept binary" if with_text else ""))
