"""Line de-duplication by a segment-partition edit join.

Equal lines form classes, and so do lines within as many edits of each other
as the shorter one allows: one for each ``chars_per_edit`` of its code points,
up to ``threshold``. Of each class the earliest line (smallest doc_id, then
place) stays. A line that allows t edits is cut into t + 1 even segments. Two
lines within t edits share one of the shorter line's segments, at a place of
the longer line that the length difference bounds, so each line posts its
segments and probes the substrings that can meet a segment of a line as long
or up to t shorter. Candidates are verified with a banded bit-parallel edit
distance, many pairs in lockstep.

Equal lines are one from the start: a batch posts each distinct line once.
Long lists of candidates compare neighbours first and, after components, what
lies between different ones (see jaccard), so near copies in thousands cost in
proportion to their number.

Defined cases: a null text stays null; empty lines and short ones without a
word always stay (from threshold * chars_per_edit code points on, lines without
a word are judged too); lines that allow no edit only meet equal ones; rows that
repeat id and text are one and both keep a class's earliest line; a null
doc_id comes first. An empty table gives no rows. Columns of the results'
names are replaced, others of any name are carried as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .classfiles import class_files, found_in
from .jaccard import candidate_lists, candidates, classes_linked, entry_rows, packed_entries, pairs_between, sketch, verified
from .shared import apart, column, discard, ranges_for, settle, shared_folder, together
from .textkit import CHUNK_BYTES, U64, chunks, mix64, powers, text_buffer, tidy

LEAST = np.iinfo(np.int64).min
#: Bytes of text whose lines are looked up at once: their arrays' memory is used again, not asked of the system anew.
LOOK_BYTES = 1 << 19
#: Hashes of the first code points; those of others are computed.
POINT_CODE = mix64(np.arange(1, (1 << 16) + 1, dtype=U64))


@dataclass(frozen=True)
class LineRules:
    threshold: int = 2
    min_chars: int = 1
    chars_per_edit: int = 10

    def edits(self, size):
        """The edits that a pair is allowed whose shorter line has size code points."""
        return np.minimum(self.threshold, size // self.chars_per_edit)


class Lines:
    """The judged lines of documents [i, j) as code points, with their hashes."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, i: int, j: int, rules: LineRules):
        raw = data[offs[i] : offs[j]]
        self.points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4")
        own = offs[i : j + 1] - offs[i]
        own = own - np.searchsorted(np.flatnonzero((raw & 0xC0) == 0x80), own)
        nl = np.flatnonzero(self.points == 10)
        start = np.sort(np.concatenate([own[:-1], nl + 1]), kind="stable")
        end = np.sort(np.concatenate([nl, own[1:]]), kind="stable")
        per = 1 + np.bincount(np.searchsorted(own, nl, "right") - 1, minlength=j - i)[: j - i]
        doc = np.repeat(np.arange(i, j), per)
        place = np.arange(len(start)) - np.repeat(np.cumsum(per) - per, per)
        white = np.flatnonzero((self.points == 32) | (self.points - np.uint32(9) < 5))
        size = end - start
        word = np.searchsorted(white, end) - np.searchsorted(white, start) < size
        use = (size >= rules.min_chars) & (word | (size >= rules.threshold * rules.chars_per_edit))
        self.start, self.end, self.doc, self.place = start[use], end[use], doc[use], place[use]
        up, down = powers(len(self.points) + 1)
        with np.errstate(over="ignore"):
            code = POINT_CODE.take(self.points, mode="clip")
            high = np.flatnonzero(self.points >= len(POINT_CODE))
            code[high] = mix64(self.points[high].astype(U64) + U64(1))
            code *= up[: len(code)]
            self.sums = np.zeros(len(code) + 1, U64)
            np.cumsum(code, out=self.sums[1:])
        self.down = down
        self.hash = self.spans(self.start, self.end)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))

    def text(self, k: int) -> str:
        return self.points[self.start[k] : self.end[k]].tobytes().decode("utf-32-le", "surrogatepass")


def line_sketch(points: np.ndarray) -> bytes:
    """Parities of a line's neighbouring pairs of code points."""
    return sketch((points[:-1].astype(U64) << U64(32)) | points[1:].astype(U64), len(points))


def segments(length: np.ndarray, i: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of segment i of lines of such lengths: the later ones are longer by one where parts don't divide."""
    base, more = length // parts, length % parts
    return i * base + np.maximum(0, i - (parts - more)), base + (i >= parts - more)


def line_entries(lines: Lines, own: np.ndarray, rules: LineRules) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, entries) of the lines: own segments, and substrings that may be a segment of a shorter line."""
    start, size, cls = lines.start[own], lines.end[own] - lines.start[own], lines.hash[own].view(np.int64)
    sigs, rows = [], []

    def post(at, n, length, i, keep, index):
        with np.errstate(over="ignore"):
            sig = mix64(lines.spans(start[keep] + at[keep], start[keep] + at[keep] + n[keep]) + length[keep].astype(U64) * U64(0x9E3779B97F4A7C15) + U64(i + 1) * U64(0xC2B2AE3D27D4EB4F))
        sigs.append(sig)
        rows.append(entry_rows(sig, size[keep], cls[keep], index))

    # the shorter line's length, which is part of the signature, tells the edits
    for t in range(1, rules.threshold + 1):
        for i in range(t + 1):
            at, n = segments(size, i, t + 1)
            post(at, n, size, i, rules.edits(size) == t, True)
            for less in range(t + 1):
                length = size - less
                at, n = segments(length, i, t + 1)
                # i edits at most before the segment, and t - i after it
                for move in range(max(-i, less - (t - i)), min(i, less + (t - i)) + 1):
                    if less or move:
                        post(at + move, n, length, i, (rules.edits(length) == t) & (at + move >= 0) & (at + move + n <= size) & (n > 0), False)
    return np.concatenate(sigs), np.concatenate(rows)


def edits_within(a: list[np.ndarray], b: list[np.ndarray], t: int) -> np.ndarray:
    """Whether each pair of code point strings is within t edits: a band of diagonals in one word, pairs in lockstep."""
    n = len(a)
    out = np.zeros(n, bool)
    sa, sb, la, lb = (np.zeros(n, np.int64) for _ in range(4))
    for k, (x, y) in enumerate(zip(a, b)):
        # equal ends go, but for as many points as the band needs
        m = min(len(x), len(y))
        diff = np.flatnonzero(x[:m] != y[:m])
        head = max(0, (int(diff[0]) if len(diff) else m) - t - 1)
        room = max(0, m - head - t - 1)
        diff = np.flatnonzero(x[len(x) - room :][::-1] != y[len(y) - room :][::-1]) if room else ()
        tail = int(diff[0]) if len(diff) else room
        sa[k] = sb[k] = head
        la[k], lb[k] = len(x) - head - tail, len(y) - head - tail
    short = np.flatnonzero((la <= t) | (lb <= t))
    for k in short:
        out[k] = _distance(a[k][sa[k] : sa[k] + la[k]], b[k][sb[k] : sb[k] + lb[k]]) <= t
    live = np.flatnonzero((la > t) & (lb > t) & (np.abs(la - lb) <= t))
    if not len(live):
        return out
    pa_, pb = np.concatenate([*a, np.zeros(1, np.uint32)]), np.concatenate([*b, np.zeros(1, np.uint32)])
    base_a = np.concatenate([[0], np.cumsum([len(x) for x in a])])[:-1] + sa
    base_b = np.concatenate([[0], np.cumsum([len(x) for x in b])])[:-1] + sb
    one, full = U64(1), ~U64(0)
    vp = np.full(len(live), full << U64(63 - t), U64)
    vn = np.zeros(len(live), U64)
    dist = np.full(len(live), t, np.int64)
    i = 0
    with np.errstate(over="ignore"):
        while len(live):
            m, ch = la[live], pb[base_b[live] + i]
            eq = np.zeros(len(live), U64)
            for k in range(2 * t + 1):  # bit 63 - k: the a-point on diagonal t - k
                at = i + t - k
                ok = (at < m) & (at >= 0)
                eq |= (ok & (pa_[base_a[live] + np.where(ok, at, 0)] == ch)).astype(U64) << U64(63 - k)
            d0 = (((eq & vp) + vp) ^ vp) | eq | vn
            hp, hn = vn | ~(d0 | vp), d0 & vp
            down = i < m - t
            bit = np.where(down, 63, 62 - (i - (m - t))).astype(U64)
            dist += np.where(down, ((d0 >> bit) & one) == 0, ((hp >> bit) & one).astype(np.int64) - ((hn >> bit) & one).astype(np.int64))
            vp, vn = hn | ~((d0 >> one) | hp), (d0 >> one) & hp
            i += 1
            ended = i == lb[live]
            out[live[ended]] = dist[ended] <= t
            on = ~ended & (dist <= t + 2 * t + 1)
            live, vp, vn, dist = live[on], vp[on], vn[on], dist[on]
    return out


def _distance(x: np.ndarray, y: np.ndarray) -> int:
    row = list(range(len(y) + 1))
    for i, p in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, q in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (p != q))
    return row[-1]


def edit_matcher(rules: LineRules):
    def matches(t: pa.Table, a: list, b: list) -> np.ndarray:
        points = {c: np.frombuffer(x.encode("utf-32-le", "surrogatepass"), "<u4") for c, x in zip(t.column("class").to_pylist(), t.column("text").to_pylist())}
        allowed = rules.edits(np.array([min(len(points[x]), len(points[y])) for x, y in zip(a, b)], np.int64))
        out = np.zeros(len(a), bool)
        for t in range(1, rules.threshold + 1):
            own = np.flatnonzero(allowed == t)
            out[own] = edits_within([points[a[k]] for k in own], [points[b[k]] for k in own], t)
        return out

    return matches


def _keyed(docs: DataFrame) -> list:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("__doc"), F.coalesce(F.xxhash64("text"), F.lit(0).cast("long")).alias("__tie"), F.col("text").alias("__text")]


def _first_of_batch(batch, rules: LineRules, size: int = CHUNK_BYTES):
    """Distinct lines of a batch: (lines object, index within it) in parts, with (hash, doc, tie, place, count)."""
    doc, tie = (batch.column(k).to_numpy().astype(np.int64) for k in range(2))
    data, offs = text_buffer(batch.column(2))
    for i, j in chunks(offs, size):
        ls = Lines(data, offs, i, j, rules)
        order = np.lexsort((ls.place, tie[ls.doc], doc[ls.doc], ls.hash))
        h = ls.hash[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        at = np.flatnonzero(new)
        yield ls, order[at], doc, tie, np.diff(np.append(at, len(h)))


def repeated_lines(docs: DataFrame, rules: LineRules = LineRules()) -> tuple[dict[int, str], int]:
    """Files with the earliest line of each class that has more than one line, and their number's base."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    shards = files = ranges_for(docs)
    keyed = docs.select(*_keyed(docs))

    @tidy
    def firsts(batches):
        for batch in batches:
            for ls, own, doc, tie, n in _first_of_batch(batch, rules):
                d = ls.doc[own]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ls.hash[own].view(np.int64), doc[d], tie[d], ls.place[own], n)], names=["class", "doc", "tie", "place", "n"])

    first = keyed.mapInArrow(firsts, "class long, doc long, tie long, place long, n long").groupBy("class").agg(F.min(F.struct("doc", "tie", "place")).alias("at"), F.sum("n").alias("n"))
    first = settle(first.select("class", "at.*", "n"), "firsts")

    @tidy
    def post(batches):
        for batch in batches:
            for ls, own, *_ in _first_of_batch(batch, rules):
                if len(own):
                    yield packed_entries(*line_entries(ls, own, rules), shards)

    lists = settle(candidate_lists(keyed.mapInArrow(post, "shard int, blob binary"), 0), "lists")
    wanted = lists.select(F.explode("classes").alias("class")).distinct()
    wanted = class_files(wanted, folder, "wanted", files)

    @tidy
    def texts(batches):
        for batch in batches:
            for ls, own, *_ in _first_of_batch(batch, rules, LOOK_BYTES):
                hit = np.sort(np.concatenate([own[o] for o, _, _ in found_in(wanted, ls.hash[own], files)] or [own[:0]]))
                points = [ls.points[ls.start[k] : ls.end[k]] for k in hit]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ls.hash[hit].view(np.int64)), pa.array([ls.text(k) for k in hit], pa.string()), pa.array(map(len, points), pa.int64()), pa.array(map(line_sketch, points), pa.binary())],
                    names=["class", "text", "n", "sketch"],
                )

    made = keyed.mapInArrow(texts, "class long, text string, n long, sketch binary")
    text = settle(made.groupBy("class").agg(*[F.first(c).alias(c) for c in ("text", "n", "sketch")]), "texts")
    # an edit changes two pairs of neighbours for two others at most
    sketches, bound = text.select("class", "n", "sketch"), lambda n_a, n_b, diff: diff <= 4 * rules.edits(np.minimum(n_a, n_b))
    tested = candidates(lists, 0, sketches, bound)

    def judge(pairs: DataFrame) -> DataFrame:
        return verified(pairs, text.select("class", "text"), edit_matcher(rules))

    def between(few: int | None):
        """First the nearest pairs between each two components, at last all."""
        return lambda members: judge(settle(pairs_between(members.join(sketches.select("class", "sketch"), "class"), 0, bound, few).join(tested, ["a", "b"], "left_anti"), "rest"))

    found = classes_linked(lists, tested, judge, [between(2), between(None)])
    named = first.join(found.withColumnRenamed("node", "class"), "class", "left")
    least = named.filter("component is not null").groupBy("component").agg(F.min(F.struct("doc", "tie", "place")).alias("at"))
    linked = named.filter("component is not null").select("class", "component").join(least, "component").select("class", "at.*")
    alone = named.filter("component is null and n > 1").select("class", "doc", "tie", "place")
    kept = class_files(linked.union(alone), folder, "kept", files)
    discard(lists, text, first, found, tested)
    return kept, files


def dedup_lines(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """docs with the text's later lines of each class removed, and n_lines, n_dropped, chars_left (0 to 1: share of code points in lines that stay)."""
    kept, files = repeated_lines(docs, rules)
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "chars_left")]
    held = apart(docs.select(*[column(c) for c in own]), "doc_id", "text")
    fields = held.select(*_keyed(held), F.struct("doc_id", "__rest").alias("__row"))

    @tidy
    def run(batches):
        for batch in batches:
            doc, tie = (batch.column(k).to_numpy().astype(np.int64) for k in range(2))
            data, offs = text_buffer(batch.column(2))
            valid = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            gone: dict[int, set] = {}
            for i, j in chunks(offs, LOOK_BYTES):
                ls = Lines(data, offs, i, j, rules)
                for k, e, f in found_in(kept, ls.hash, files):
                    d, p = ls.doc[k], ls.place[k]
                    drop = (f["doc"][e] != doc[d]) | (f["tie"][e] != tie[d]) | (f["place"][e] != p)
                    for x, y in zip(d[drop].tolist(), p[drop].tolist()):
                        gone.setdefault(x, set()).add(y)
            texts, n, dropped, left = [], [], [], []
            for r in range(len(doc)):
                text = data[offs[r] : offs[r + 1]].tobytes().decode("utf-8", "replace") if valid[r] else None
                out = gone.get(r)
                if not out:
                    texts.append(text), n.append(0 if text is None else text.count("\n") + 1), dropped.append(0), left.append(1.0)
                    continue
                parts = text.split("\n")
                stay = [x for k, x in enumerate(parts) if k not in out]
                texts.append("\n".join(stay)), n.append(len(parts)), dropped.append(len(parts) - len(stay))
                left.append(sum(map(len, stay)) / sum(map(len, parts)))
            yield pa.RecordBatch.from_arrays([batch.column(3), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(left, pa.float64())], names=["__row", "text", "n_lines", "n_dropped", "chars_left"])

    from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

    out = StructType([fields.schema["__row"], StructField("text", StringType()), StructField("n_lines", LongType()), StructField("n_dropped", LongType()), StructField("chars_left", DoubleType())])
    made = fields.mapInArrow(run, out).select("__row.*", "text", "n_lines", "n_dropped", "chars_left")
    return together(made, [*own, "n_lines", "n_dropped", "chars_left"])
