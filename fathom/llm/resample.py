"""Importance resampling of documents towards the feature distribution of target texts.

Features are runs of consecutive words, hashed into buckets. A document's
weight is the sum of its features' gains (log ratio of the bucket's share in
the target and in the documents), looked up in one array; seeded Gumbel noise
on top makes the highest scores a draw without replacement.

The draw is an external merge. Each partition's eligible rows are sorted by
Spark and written as one run, a file of fixed records in the shared folder.
Keys taken from the runs at regular steps split the order into ranges of about
``range_rows``; each run is cut at the splitters by binary search, counts of
the slices give every range its first rank, and ranges past the draw are never
read. A range's slices are merged by a tournament tree that holds one block of
each; the last range stops at the draw's last row. A slice list is bounded by
the number of runs, so one task never holds more than a block of each run, and
equal scores are split too, as the order goes on by document id.

Defined cases: a null text has no words; a null doc_id is hashed as an empty
one and comes last among equal scores; rows that repeat an id are drawn
separately (equal scores go by feature count, then by weight). Without
documents there are no rows; without target texts every gain is that of t = 0;
with fewer eligible documents than make up one, nothing is drawn. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import os
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, local_path, remove, settle, shared_folder, small_batches
from .spans import byte_class, gathered, runs, span_crc32
from .textkit import LOWER, chunks, release, text_buffer

#: Digits, letters and every byte of a code point over U+007F.
WORD = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
RECORD = np.dtype([("score", "<i8"), ("null_id", "i1"), ("doc_id", "<i8"), ("n_features", "<i8"), ("weight", "<i8"), ("n_words", "<i8"), ("row", "<i8")])
#: Keys that the driver takes from all runs together, apart from one for each run.
SPLIT_KEYS = 10_000


@dataclass(frozen=True)
class ResampleRules:
    #: Features are runs of 1 to this many words.
    most_words: int = 1
    buckets: int = 10_000
    seed: str = "2024"
    #: Documents with fewer words are never drawn.
    least_words: int = 20
    percent: int = 10
    range_rows: int = 1 << 18
    block_rows: int = 4096


def feature_buckets(data: np.ndarray, offs: np.ndarray, rules: ResampleRules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, first, words) of the features of the texts in data, whose bounds from 0 are offs: first is each text's first feature, then their number; words counts each text's."""
    low = LOWER[data]
    start, end, first = runs(WORD[data], offs)
    words = np.diff(first)
    if rules.most_words == 1:
        return span_crc32(low, start, end) % np.uint32(rules.buckets), first, words
    # words one space apart, so that a feature is one span
    spaced, at = gathered(np.append(low, np.uint8(32)), start, end - start + 1)
    spaced[at[1:] - 1] = 32
    doc = np.repeat(np.arange(len(words)), words)
    found, of = [], []
    for n in range(1, rules.most_words + 1):
        k = np.arange(max(0, len(start) - n + 1))
        k = k[doc[k] == doc[k + n - 1]]
        found.append(span_crc32(spaced, at[k], at[k + n] - 1) % np.uint32(rules.buckets))
        of.append(doc[k])
    of = np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return np.concatenate(found)[order], np.searchsorted(of[order], np.arange(len(words) + 1)), words


def bucket_counts(texts: DataFrame, rules: ResampleRules) -> np.ndarray:
    """Features of all texts by bucket: summed in each task, then over tasks; the driver gets one number a bucket."""

    def count(batches):
        n = np.zeros(rules.buckets, np.int64)
        for batch in batches:
            data, offs = text_buffer(batch.column(0))
            for i, j in chunks(offs):
                b, _, _ = feature_buckets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], rules)
                n += np.bincount(b, minlength=rules.buckets)
            del data
            release()
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(n[held])], names=["bucket", "n"])

    out = np.zeros(rules.buckets, np.int64)
    for r in texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    k, all_s, all_t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log(((t + 1.0) * (all_s + k)) / ((s + 1.0) * (all_t + k)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def scored(docs: DataFrame, gains: np.ndarray, rules: ResampleRules) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of each row of docs."""
    table = docs.sparkSession.sparkContext.broadcast(gains)

    def weigh(batches):
        gain = table.value
        for batch in batches:
            data, offs = text_buffer(batch.column(1))
            for i, j in chunks(offs):
                b, first, words = feature_buckets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], rules)
                total = np.concatenate([[0], np.cumsum(gain[b])])
                ids = batch.column(0).slice(i, j - i)
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, (words, np.diff(first), total[first[1:]] - total[first[:-1]]))], names=["doc_id", "n_words", "n_features", "weight"])
            del data
            release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")
    text = F.concat(F.lit(f"{rules.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    return rows.withColumn("score", F.col("weight") + noise)


def _key(r) -> tuple:
    """The order of the draw; r is a record, or a tuple of its values."""
    score, *rest = (int(x) for x in r)
    return -score, *rest


def write_runs(eligible: DataFrame, folder: str, step: int) -> DataFrame:
    """run, n, keys: a file of sorted records for each partition of eligible (the fields of RECORD), and the key of every step-th.

    An attempt that is lost or repeated leaves a file that no row names.
    """

    def write(batches):
        os.makedirs(folder, exist_ok=True)
        name, n, keys = uuid.uuid4().hex, 0, []
        with open(os.path.join(folder, name), "wb") as f:
            for batch in batches:
                block = np.empty(batch.num_rows, RECORD)
                for c in RECORD.names:
                    block[c] = batch.column(c).to_numpy()
                keys += [_key(block[k]) for k in range(-n % step, len(block), step)]
                n += len(block)
                f.write(block.tobytes())
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([[list(k) for k in keys]], pa.list_(pa.list_(pa.int64())))], names=["run", "n", "keys"])

    order = [F.desc("score"), "null_id", "doc_id", "n_features", "weight", "n_words", "row"]
    return settle(eligible.select(*RECORD.names).sortWithinPartitions(*order).mapInArrow(write, "run string, n long, keys array<array<long>>"), "runs")


def opened(folder: str, name: str) -> np.ndarray:
    return np.memmap(os.path.join(folder, name), RECORD, "r")


def slices(manifest: DataFrame, folder: str, splitters: list[tuple]) -> DataFrame:
    """range, run, lo, hi: each run cut at the splitters; empty slices are left out."""

    def cut(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                run = opened(folder, name)
                at = [0, *(bisect_left(run, x, key=_key) for x in splitters), len(run)]
                held = [k for k in range(len(at) - 1) if at[k] < at[k + 1]]
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array([name] * len(held)), pa.array([at[k] for k in held], pa.int64()), pa.array([at[k + 1] for k in held], pa.int64())], names=["range", "run", "lo", "hi"])

    return settle(manifest.select("run").mapInArrow(cut, "range long, run string, lo long, hi long"), "slices")


class Tournament:
    """Merges sorted iterators of keys: a node holds the source whose head is the least below it; the root's head goes out, its source moves on and its path is played again."""

    def __init__(self, sources: list[Iterator[tuple]]):
        self.size = 1 << max(0, len(sources) - 1).bit_length()
        self.sources = sources
        self.heads = [next(s, None) for s in sources] + [None] * (self.size - len(sources))
        self.tree = [0] * self.size + list(range(self.size))
        for k in range(self.size - 1, 0, -1):
            self._play(k)

    def _play(self, k: int) -> None:
        a, b = self.tree[2 * k], self.tree[2 * k + 1]
        x, y = self.heads[a], self.heads[b]
        self.tree[k] = b if x is None or (y is not None and y < x) else a

    def __iter__(self) -> Iterator[tuple]:
        while True:
            best = self.tree[1]
            head = self.heads[best]
            if head is None:
                return
            yield head
            self.heads[best] = next(self.sources[best], None)
            k = (best + self.size) >> 1
            while k:
                self._play(k)
                k >>= 1


def run_slice(folder: str, name: str, lo: int, hi: int, block_rows: int) -> Iterator[tuple]:
    """Keys of a slice in order, read a block at a time."""
    with open(os.path.join(folder, name), "rb") as f:
        f.seek(lo * RECORD.itemsize)
        while lo < hi:
            n = min(block_rows, hi - lo)
            block = np.frombuffer(f.read(n * RECORD.itemsize), RECORD)
            yield from zip((-block["score"]).tolist(), *(block[c].tolist() for c in RECORD.names[1:]))
            lo += n


#: Files that one tournament holds open; more slices meet in several tournaments, whose winners meet in a last one.
FAN_IN = 256


def merged(parts: list[tuple[str, int, int]], folder: str, block_rows: int) -> Iterator[tuple]:
    sources = [run_slice(folder, *p, block_rows) for p in parts]
    if len(sources) <= FAN_IN:
        yield from Tournament(sources)
        return
    # a group's rows of this range stand in a file of their own before the groups meet
    path, bounds = os.path.join(folder, uuid.uuid4().hex), []
    try:
        with open(path, "wb") as f:
            for k in range(0, len(sources), FAN_IN):
                begin, rows = f.tell(), iter(Tournament(sources[k : k + FAN_IN]))
                while block := list(islice(rows, block_rows)):
                    out = np.array(block, RECORD)
                    out["score"] *= -1
                    f.write(out.tobytes())
                bounds.append((begin // RECORD.itemsize, f.tell() // RECORD.itemsize))
        yield from merged([(os.path.basename(path), *b) for b in bounds], folder, block_rows)
    finally:
        os.unlink(path)


RANKED = "score long, null_id long, doc_id long, n_features long, weight long, n_words long, row long, rank long"


def merge_ranges(parts: DataFrame, folder: str, draw: int, rules: ResampleRules) -> DataFrame:
    """parts: range, run, lo, hi, before (rows of earlier ranges). The drawn rows with their ranks."""

    def run(batches):
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        for _, group in groupby(rows, key=lambda r: r[0]):
            group = list(group)
            rank, out = group[0][4], []
            source = merged([(name, lo, hi) for _, name, lo, hi, _ in group], folder, rules.block_rows)
            for key in source:
                rank += 1
                out.append((-key[0], *key[1:], rank))
                if len(out) == 1 << 16 or rank == draw:
                    yield ranked(out)
                    out = []
                if rank == draw:
                    break
            if out:
                yield ranked(out)

    def ranked(out):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=[c.split()[0] for c in RANKED.split(", ")])

    near = parts.select("range", "run", "lo", "hi", "before").repartition("range").sortWithinPartitions("range", "run")
    return settle(near.mapInArrow(run, RANKED), "drawn")


def drawn(table: DataFrame, draw: int, eligible: int, rules: ResampleRules) -> DataFrame:
    """The draw highest rows of table (the fields of RECORD) with rank, by runs, splitters and merges."""
    spark = table.sparkSession
    uri = shared_folder(spark)
    folder = local_path(uri)
    step = max(rules.block_rows, -(-eligible // SPLIT_KEYS))
    manifest = write_runs(table, folder, step)
    keys = sorted(tuple(k) for r in manifest.select("keys").toLocalIterator() for k in r["keys"])
    splitters = keys[:: max(1, rules.range_rows // step)][1:]
    parts = slices(manifest, folder, splitters)
    before, first = 0, []
    for r in sorted(parts.groupBy("range").agg(F.sum(F.col("hi") - F.col("lo")).alias("n")).collect(), key=lambda r: r["range"]):
        if before < draw:
            first.append((r["range"], before))
        before += r["n"]
    starts = spark.createDataFrame(first, "range long, before long")  # a row for each range of the draw
    out = merge_ranges(parts.join(F.broadcast(starts), "range"), folder, draw, rules)
    discard(manifest, parts)
    remove(spark, uri)
    return out


def importance_resample(docs: DataFrame, target: DataFrame, rules: ResampleRules = ResampleRules()) -> DataFrame:
    """docs: doc_id, text; target: text. doc_id, n_words, n_features, weight, score, rank of each row of docs; rank is null where it isn't drawn."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    gains = bucket_gains(bucket_counts(docs, rules), bucket_counts(target, rules))
    rows = scored(docs, gains, rules).withColumn("row", F.monotonically_increasing_id())
    table = settle(rows, "scores")
    may = F.col("n_words") >= rules.least_words
    eligible = table.filter(may).count()
    draw = eligible * rules.percent // 100
    undrawn = table.withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    if draw == 0:
        return undrawn.select(*columns)
    null_id, known = F.col("doc_id").isNull().cast("byte"), F.coalesce("doc_id", F.lit(0).cast("long"))
    plain = {"null_id": null_id, "doc_id": known}
    ranks = drawn(table.filter(may).select(*[plain.get(c, F.col(c)).alias(c) for c in RECORD.names]), draw, eligible, rules)
    last = ranks.filter(F.col("rank") == draw).first()
    # what the merge left is told by the last drawn key, so the two halves need no join
    names = RECORD.names[1:]
    key = F.struct((-F.col("score")).alias("score"), *[plain.get(c, F.col(c)).cast("long").alias(c) for c in names])
    cut = F.struct(*[F.lit(x).cast("long").alias(c) for c, x in zip(RECORD.names, (-last["score"], *[last[c] for c in names]))])
    top = ranks.withColumn("doc_id", F.when(F.col("null_id") == 0, F.col("doc_id")))
    return top.select(*columns).unionByName(undrawn.filter(~may | (key > cut)).select(*columns))
