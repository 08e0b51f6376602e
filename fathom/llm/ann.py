"""Approximate nearest neighbours in a hierarchical k-means tree, searched best bin first.

Largest inner product becomes least distance by one more component,
sqrt(M^2 - |x|^2) with M the largest norm (0 for queries). The tree is fitted
on a bounded sample; every row is assigned to a leaf. A query keeps a priority
queue of branches by distance and visits leaves in that order. How many leaves
is calibrated: for a bounded set of queries the true neighbours are found
against all rows in blocks, and visits widen until the leaves visited hold the
wanted share of them (all leaves, if need be).

Neighbouring leaves make bundles of a few thousand rows, large leaves are
split into parts. A query goes once to each bundle with a leaf that it visits,
with the set of those leaves, and meets the rows of those leaves only.
Bundles that many queries visit split these into parts, so identical
vectors don't meet in one task. Scores are exact double-precision inner
products of the original vectors: blocked products only choose which pairs are
worth one.

Defined cases: vectors that are null, zero or hold null or non-finite
components take no part, nor do those of another length than the most frequent
one; null ids take no part; rows that share a query's id aren't its
candidates, a repeated query id is asked once, with its least vector; ties go
to the smaller id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import settle
from .textkit import release


@dataclass(frozen=True)
class AnnRules:
    k: int = 20
    recall: float = 0.97
    #: Vectors that the tree is fitted on, about, and queries that visits are calibrated with.
    sample: int = 65_536
    calibrate: int = 256
    branch: int = 16
    leaf_sample: int = 14
    rounds: int = 8
    #: Rows of a bundle of leaves and of a part of a large one, queries of a part.
    rows_a_part: int = 4096
    queries_a_part: int = 4096
    seed: int = 7


class Tree:
    """Nodes in arrays: centre, children (first, count) or leaf number."""

    def __init__(self, x: np.ndarray, rules: AnnRules, leaf_rows: int):
        rng = np.random.default_rng(rules.seed)
        self.centres, self.first, self.size, self.leaf = [x.mean(axis=0) if len(x) else np.zeros(x.shape[1])], [0], [0], [-1]
        self.leaves = 0
        todo = [(0, x)]
        while todo:
            node, own = todo.pop()
            k = min(rules.branch, len(own) // max(1, leaf_rows))
            parts = _kmeans(own, k, rules.rounds, rng) if k > 1 else None
            if parts is None:
                self.leaf[node] = self.leaves
                self.leaves += 1
                continue
            self.first[node], self.size[node] = len(self.centres), len(parts)
            for centre, rows in parts:
                todo.append((len(self.centres), rows))
                self.centres.append(centre)
                self.first.append(0), self.size.append(0), self.leaf.append(-1)
        self.centres = np.array(self.centres)
        self.first, self.size, self.leaf = (np.array(a) for a in (self.first, self.size, self.leaf))

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Each row's leaf, by nearest centres downwards."""
        node = np.zeros(len(x), np.int64)
        live = np.arange(len(x)) if self.size[0] else np.zeros(0, int)
        while len(live):
            for n in np.unique(node[live]):
                own = live[node[live] == n]
                c = self.centres[self.first[n] : self.first[n] + self.size[n]]
                node[own] = self.first[n] + ((c * c).sum(axis=1) - 2 * np.einsum("xd,cd->xc", x[own], c)).argmin(axis=1)
            live = live[self.size[node[live]] > 0]
        return self.leaf[node]

    def visit(self, q: np.ndarray):
        """Leaves in best-bin-first order."""
        queue = [(0.0, 0)]
        while queue:
            _, n = heapq.heappop(queue)
            if not self.size[n]:
                yield int(self.leaf[n])
                continue
            a = self.first[n]
            far = ((self.centres[a : a + self.size[n]] - q) ** 2).sum(axis=1)
            for k, d in enumerate(far.tolist()):
                heapq.heappush(queue, (d, int(a + k)))


def _kmeans(x: np.ndarray, k: int, rounds: int, rng) -> list | None:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = ((centres * centres).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
        n = np.bincount(own, minlength=k)
        have = np.flatnonzero(n)
        sums = np.add.reduceat(x[np.argsort(own, kind="stable")], (np.cumsum(n) - n)[have])
        centres[have] = sums / n[have, None]
    own = ((centres * centres).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
    parts = [(centres[j], x[own == j]) for j in range(k) if (own == j).any()]
    return parts if len(parts) > 1 else None


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return np.asarray(col.flatten()).astype(np.float64).reshape(-1, dim)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, by score downwards, then id."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        own = np.flatnonzero(scores >= edge)
    else:
        own = np.arange(len(scores))
    return own[np.lexsort((ids[own], -scores[own]))[:k]]


def _block(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, near=None):
    """(query ids, ids, scores) of the best k for each query in a block of rows.

    near(a, b): approximate products of queries [a, b) and all rows, -inf for rows that don't count; by default all do.
    """
    out = []
    size = np.abs(x).sum(axis=1).max(initial=0.0)
    for a in range(0, len(q), 128):
        b = min(a + 128, len(q))
        products = q[a:b] @ x.T if near is None else near(a, b)
        products[q_ids[a:b, None] == ids[None, :]] = -np.inf
        for r, row in enumerate(products):
            edge = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -np.inf
            # a blocked product may round otherwise than the exact one
            slack = 1e-12 * size * np.abs(q[a + r]).max(initial=0.0)
            own = np.flatnonzero((row >= edge - slack) & (row > -np.inf))
            # equal vectors must score equal to the last bit
            score = np.einsum("xd,d->x", x[own], q[a + r])
            best = _best(score, ids[own], k)
            out.append((np.full(len(best), q_ids[a + r]), ids[own][best], score[best]))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]


FOUND = "query_id long, vec_id long, score double"


def _found(parts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(parts[0].astype(np.int64)), pa.array(parts[1].astype(np.int64)), pa.array(parts[2])], names=["query_id", "vec_id", "score"])


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(vectors: DataFrame, queries: DataFrame, rules: AnnRules = AnnRules(), vec: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for queries (vec_id, vec) against vectors (vec_id, vec)."""
    spark = vectors.sparkSession
    def clean(df: DataFrame) -> DataFrame:
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vec).cast("array<double>").alias("v")).filter(sound)

    sound = F.expr("vec_id is not null and v is not null and not coalesce(exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')), true) and exists(v, x -> x <> 0)")
    rows = clean(vectors)
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(F.expr("aggregate(v, 0D, (a, x) -> a + x * x)")).alias("m")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n, most = int(sizes[0]["dim"]), int(sizes[0]["n"]), float(sizes[0]["m"])
    rows = rows.filter(F.size("v") == dim)
    # rows that share an id: a query's own aren't its candidates
    most_rows = int(rows.groupBy("vec_id").count().agg(F.max("count")).first()[0])
    asked = clean(queries).filter(F.size("v") == dim).groupBy("vec_id").agg(F.min("v").alias("v"))

    def lifted(x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(0, most - (x * x).sum(axis=1)))[:, None]], axis=1)

    def hashed(salt: str):
        return F.xxhash64(F.lit(salt), "vec_id").bitwiseAND(F.lit((1 << 30) - 1)) / F.lit(float(1 << 30))

    share = min(1.0, rules.sample / n)
    sample = rows.filter(hashed("fit") < share).orderBy("vec_id").limit(2 * rules.sample).select("v").toArrow()
    x = lifted(_matrix(sample.column("v").combine_chunks(), dim))
    tree = Tree(x, rules, rules.leaf_sample)
    shared = spark.sparkContext.broadcast(tree)  # bounded by the sample

    def place(batches):
        for batch in batches:
            leaf = shared.value.assign(lifted(_matrix(batch.column(1), dim))) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), *batch.columns], names=["leaf", "vec_id", "v"])

    placed = settle(rows.select("vec_id", "v").mapInArrow(place, "leaf int, vec_id long, v array<double>"), "placed")
    counts = {r["leaf"]: r["n"] for r in placed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # a row per leaf
    n_asked = max(1, asked.count())
    trial = asked.filter(hashed("trial") < min(1.0, rules.calibrate / n_asked)).orderBy(hashed("trial"), "vec_id").limit(2 * rules.calibrate).toPandas()
    visits = _calibrated(placed, trial, tree, counts, dim, rules)

    # leaves in the tree's order, so that those of a bundle are near each other
    bundle = np.zeros(tree.leaves, np.int64)
    first, rows_in = [], []
    for leaf in range(tree.leaves):
        if not first or rows_in[-1] + counts.get(leaf, 0) > rules.rows_a_part:
            first.append(leaf), rows_in.append(0)
        bundle[leaf] = len(first) - 1
        rows_in[-1] += counts.get(leaf, 0)
    full = np.array([counts.get(x, 0) for x in range(tree.leaves)])

    def route(batches):
        t = shared.value
        for batch in batches:
            ids, q = batch.column(0).to_numpy(), _matrix(batch.column(1), dim)
            at, own, leaves = [], [], []
            for r in range(len(q)):
                seen, held, taken = [], 0, 0
                for x in t.visit(np.append(q[r], 0.0)):
                    if full[x]:
                        seen.append(x)
                        held += full[x]
                    taken += 1
                    if taken >= visits and held >= rules.k + most_rows:
                        break
                seen = np.sort(np.array(seen, np.int64))
                for b in np.unique(bundle[seen]):
                    at.append(b), own.append(r)
                    leaves.append((seen[bundle[seen] == b] - first[b]).astype("<u4").tobytes())
            take = pa.array(own, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(ids).take(take), batch.column(1).take(take), pa.array(leaves, pa.binary())], names=["bundle", "vec_id", "v", "leaves"])

    tasks = max(1, min(spark.sparkContext.defaultParallelism * 2, -(-n_asked // 64)))
    routed = settle(asked.select("vec_id", "v").repartition(tasks, "vec_id").mapInArrow(route, "bundle int, vec_id long, v array<double>, leaves binary"), "routed")
    asks = {r["bundle"]: r["n"] for r in routed.groupBy("bundle").agg(F.count("*").alias("n")).collect()}  # a row per bundle
    parts = [(b, -(-rows_in[b] // rules.rows_a_part), -(-asks[b] // rules.queries_a_part)) for b in sorted(asks)]
    parts = F.broadcast(spark.createDataFrame(parts, "bundle int, rp int, qp int"))  # a row per bundle
    of_leaf = F.broadcast(spark.createDataFrame([(x, int(bundle[x]), int(x - first[bundle[x]])) for x in range(tree.leaves)], "leaf int, bundle int, local int"))  # a row per leaf
    left = routed.join(parts, "bundle").select("bundle", F.explode(F.sequence(F.lit(0), F.col("rp") - 1)).alias("r"), F.pmod(F.xxhash64("vec_id"), "qp").cast("int").alias("q"), "vec_id", "v", "leaves")
    right = placed.join(of_leaf, "leaf").join(parts, "bundle").select(F.col("bundle").alias("bundle2"), F.pmod(F.xxhash64("vec_id"), "rp").cast("int").alias("r2"), F.explode(F.sequence(F.lit(0), F.col("qp") - 1)).alias("q2"), F.col("vec_id").alias("id2"), F.col("v").alias("v2"), "local")

    def scan(q: pa.Table, x: pa.Table) -> pa.Table:
        q, x = q.combine_chunks(), x.combine_chunks()
        if not len(q) or not len(x):
            return pa.Table.from_batches([_found([np.zeros(0), np.zeros(0), np.zeros(0)])])
        qs, xs = (_matrix(t.column(c).combine_chunks(), dim) for t, c in ((q, "v"), (x, "v2")))
        local = x.column("local").to_numpy()
        order = np.argsort(local, kind="stable")
        xs, local = xs[order], local[order]
        sets = [np.frombuffer(b, "<u4") for b in q.column("leaves").to_pylist()]

        def near(a: int, b: int) -> np.ndarray:
            out = np.full((b - a, len(xs)), -np.inf)
            leaf = np.concatenate(sets[a:b])
            row = np.repeat(np.arange(b - a), [len(s) for s in sets[a:b]])[np.argsort(leaf, kind="stable")]
            leaf, at = np.unique(leaf, return_index=False, return_counts=True)
            lo, hi, end = np.searchsorted(local, leaf, "left"), np.searchsorted(local, leaf, "right"), np.cumsum(at)
            for i, j, c, n in zip(lo.tolist(), hi.tolist(), end.tolist(), at.tolist()):
                if i < j:
                    own = row[c - n : c]
                    out[own, i:j] = qs[a:b][own] @ xs[i:j].T
            return out

        out = _block(qs, q.column("vec_id").to_numpy(), xs, x.column("id2").to_numpy()[order], rules.k, near)
        release()
        return pa.Table.from_batches([_found(out)])

    found = left.groupBy("bundle", "r", "q").cogroup(right.groupBy("bundle2", "r2", "q2")).applyInArrow(scan, FOUND)
    return _top(found, rules.k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def exact(placed: DataFrame, queries, dim: int, k: int) -> DataFrame:
    """Exact neighbours of a bounded set of queries (pandas: vec_id, v) against all rows, in blocks."""
    q = np.array(queries["v"].tolist(), np.float64).reshape(-1, dim)
    ids = queries["vec_id"].to_numpy(np.int64)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield _found(_block(q, ids, _matrix(batch.column(1), dim), batch.column(0).to_numpy(), k))

    return _top(placed.select("vec_id", "v").mapInArrow(run, FOUND), k)


def _calibrated(placed: DataFrame, trial, tree: Tree, counts: dict, dim: int, rules: AnnRules) -> int:
    """Leaves to visit so that those hold the wanted share of the trial queries' true neighbours."""
    if not len(trial):
        return 1
    true = exact(placed, trial, dim, rules.k)
    leaf = true.join(placed.select("vec_id", "leaf"), "vec_id").select("query_id", "leaf").toPandas()
    vectors = dict(zip(trial["vec_id"], trial["v"]))
    rank_at = np.zeros(tree.leaves + 1, np.int64)
    for query, own in leaf.groupby("query_id"):
        order = {x: r for r, x in enumerate(tree.visit(np.append(np.asarray(vectors[query], np.float64), 0.0)), 1)}
        np.add.at(rank_at, [order[x] for x in own["leaf"]], 1)
    total = rank_at.sum()
    reached = np.cumsum(rank_at)
    return max(1, int(np.searchsorted(reached, np.ceil(rules.recall * total)))) if total else 1
