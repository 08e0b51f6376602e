"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong
to), so the flow network has a node per pattern and per source whatever the
number of documents. Arcs from the origin to a pattern carry its words once
per repetition at convex costs (0, 1, 3, ...), arcs from a pattern lead to its
sources, arcs from a source to the drain carry its target. The cheapest
largest flow tells how many words of each pattern go to each source; documents
then fill those amounts in a seeded order, found with sums over hash ranges
rather than one long ordered scan.

Defined cases: a null text has size 0 and takes nothing; a null source is a
source of its own, last in order; with no words all targets are 0.
A repeated or null doc_id has one place in the seeded order, where its rows go
by their texts; an empty table gives no rows. Columns of the results' names
are replaced, others of any name are carried as they are.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import apart, column, settle, together

#: Words are runs outside space, tab and the controls to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
#: Hash ranges that a pattern's documents are dealt to.
RANGES = 1 << 12


@dataclass(frozen=True)
class MixRules:
    share: float = 1.5
    most: int = 2
    weights: tuple = WEIGHTS
    seed: str = "mix"


def word_count(text):
    """Words of a text column: starts of runs, counted without building them."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def water_fill(total: float, weights: list[float], caps: list[float]) -> list[float]:
    """total shared by weight, none above its cap, the excess reshared by weight."""
    total = min(float(total), float(sum(caps)))
    level, spent, mass = 0.0, 0.0, float(sum(weights))
    for i in sorted(range(len(caps)), key=lambda i: (caps[i] / weights[i], i)):
        level = (total - spent) / mass
        if caps[i] / weights[i] > level:
            break
        spent += caps[i]
        mass -= weights[i]
    else:
        return [float(c) for c in caps]
    return [min(float(c), w * level) for c, w in zip(caps, weights)]


class Flow:
    """Min-cost flow by successive shortest paths with potentials; costs start non-negative."""

    def __init__(self, n: int):
        self.out: list[list[list]] = [[] for _ in range(n)]

    def arc(self, a: int, b: int, room: int, cost: int) -> list:
        there, back = [b, room, cost, None], [a, 0, -cost, None]
        there[3], back[3] = back, there
        self.out[a].append(there)
        self.out[b].append(back)
        return there

    def run(self, s: int, t: int) -> tuple[int, int]:
        n = len(self.out)
        high, moved, spent = [0] * n, 0, 0
        while True:
            dist, via = [None] * n, [None] * n
            dist[s] = 0
            heap = [(0, s)]
            while heap:
                d, a = heapq.heappop(heap)
                if d > dist[a]:
                    continue
                for arc in self.out[a]:
                    b, room, cost, _ = arc
                    if room > 0 and (dist[b] is None or d + cost + high[a] - high[b] < dist[b]):
                        dist[b] = d + cost + high[a] - high[b]
                        via[b] = arc
                        heapq.heappush(heap, (dist[b], b))
            if dist[t] is None:
                return moved, spent
            far = max(d for d in dist if d is not None)
            for v in range(n):
                high[v] += dist[v] if dist[v] is not None else far
            push, v = None, t
            while v != s:
                push = via[v][1] if push is None else min(push, via[v][1])
                v = via[v][3][0]
            v = t
            while v != s:
                via[v][1] -= push
                via[v][3][1] += push
                spent += push * via[v][2]
                v = via[v][3][0]
            moved += push


def solve(patterns: dict, targets: dict, most: int) -> dict:
    """Words of each pattern for each source; patterns: members -> words, targets: source -> words."""
    names, keys = list(targets), list(patterns)
    flow, s, t = Flow(2 + len(keys) + len(names)), 0, 1
    where = {name: 2 + len(keys) + k for k, name in enumerate(names)}
    for name in names:
        flow.arc(where[name], t, math.floor(targets[name] + 0.5), 0)
    arcs = {}
    for k, key in enumerate(keys):
        for again in range(most):
            flow.arc(s, 2 + k, int(patterns[key]), again * (again + 1) // 2)
        for name in key:
            arcs[key, name] = flow.arc(2 + k, where[name], most * int(patterns[key]), 0)
    flow.run(s, t)
    return {x: arc[3][1] for x, arc in arcs.items()}


def mix_sources(docs: DataFrame, rules: MixRules = MixRules(), text: str = "text", members: str | None = None) -> DataFrame:
    """docs' columns with size, source_size, target and taken.

    members: a column of arrays of sources, if documents belong to several;
    else the column source. source_size and target then are sums over a
    document's sources. The driver holds a row per pattern.
    """
    spark = docs.sparkSession
    pattern = F.array(F.col("source")) if members is None else F.array_sort(F.array_distinct(F.col(members)))
    own = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    base = apart(docs.select(*[column(c) for c in own]), "doc_id", text, members or "source").withColumn("__p", pattern).withColumn("__key", F.to_json(F.struct("__p"))).withColumn("size", word_count(F.col(text)))
    base = base.withColumn("__h", F.md5(F.concat_ws("|", F.lit(rules.seed), F.col("doc_id").cast("string"))))
    base = base.withColumn("__r", F.conv(F.substring("__h", 1, 3), 16, 10).cast("int"))
    sums = settle(base.groupBy("__key", "__r").agg(F.first("__p").alias("p"), F.sum("size").alias("n")), "ranges")
    totals = sums.groupBy("__key").agg(F.first("p").alias("p"), F.sum("n").alias("n")).collect()
    key_of = {c["__key"]: tuple(c["p"] or ()) for c in totals}
    patterns = {key_of[c["__key"]]: c["n"] for c in totals}
    sizes: dict = {}
    for key, n in patterns.items():
        for name in key:
            sizes[name] = sizes.get(name, 0) + n
    names = sorted(sizes, key=lambda x: (x is None, x if x is not None else ""))
    weights = [rules.weights[k % len(rules.weights)] for k in range(len(names))]
    total = rules.share * sum(patterns.values())
    filled = water_fill(total, weights, [rules.most * sizes[x] for x in names])
    targets = dict(zip(names, filled))
    routed = solve(patterns, targets, rules.most)
    rows = []
    for text_key, key in key_of.items():
        amount = sum(routed.get((key, name), 0) for name in key)
        rounds = min(rules.most, amount // patterns[key]) if patterns[key] else 0
        rows.append((text_key, int(rounds), int(amount - rounds * patterns[key]), int(sum(sizes[x] for x in key)), float(sum(targets[x] for x in key))))
    plan = spark.createDataFrame(rows, "__key string, __rounds int, __rest long, source_size long, target double")
    along = Window.partitionBy("__key").orderBy("__r").rowsBetween(Window.unboundedPreceding, 0)
    cells = sums.join(plan, "__key").withColumn("__left", F.col("__rest") - F.sum("n").over(along) + F.col("n"))
    # 0: not in the last round, 1: wholly, 2: the range that the rest ends in
    state = F.when(F.col("n") <= F.col("__left"), 1).when(F.col("__left") > 0, 2).otherwise(0)
    cells = cells.select("__key", "__r", "__rounds", "__left", "source_size", "target", state.alias("__state"))
    # RANGES rows a pattern at most: broadcast only where that is small
    joined = base.join(F.broadcast(cells) if len(rows) * RANGES <= 1 << 18 else cells, ["__key", "__r"])
    order = Window.partitionBy("__key", "__r").orderBy("__h", "doc_id", F.xxhash64(text)).rowsBetween(Window.unboundedPreceding, 0)
    edge = joined.filter("__state = 2")
    # a document counts if the rest ends past its middle, so that the sum comes nearest
    edge = edge.withColumn("__extra", F.when(2 * F.sum("size").over(order) - F.col("size") <= 2 * F.col("__left"), 1).otherwise(0))
    rest = joined.filter("__state <> 2").withColumn("__extra", F.col("__state"))
    out = edge.unionByName(rest).withColumn("taken", (F.col("size") * (F.col("__rounds") + F.col("__extra"))).cast("long"))
    return together(out, [*own, "size", "source_size", "target", "taken"])
