"""Taint over fact tables: a fold over each function's assignments for each level of calls, then rules with their exceptions as anti-joins.

Facts: assigns (fn_id, seq, target, source), calls (call_id, fn_id, seq, name,
argument, position, callee; a row an argument), seeds (fn_id, name), params
(fn_id, name, position). A variable is tainted from the assignment on; a call
passes taint to the parameter at the argument's position, at most ``depth``
calls deep.

Sources, arguments and seeds are property paths: where a.b is tainted, so are
a.b and a.b.c, but not a or a.d; an index keeps its parent (a[0] is a). A read
meets the tainted names by equality with each of its prefixes.

Taint only goes on to later places, so one pass over a function's assignments
in order finds all its tainted names. A function of few assignments is one row
for it; longer ones are followed by joins until nothing is new.

Null names and places meet nothing, repeated facts count once, cycles end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .intervals import crowded

#: Assignments of a longer function followed in one job, and jobs after which the written rounds are made one table.
STEPS, ROUNDS = 4, 8


def whole_path(path: Column) -> Column:
    return F.regexp_replace(path, r"\[[^\]]*\]", "")


def prefixes(path: Column) -> Column:
    """a, a.b, a.b.c of a.b.c."""
    parts = F.split(whole_path(path), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


def reads_of(rows: DataFrame, path: str) -> DataFrame:
    """rows with each prefix of a path as read."""
    return rows.filter(F.col(path).isNotNull()).withColumn("read", F.explode(prefixes(F.col(path))))


def _follow(now: DataFrame, reads: DataFrame) -> DataFrame:
    """now and, of each of its names, the targets assigned later, with the earliest place."""
    j = now.alias("t").join(reads.alias("s"), (F.col("t.fn_id") == F.col("s.fn_id")) & (F.col("t.name") == F.col("s.read")) & (F.col("t.since") < F.col("s.seq")), "left")
    fact = lambda name, since: F.struct(F.col("t.fn_id").alias("fn_id"), F.col(name).alias("name"), F.col(since).alias("since"))
    out = j.select(F.explode(F.array(fact("t.name", "t.since"), fact("s.target", "s.seq"))).alias("x")).select("x.*").filter("name is not null")
    return out.groupBy("fn_id", "name").agg(F.min("since").alias("since"))


def _folded(fresh: DataFrame, moves: DataFrame) -> DataFrame:
    """fresh and, of each of its names, the targets assigned later, and so on: moves (fn_id, moves), one row a function, in order of place."""
    start = fresh.groupBy("fn_id").agg(F.collect_list(F.struct("name", "since")).alias("start"))

    def step(known: Column, a: Column) -> Column:
        met = F.exists(known, lambda k: (k["since"] < a["seq"]) & ((a["source"] == k["name"]) | a["source"].startswith(F.concat(k["name"], F.lit(".")))))
        return F.when(met, F.array_append(known, F.struct(a["target"].alias("name"), a["seq"].alias("since")))).otherwise(known)

    known = F.when(F.col("moves").isNull(), F.col("start")).otherwise(F.aggregate("moves", F.col("start"), step))
    out = start.join(moves, "fn_id", "left").select("fn_id", F.explode(known).alias("x")).select("fn_id", "x.*")
    return out.groupBy("fn_id", "name").agg(F.min("since").alias("since"))


def _followed(fresh: DataFrame, reads: DataFrame) -> DataFrame:
    """As _folded, of functions of any length."""
    found = fresh = cut(fresh)
    rounds = 0
    while True:
        now = fresh
        for _ in range(STEPS):
            now = _follow(now, reads)
        fresh = cut(_earlier(now, found))
        if fresh.isEmpty():
            return found.groupBy("fn_id", "name").agg(F.min("since").alias("since"))
        found, rounds = found.unionByName(fresh), rounds + 1
        if rounds % ROUNDS == 0:
            found = cut(found.groupBy("fn_id", "name").agg(F.min("since").alias("since")))


def propagate(seeds: DataFrame, assigns: DataFrame, calls: DataFrame, params: DataFrame, depth: int = 4) -> DataFrame:
    """(fn_id, name, since, depth): tainted names, the place from which they are, and the calls it took.

    A name has a row for each depth at which it is tainted from an earlier
    place than at any lesser depth, so the least depth of a hit is right.
    """
    a = assigns.select("fn_id", F.col("seq").cast("long").alias("seq"), whole_path(F.col("target")).alias("target"), whole_path(F.col("source")).alias("source"))
    a = a.filter("fn_id is not null and target is not null and source is not null")
    long = crowded(a, ["fn_id"])
    few = a if long is None else a.join(long, "fn_id", "left_anti")
    moves = cut(few.groupBy("fn_id").agg(F.array_sort(F.collect_set(F.struct("seq", "target", "source"))).alias("moves")))
    reads = None if long is None else cut(reads_of(a.join(long, "fn_id", "left_semi"), "source").drop("source").distinct())
    passed = reads_of(calls.filter("callee is not null").select("fn_id", F.col("seq").cast("long").alias("seq"), "argument", "position", "callee"), "argument")
    bound = params.select(F.col("fn_id").alias("callee"), "position", whole_path(F.col("name")).alias("bound")).filter("bound is not null").distinct()
    # what a call passes doesn't change from level to level
    passed = cut(passed.join(bound, ["callee", "position"]).select("fn_id", "seq", F.col("read").alias("name"), "callee", "bound"))
    fresh = cut(seeds.select("fn_id", whole_path(F.col("name")).alias("name"), F.lit(-1).cast("long").alias("since")).filter("fn_id is not null and name is not null").distinct())
    tainted = None
    for level in range(depth + 1):
        if long is None:
            now = _folded(fresh, moves)
        else:
            now = _folded(fresh.join(long, "fn_id", "left_anti"), moves).unionByName(_followed(fresh.join(long, "fn_id", "left_semi"), reads))
        now = cut((now if tainted is None else _earlier(now, tainted)).withColumn("depth", F.lit(level)))
        tainted = now if tainted is None else tainted.unionByName(now)
        if level == depth:
            break
        into = passed.join(now, ["fn_id", "name"]).filter("since < seq").select(F.col("callee").alias("fn_id"), F.col("bound").alias("name"), F.lit(-1).cast("long").alias("since")).distinct()
        fresh = cut(_earlier(into, tainted))
        if fresh.isEmpty():
            break
    return tainted


def _earlier(now: DataFrame, tainted: DataFrame) -> DataFrame:
    """Rows of now that are new, or tainted from an earlier place than known."""
    known = tainted.groupBy("fn_id", "name").agg(F.min("since").alias("__known"))
    return now.join(known, ["fn_id", "name"], "left").filter("__known is null or since < __known").select("fn_id", "name", "since")


def sink_leaves(tainted: DataFrame, calls: DataFrame) -> DataFrame:
    """Tainted arguments: call_id, fn_id, sink, argument, position, and the least depth."""
    reads = reads_of(calls.select("call_id", "fn_id", "seq", F.col("name").alias("sink"), "argument", "position"), "argument")
    hit = reads.alias("c").join(tainted.alias("t"), (F.col("c.fn_id") == F.col("t.fn_id")) & (F.col("c.read") == F.col("t.name")) & (F.col("t.since") < F.col("c.seq")))
    return hit.groupBy("c.call_id", "c.fn_id", "c.sink", "c.argument", "c.position").agg(F.min("t.depth").alias("depth"))


def sink_findings(tainted: DataFrame, calls: DataFrame, rules: DataFrame, transforms: DataFrame, suppressions: DataFrame | None = None) -> DataFrame:
    """Sink calls with a tainted argument by rule, with the least depth: rules (rule, sink, severity), transforms (fn_id, name, sink) neutralise.

    suppressions: (rule, call_id).
    """
    clean = transforms.select("fn_id", F.col("name").alias("argument"), "sink")
    found = sink_leaves(tainted, calls).join(F.broadcast(rules), "sink").join(clean, ["fn_id", "argument", "sink"], "left_anti")
    if suppressions is not None:
        found = found.join(suppressions, ["rule", "call_id"], "left_anti")
    return found.groupBy("call_id", "rule", "severity").agg(F.min("depth").alias("depth"))
