"""Authorization guards that must hold where a statement runs, and the facts that AUTHZ-001 is judged by.

Statements: fn_id, stmt_id, kind (block, if, return, throw, other), branch
(then or else, of an if's own two statements), first and last place, guard
(the authorization call that is an if's bare condition, after one negation is
taken off; null for any other condition) and negated. Places nest, as a
parser gives them, and first places of a function's statements differ.

A guard is known to hold from the places, not by a walk of each tree: every
if yields the spans in which its condition is known, and a place lies in
them or not. A function of few statements is one row, in which they meet each
other; longer ones are joined statement by statement.

Null keys and places meet nothing; repeated statements count once; empty
tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .graph import object_access
from .intervals import crowded, inside

EXITS = ("return", "throw")
STATEMENT = ("fn_id", "stmt_id", "kind", "branch", "first", "last", "guard", "negated")
#: Ifs with a guard: the statement around them, and the places of their arms.
IFS = ("fn_id", "stmt_id", "guard", "negated", "last", "parent_kind", "parent_last", "then_first", "then_last", "exits", "else_first", "else_last")
#: Property names that tie a record to its owner, and values of the session. Fixed values.
OWNER_KEY = r"(?i)^(owner|user|tenant|organization|org|account|customer)(Id)?$|^createdBy$"
SESSION_VALUE = r"(?i)\b(session|currentUser|current_user|ctx\.user|req\.user|request\.user|auth\.user|authUser)\b"


def parents(statements: DataFrame) -> DataFrame:
    """(stmt_id, parent_id, parent_last, parent_kind): the innermost statement around each; the outermost have none."""
    own = statements.select("fn_id", F.col("stmt_id").alias("child_id"), F.col("first").alias("pos"), F.col("last").alias("child_last")).distinct()
    around = statements.select("fn_id", F.col("stmt_id").alias("parent_id"), "first", F.col("last").alias("parent_last"), F.col("kind").alias("parent_kind")).distinct()
    j = inside(own, around, ["fn_id"], last="parent_last").filter("parent_id <> child_id and first < pos and child_last <= parent_last")
    last = j.groupBy("child_id").agg(F.max_by(F.struct("parent_id", "parent_last", "parent_kind"), F.struct("first", "parent_id")).alias("p"))
    return last.select(F.col("child_id").alias("stmt_id"), "p.*")


def exiting(statements: DataFrame) -> DataFrame:
    """(stmt_id): statements that end in a return or throw on every way; statements have parent_id.

    Exits, blocks whose last statement is one of these, ifs of which both
    arms are. A round settles one more level of nesting and looks only at
    the parents of what the round before added, so rounds are as many as
    levels of statements that exit.
    """
    last = statements.filter("parent_id is not null").groupBy("parent_id").agg(F.max_by("stmt_id", "first").alias("last_id"))
    blocks = statements.filter("kind = 'block'").select(F.col("stmt_id").alias("parent_id")).join(last, "parent_id")
    arms = statements.filter("branch is not null").select("parent_id", "stmt_id", "branch")
    done = fresh = cut(statements.filter(F.col("kind").isin(*EXITS)).select("stmt_id").distinct())
    while True:
        of_block = blocks.join(fresh.withColumnRenamed("stmt_id", "last_id"), "last_id", "left_semi").select(F.col("parent_id").alias("stmt_id"))
        touched = arms.join(fresh, "stmt_id", "left_semi").select("parent_id").distinct()
        both = arms.join(touched, "parent_id", "left_semi").join(done, "stmt_id", "left_semi").groupBy("parent_id").agg(F.count_distinct("branch").alias("n"))
        of_if = both.filter("n = 2").select(F.col("parent_id").alias("stmt_id"))
        fresh = cut(of_block.unionByName(of_if).distinct().join(done, "stmt_id", "left_anti"))
        if fresh.isEmpty():
            return done
        done = cut(done.unionByName(fresh))


def guard_spans(statements: DataFrame) -> DataFrame:
    """(fn_id, guard, stmt_id, from_pos, to_pos): spans in which a guard is known to have been true.

    An if's then statement, its else statement if the condition is negated,
    and, after an if without else whose then statement returns or throws, the
    rest of the block around it if the condition is negated.
    """
    s = cut(statements.select(*STATEMENT))
    long = crowded(s, ["fn_id"])
    g = _short_ifs(s if long is None else s.join(long, "fn_id", "left_anti"))
    if long is not None:
        g = g.unionByName(_long_ifs(s.join(long, "fn_id", "left_semi")))
    negated = F.coalesce("negated", F.lit(False))
    span = lambda when, a, b: F.when(when, F.struct(F.col(a).cast("long").alias("from_pos"), F.col(b).cast("long").alias("to_pos")))
    g = g.withColumn("after", F.col("last") + 1)
    out = F.array_compact(
        F.array(
            span(~negated, "then_first", "then_last"),
            span(negated & F.col("else_first").isNotNull(), "else_first", "else_last"),
            span(negated & F.col("else_first").isNull() & F.coalesce("exits", F.lit(False)) & (F.col("parent_kind") == "block"), "after", "parent_last"),
        )
    )
    return cut(g.select("fn_id", "guard", "stmt_id", F.explode(out).alias("x")).select("fn_id", "guard", "stmt_id", "x.*"))


def _short_ifs(statements: DataFrame) -> DataFrame:
    """IFS of functions that are one row each: no statement leaves its row.

    Children begin after their parent, so a fold from the last place to the
    first knows of each statement's children whether they exit.
    """
    f = statements.groupBy("fn_id").agg(F.array_sort(F.collect_set(F.struct("first", *[c for c in STATEMENT if c not in ("fn_id", "first")]))).alias("s"))
    around = lambda x: F.filter("s", lambda y: (y["first"] < x["first"]) & (x["last"] <= y["last"]) & (y["stmt_id"] != x["stmt_id"]))
    f = f.select("fn_id", F.transform("s", lambda x: x.withField("p", F.array_max(F.transform(around(x), lambda y: F.struct(y["first"], y["stmt_id"], y["last"], y["kind"]))))).alias("s"))
    children = lambda x: F.filter("s", lambda c: c["p"]["stmt_id"] == x["stmt_id"])

    def ends(done: Column, x: Column) -> Column:
        last = F.array_max(F.transform(children(x), lambda c: F.struct(c["first"], c["stmt_id"])))["stmt_id"]
        arms = F.transform(F.filter(children(x), lambda c: c["branch"].isNotNull() & F.array_contains(done, c["stmt_id"])), lambda c: c["branch"])
        leaves = x["kind"].isin(*EXITS) | F.when(x["kind"] == "block", F.array_contains(done, last)) | (F.size(F.array_distinct(arms)) == 2)
        return F.when(F.coalesce(leaves, F.lit(False)), F.array_append(done, x["stmt_id"])).otherwise(done)

    id_type = statements.schema["stmt_id"].dataType.simpleString()
    f = f.select("fn_id", "s", F.aggregate(F.reverse("s"), F.array().cast(f"array<{id_type}>"), ends).alias("done"))
    arms = lambda x: F.filter(children(x), lambda c: c["branch"].isNotNull())
    ifs = F.filter("s", lambda x: (x["kind"] == "if") & x["guard"].isNotNull())
    g = f.select("fn_id", "done", F.explode(F.transform(ifs, lambda x: F.struct(x.alias("x"), arms(x).alias("arms")))).alias("g")).filter(F.size("g.arms") > 0)
    g = g.select("fn_id", "done", "g.x.*", "g.arms")
    of = lambda b, pick: F.array_max(F.transform(F.filter("arms", lambda c: c["branch"] == b), pick))
    return g.select(
        "fn_id", "stmt_id", "guard", "negated", "last", F.col("p.kind").alias("parent_kind"), F.col("p.last").alias("parent_last"),
        of("then", lambda c: c["first"]).alias("then_first"), of("then", lambda c: c["last"]).alias("then_last"), of("then", lambda c: F.array_contains("done", c["stmt_id"])).alias("exits"),
        of("else", lambda c: c["first"]).alias("else_first"), of("else", lambda c: c["last"]).alias("else_last"),
    )


def _long_ifs(statements: DataFrame) -> DataFrame:
    """IFS of functions of any length."""
    up = parents(statements)
    s = cut(statements.distinct().join(up, "stmt_id", "left"))
    arms = s.filter("branch is not null").join(exiting(s).withColumn("exits", F.lit(True)), "stmt_id", "left")
    of = lambda b, c: F.max(F.when(F.col("branch") == b, F.col(c)))
    arms = arms.groupBy(F.col("parent_id").alias("stmt_id")).agg(
        of("then", "first").alias("then_first"), of("then", "last").alias("then_last"), of("then", "exits").alias("exits"), of("else", "first").alias("else_first"), of("else", "last").alias("else_last")
    )
    return s.filter("kind = 'if' and guard is not null").join(arms, "stmt_id").select(*IFS)


def guards_at(points: DataFrame, spans: DataFrame) -> DataFrame:
    """points (point_id, fn_id, pos): (point_id, guard) for each guard that must hold there."""
    p = points.select("point_id", "fn_id", "pos").distinct()
    return inside(p, spans.select("fn_id", "guard", "from_pos", "to_pos"), ["fn_id"], first="from_pos", last="to_pos").select("point_id", "guard").distinct()


def guarded_calls(calls: DataFrame, uses: DataFrame, spans: DataFrame) -> DataFrame:
    """(call_id): look-ups under a guard, or one of whose result's returns or responses is, in the same function.

    calls: call_id, fn_id, pos, result (the variable that takes it, or null);
    uses: fn_id, name, pos, kind (return, response or other).
    """
    later = calls.filter("result is not null").select("call_id", "fn_id", F.col("result").alias("name")).join(uses.filter("kind in ('return', 'response')"), ["fn_id", "name"])
    points = calls.select(F.col("call_id").alias("point_id"), "fn_id", "pos").unionByName(later.select(F.col("call_id").alias("point_id"), "fn_id", "pos"))
    return guards_at(points, spans).select(F.col("point_id").alias("call_id")).distinct()


def responding_calls(calls: DataFrame, uses: DataFrame) -> DataFrame:
    """(call_id): look-ups whose result is returned or passed to a response, at once (calls.answered) or through their variable."""
    named = calls.filter("result is not null").select("call_id", "fn_id", F.col("result").alias("name")).join(uses.filter("kind in ('return', 'response')").select("fn_id", "name").distinct(), ["fn_id", "name"], "left_semi")
    return calls.filter("answered").select("call_id").unionByName(named.select("call_id")).distinct()


def parent_path(path: Column) -> Column:
    """The property path without its last name; '' for the outermost."""
    return F.regexp_replace(path, r"\.?[^.]*$", "")


def owner_leaves(leaves: DataFrame) -> DataFrame:
    """leaves (call_id, path, value, tainted): (call_id, path, owned) of tainted leaves.

    Owned: an owner property whose value's text is of the session is in the
    same object. One window over (call, object); nothing is joined.
    """
    key = F.regexp_extract("path", r"([^.]*)$", 1).rlike(OWNER_KEY)
    w = Window.partitionBy("call_id", "__object")
    own = leaves.withColumn("__object", parent_path(F.col("path"))).withColumn("owned", F.coalesce(F.max(key & F.col("value").rlike(SESSION_VALUE)).over(w), F.lit(False)))
    return own.filter("tainted").select("call_id", "path", "owned").distinct()


def unprotected_access(leaves: DataFrame, calls: DataFrame, uses: DataFrame, statements: DataFrame) -> DataFrame:
    """AUTHZ-001 from facts: look-ups with a tainted leaf that no owner property accompanies, under no guard before or after the fetch, whose result is answered."""
    bare = owner_leaves(leaves).filter("not owned").select("call_id").distinct()
    flows = calls.join(bare, "call_id", "left_semi").select("call_id", "model")
    none = flows.select("call_id").limit(0)
    return object_access(flows, none, guarded_calls(calls, uses, guard_spans(statements)), responding_calls(calls, uses))
