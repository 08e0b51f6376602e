"""Intervals, guards, owner leaves and taint against plain Python on random facts."""

import random

import pytest
from pyspark.sql import functions as F

from fathom.operators import dominance, guard, intervals, taint

STATEMENT = "fn_id long, stmt_id long, kind string, branch string, first int, last int, guard string, negated boolean"


def test_cells_make_up_the_interval(spark):
    rng = random.Random(3)
    rows = [(k, a := rng.choice([0, 7, 8, 63, 64, rng.randrange(5000)]), a + rng.choice([-1, 0, 1, 7, 8, 511, rng.randrange(4000)])) for k in range(200)]
    rows.append((200, 0, 2**31 - 1))
    df = spark.createDataFrame(rows, "k int, first int, last int")
    for r in df.filter("first <= last").select("*", intervals.cells(F.col("first"), F.col("last")).alias("c")).collect():
        spans = sorted((x.cell * 8**x.level, (x.cell + 1) * 8**x.level) for x in r.c)
        assert spans[0][0] == r.first and spans[-1][1] == r.last + 1
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    pts = spark.createDataFrame([(p, "f") for p in range(0, 9000, 37)] + [(None, "f")], "pos int, fn_id string")
    got = {(x.k, x.pos) for x in intervals.inside(pts, df.withColumn("fn_id", F.lit("f")), ["fn_id"]).collect()}
    assert got == {(k, p) for k, a, b in rows for p in range(0, 9000, 37) if a <= p <= b}


def tree(rng, fn):
    """Random nested statements as rows, and (place, guards that hold there) by a walk."""
    rows, points, ids = [], [], iter(range(fn * 10_000, (fn + 1) * 10_000))
    place = iter(range(0, 100_000, 3))

    def exits(body):
        return bool(body) and body[-1]

    def block(depth, known, branch=None):
        """A block's own statements; true if it ends in an exit on every way."""
        id_, first, ends, known = next(ids), next(place), [], set(known)
        points.append((first + 1, frozenset(known)))
        for _ in range(rng.randrange(0, 4)):
            kind = rng.choice(["if", "if", "other", "return", "throw"] if depth else ["other", "return"])
            if kind != "if":
                a = next(place)
                points.append((a, frozenset(known)))
                rows.append((fn, next(ids), kind, None, a, a + 1, None, None))
                ends.append(kind in ("return", "throw"))
                continue
            me, a = next(ids), next(place)
            call, negated = rng.choice([None, "g1", "g2", "g3"]), rng.random() < 0.5
            then = block(depth - 1, known | ({call} if call and not negated else set()), "then")
            other = block(depth - 1, known | ({call} if call and negated else set()), "else") if rng.random() < 0.4 else None
            z = next(place)
            rows.append((fn, me, "if", None, a, z, call, negated))
            ends.append(bool(then and other))
            if call and negated and then and other is None:
                known.add(call)
        z = next(place)
        points.append((z, frozenset(known)))
        rows.append((fn, id_, "block", branch, first, z, None, None))
        return exits(ends)

    block(4, set())
    return rows, points


def test_guards_hold_as_a_walk_finds_them(spark):
    rng = random.Random(11)
    rows, points = [], []
    for fn in range(60):
        r, p = tree(rng, fn)
        rows += r
        points += [(fn * 100_000 + k, fn, pos, g) for k, (pos, g) in enumerate(p)]
    st = spark.createDataFrame(rows + rows[:20], STATEMENT)
    pts = spark.createDataFrame([x[:3] for x in points], "point_id long, fn_id long, pos int")
    got = {}
    for x in dominance.guards_at(pts, dominance.guard_spans(st)).collect():
        got.setdefault(x.point_id, set()).add(x.guard)
    assert got == {k: set(g) for k, _, _, g in points if g}


def test_long_functions_as_short_ones(spark, monkeypatch):
    rows, points = [], []
    for fn in range(8):
        r, p = tree(random.Random(fn), fn)
        rows += r
        points += [(fn * 100_000 + k, fn, pos) for k, (pos, _) in enumerate(p)]
    st, pts = spark.createDataFrame(rows, STATEMENT), spark.createDataFrame(points, "point_id long, fn_id long, pos int")
    got = []
    for few in (1 << 30, 0):
        monkeypatch.setattr(intervals, "FEW", few)
        got.append({tuple(x) for x in dominance.guards_at(pts, dominance.guard_spans(st)).collect()})
    assert got[0] and got[0] == got[1]


def test_points_of_short_functions_are_not_copied(spark):
    pts = spark.createDataFrame([(p, p % 9) for p in range(90)], "pos int, fn_id int")
    spans = spark.createDataFrame([(k, 10 * k, 10 * k + 40) for k in range(9)], "fn_id int, first int, last int")
    met = intervals.inside(pts, spans, ["fn_id"])
    assert "Generate" not in met._jdf.queryExecution().toString()
    assert {(x.fn_id, x.pos) for x in met.collect()} == {(p % 9, p) for p in range(90) if 10 * (p % 9) <= p <= 10 * (p % 9) + 40}


def test_no_statements(spark):
    st, pts = spark.createDataFrame([], STATEMENT), spark.createDataFrame([(1, 1, 5)], "point_id long, fn_id long, pos int")
    assert dominance.guards_at(pts, dominance.guard_spans(st)).collect() == []


def test_owner_leaves(spark):
    rows = [
        (1, "where.id", "id", True), (1, "where.ownerId", "req.user.id", False),
        (2, "where.id", "id", True), (2, "data.ownerId", "req.user.id", False),
        (3, "id", "id", True), (3, "createdby", "session", False),
        (4, "id", "id", True), (4, "userId", "id", True),
        (5, "id", None, True), (None, "id", "id", True), (6, "a.user", "currentUser", True),
    ]
    got = {(x.call_id, x.path): x.owned for x in dominance.owner_leaves(spark.createDataFrame(rows, "call_id int, path string, value string, tainted boolean")).collect()}
    assert got == {(1, "where.id"): True, (2, "where.id"): False, (3, "id"): True, (4, "id"): False, (4, "userId"): False, (5, "id"): False, (None, "id"): False, (6, "a.user"): True}


def test_guard_after_fetch_and_response(spark):
    st = spark.createDataFrame(
        [(1, 1, "block", None, 0, 100, None, None), (1, 2, "if", None, 20, 40, "can", True), (1, 3, "return", "then", 25, 30, None, None)], STATEMENT
    )
    calls = spark.createDataFrame([(1, 1, 10, "x", False), (2, 1, 11, "y", False), (3, 1, 12, None, True), (4, 1, 50, None, False)], "call_id int, fn_id long, pos int, result string, answered boolean")
    uses = spark.createDataFrame([(1, "x", 60, "return"), (1, "y", 15, "response"), (1, "x", 61, "other"), (2, "y", 60, "return")], "fn_id long, name string, pos int, kind string")
    assert {x.call_id for x in dominance.guarded_calls(calls, uses, dominance.guard_spans(st)).collect()} == {1, 4}
    assert {x.call_id for x in dominance.responding_calls(calls, uses).collect()} == {1, 2, 3}


def test_argument_binds_by_position(spark):
    seeds = spark.createDataFrame([(1, "id")], "fn_id int, name string")
    none = spark.createDataFrame([], "fn_id int, seq int, target string, source string")
    calls = spark.createDataFrame([(1, 1, 1, "helper", "id", 0, 2), (2, 2, 1, "query", "b", 0, None), (3, 2, 2, "query", "a", 0, None)], "call_id int, fn_id int, seq int, name string, argument string, position int, callee int")
    params = spark.createDataFrame([(2, "a", 0), (2, "b", 1)], "fn_id int, name string, position int")
    assert {x.call_id for x in taint.sink_leaves(taint.propagate(seeds, none, calls, params), calls).filter("sink = 'query'").collect()} == {3}


def test_taint_paths_and_earlier_places(spark):
    seeds = spark.createDataFrame([(1, "req.body"), (1, "s")], "fn_id int, name string")
    # late is tainted at 9 by one step and at 3 by two: the earlier place counts
    assigns = spark.createDataFrame([(1, 9, "late", "s"), (1, 2, "mid", "s"), (1, 3, "late", "mid"), (1, 4, "a", "req.body.x[0].y"), (1, 4, "b", "req"), (1, 4, "c", "req.query"), (1, 1, "p", "q"), (1, 2, "q", "p"), (1, 3, None, "s"), (1, 5, "n", None)], "fn_id int, seq int, target string, source string")
    calls = spark.createDataFrame([(k, 1, 5, "query", n, 0, None) for k, n in enumerate(["late", "a", "b", "c", "a.z", "p", None, "req.bodyguard"])], "call_id int, fn_id int, seq int, name string, argument string, position int, callee int")
    params = spark.createDataFrame([], "fn_id int, name string, position int")
    got = taint.sink_leaves(taint.propagate(seeds, assigns, calls, params), calls).collect()
    assert {x.argument for x in got} == {"late", "a", "a.z"}


def test_taint_of_long_functions_as_of_short_ones(spark, monkeypatch):
    rng = random.Random(5)
    name = lambda: rng.choice("abcd") + rng.choice(["", "", ".p", "[0]", ".p.q"])
    seeds = spark.createDataFrame([(f, "a") for f in range(0, 12, 3)], "fn_id int, name string")
    assigns = spark.createDataFrame([(f, rng.randrange(9), name(), name()) for f in range(12) for _ in range(8)], "fn_id int, seq int, target string, source string")
    calls = spark.createDataFrame([(k, k % 12, rng.randrange(9), "f", name(), k % 2, rng.randrange(12)) for k in range(60)], "call_id int, fn_id int, seq int, name string, argument string, position int, callee int")
    params = spark.createDataFrame([(f, rng.choice("abcd"), k) for f in range(12) for k in range(2)], "fn_id int, name string, position int")
    cuts, cut = [0], taint.cut

    def counted(df):
        cuts[-1] += 1
        return cut(df)

    monkeypatch.setattr(taint, "cut", counted)
    got = []
    for few in (1 << 30, 0):
        monkeypatch.setattr(intervals, "FEW", few)
        got.append({tuple(x) for x in taint.propagate(seeds, assigns, calls, params).collect()})
        cuts.append(0)
    assert len({x[3] for x in got[0]}) > 2 and got[0] == got[1]
    # short functions take two written tables a level, however far their assignments go
    assert cuts[0] <= 3 + 2 * 5


@pytest.mark.parametrize(
    "path, out",
    [("/p/../admin", "/admin"), ("/p/%2e%2E/admin", "/admin"), ("/p/.%2e/admin/.", "/admin/"), ("/../..", "/"), ("/a/./b/", "/a/b/"), ("", "/"), ("/a//b/..", "/a//"), ("/a/..b/%2ec", "/a/..b/%2ec")],
)
def test_resolved_path(spark, path, out):
    assert spark.createDataFrame([(path,)], "p string").select(guard.resolved_path(F.col("p"))).first()[0] == out


@pytest.mark.parametrize("url, out", [(" https://a.io\\p\\..\\q?x\\y ", "https://a.io/p/../q?x\\y"), ("https://a.io/\tx\n", "https://a.io/x"), ("https://a.io#\\", "https://a.io#\\"), (None, None)])
def test_browser_url(spark, url, out):
    assert spark.createDataFrame([(url,)], "u string").select(guard.browser_url(F.col("u"))).first()[0] == out
