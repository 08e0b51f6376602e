"""The library's own operators on small literal tables and against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fathom.functions import scalars
from fathom.operators import admission, correlate, readmodel, routes, scoring, store, web
from fathom.schema import CONFIDENCES, SEVERITIES

FINDING = "finding_id string, category string, symbol string, severity string, confidence string, source string, file_path string, line_start int, line_end int, status string, first_seen timestamp_ntz"


def finding(k, **kw):
    base = dict(finding_id=f"f{k:03d}", category="c", symbol=None, severity="medium", confidence="medium", source="static_analysis", file_path="a.ts", line_start=10, line_end=None, status="open", first_seen=dt.datetime(2026, 8, 31))
    base.update(kw)
    return tuple(base.values())


def groups(spark, rows):
    return correlate.correlate(spark.createDataFrame(rows, FINDING)).collect()


@pytest.mark.parametrize(
    "rows, n",
    [
        ([dict()], 1),
        ([dict(line_start=10), dict(line_start=11, source="ai_review")], 1),
        ([dict(line_start=10), dict(line_start=500)], 2),
        ([dict(), dict(file_path="b.ts")], 2),
        ([dict(line_start=10), dict(line_start=12), dict(line_start=14)], 1),
        ([dict(line_start=10), dict(line_start=13)], 2),
        ([dict(line_start=1, line_end=50), dict(line_start=3, line_end=4), dict(line_start=52)], 1),
        ([dict(file_path=None, line_start=None, symbol="s"), dict(file_path=None, line_start=None, symbol="s")], 1),
        ([dict(file_path="", line_start=3, symbol="s"), dict(file_path=None, line_start=None, symbol="s")], 1),
        ([dict(), dict(line_start=None)], 2),
    ],
)
def test_groups(spark, rows, n):
    assert len(groups(spark, [finding(k, **r) for k, r in enumerate(rows)])) == n


def test_merge(spark):
    (g,) = groups(spark, [finding(0), finding(1, source="dynamic_validation", severity="critical", line_start=11)])
    assert (g.finding_id, g.severity, g.confidence, g.detected_by, g.n_evidence) == ("f001", "critical", "high", "dynamic_validation,static_analysis", 2)
    (g,) = groups(spark, [finding(0, confidence="confirmed"), finding(1, source="ai_review")])
    assert g.confidence == "confirmed"


def test_islands_are_components(spark):
    rng = random.Random(1)
    spans = [(f"f{rng.randrange(5)}", a := rng.randrange(400), a + rng.randrange(6)) for _ in range(250)]
    root = list(range(len(spans)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (f, a, b) in enumerate(spans):
        for j in range(i):
            g, c, e = spans[j]
            if f == g and a <= e + 2 and c <= b + 2:
                root[top(i)] = top(j)
    got = groups(spark, [finding(k, file_path=f, line_start=a, line_end=b) for k, (f, a, b) in enumerate(spans)])
    assert len(got) == len({top(x) for x in range(len(spans))})


@pytest.mark.parametrize(
    "rows, score",
    [
        ([dict(status="fixed")], 100),
        ([dict(severity="critical", confidence="confirmed")], 80),
        ([dict()], 97),
        ([dict(severity="high", confidence="confirmed", first_seen=dt.datetime(2026, 7, 2))], 85),
        ([dict(severity="high", confidence="confirmed", first_seen=dt.datetime(2026, 8, 16))], 88),
        ([dict(severity="critical", confidence="confirmed")] * 50, 0),
    ],
)
def test_score(spark, rows, score):
    df = spark.createDataFrame([finding(k, **r) for k, r in enumerate(rows)], FINDING)
    assert scoring.security_score(df, [], F.lit(dt.datetime(2026, 8, 31))).first().score == score


def test_routes(spark):
    r = spark.createDataFrame([(0, "GET", "/users/{id}"), (1, "GET", "/users/me"), (2, "GET", "/orgs/{orgId}/users/{userId}"), (3, "*", "/health"), (4, "GET", "/users/{userId}"), (5, "GET", "/search/{q}")], "route_idx int, method string, pattern string")
    q = spark.createDataFrame([(1, "GET", "/users/123"), (2, "get", "/Users/me"), (3, "GET", "/search/hello%20world"), (4, "GET", "/search/100%"), (5, "GET", "/users/123/posts"), (6, "POST", "/health"), (7, "GET", "/users/1?x=2"), (8, "GET", "/search/a+b")], "req_id int, method string, path string")
    got = {x.req_id: (x.route_idx, x.params, x.ambiguous_with) for x in routes.best_matches(q, r).collect()}
    assert got == {1: (0, "id=123", 1), 2: (1, "", 0), 3: (5, "q=hello world", 0), 4: (5, "q=100%", 0), 6: (3, "", 0), 7: (0, "id=1", 1), 8: (5, "q=a+b", 0)}


def test_rate_limit(spark):
    rng = random.Random(2)
    rows = [(k % 3, k, k * 90 + rng.randrange(50)) for k in range(200)]
    got = {(x.run_id, x.seq): x.admitted for x in admission.rate_limit(spark.createDataFrame(rows, "run_id long, seq long, ts_ms long"), 40, 3).collect()}
    for run in range(3):
        kept = []
        for r, k, t in rows:
            if r == run:
                ok = len(kept) < 40 and sum(x > t - 1000 for x in kept) < 3
                assert got[r, k] == ok
                kept += [t] * ok


def test_budget_prefix_stops(spark):
    f = spark.createDataFrame([("k", 1, 50, False), ("k", 2, 60, True), ("k", 3, 10, False)], "key string, seq int, size long, is_binary boolean")
    assert [x.seq for x in admission.budget_prefix(f, ["key"], [F.col("seq")], 100).collect()] == [1]


def test_upsert_keeps_triage(spark):
    schema = "id int, status string, severity string"
    old, new = spark.createDataFrame([(1, "fixed", "low"), (2, "open", "low")], schema), spark.createDataFrame([(1, "open", "high"), (3, "open", "info")], schema)
    assert {tuple(x) for x in store.upsert(old, new, ["id"], ["severity"]).collect()} == {(1, "fixed", "high"), (2, "open", "low"), (3, "open", "info")}


def test_crawl(spark):
    e = spark.createDataFrame([("/", "/a"), ("/a", "/b"), ("/b", "/c"), ("/b", "/")], "src string, dst string")
    got = {x.page: x.depth for x in web.crawl(e, spark.createDataFrame([("/",)], "page string")).collect()}
    assert got == {"/": 0, "/a": 1, "/b": 2}


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.mask_secret(F.lit("AKIA1234567890")), scalars.mask_secret(F.lit("short")), scalars.slugify(F.lit(" A & B! ")), scalars.slugify(F.lit("!!")), scalars.redact_url(F.lit("https://u:p@h/x")),
        scalars.blocked_ipv4(F.lit("172.31.0.1")), scalars.blocked_ipv4(F.lit("8.8.8.8")), scalars.blocked_ipv4(F.lit("999.1.1.1")), scalars.format_duration(F.lit(1500)),
    ).first()
    assert list(row) == ["AKI********890", "[redacted]", "a-b", "org", "https://h/x", True, False, True, "1.5s"]
    assert [readmodel.clamp_limit(x) for x in (None, float("nan"), 0, 7.9, 1000)] == [25, 25, 1, 7, 100]
    assert SEVERITIES[-1] == "critical" and CONFIDENCES[-1] == "confirmed"


def test_stream_dedup(spark, tmp_path):
    from fathom.streaming import events

    spark.createDataFrame([(1, dt.datetime(2026, 1, 1)), (1, dt.datetime(2026, 1, 1, 1)), (2, dt.datetime(2026, 1, 1))], "delivery_id long, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("delivery_id long, ts timestamp").parquet(str(tmp_path / "in"))
    q = events.deduplicate(stream).writeStream.format("memory").queryName("dedup").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("dedup").count() == 2


def test_entry_without_training_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['fathom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'correlate' in e.queries() and 'pipeline' not in e.queries()"
    import os

    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__)))).returncode == 0


def test_findings_are_dealt_once(spark):
    rows = [(f"f{k}", "a.ts" if k % 2 else None, k, k, "c", "low", "low", ("ast_pattern", "web_security")[k % 3 == 0]) for k in range(8)]
    f = spark.createDataFrame(rows, "finding_id string, file_path string, line_start int, line_end int, category string, severity string, confidence string, source string")
    out = correlate.correlate(f)
    # by file for those with a line, by group for the rest; an island's findings stay where its file is
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    assert sorted(x.n_evidence for x in out.collect()) == [4, 4]


def test_merge_keeps_the_evidence_and_the_draft(spark):
    kind = "finding_id string, file_path string, line_start int, line_end int, category string, severity string, confidence string, source string, title string, evidence array<struct<source:string, scanner:string, detail:string>>"
    e = lambda *names: [(n, n[0], "{}") for n in names]
    rows = [
        ("f3", "a.ts", 11, None, "x", "low", "low", "static_analysis", "third", e("s3")),
        ("f1", "a.ts", 12, 13, "y", "low", "low", "static_analysis", "first", e("s1", "a0")),
        ("f2", "a.ts", 10, 10, "z", "high", "low", "ai_review", "second", e("a2")),
        ("f0", "a.ts", 10, 10, "w", "low", "low", "other", "unranked", None),
        ("g1", None, None, None, "d", "low", "low", "code_intelligence", "free", e("c1")),
        ("g0", None, None, None, "d", "low", "low", "ai_review", "best", e("a1")),
    ]
    for data in (rows, rows[::-1]):
        got = {x.finding_id: x for x in correlate.correlate(spark.createDataFrame(data, kind)).collect()}
        assert sorted(got) == ["f1", "g0"]
        a, c = got["f1"], got["g0"]
        assert (a.title, a.category, a.source, a.line_start, a.line_end, a.first_line, a.last_line) == ("first", "y", "static_analysis", 12, 13, 10, 13)
        assert (a.severity, a.confidence, a.sources, a.n_evidence) == ("high", "medium", ["other", "static_analysis", "ai_review"], 4)
        assert [x.source for x in a.evidence] == ["s1", "a0", "a2", "s3"] and [x.scanner for x in a.evidence] == ["s", "a", "a", "s"]
        assert (c.title, c.sources, [x.source for x in c.evidence]) == ("best", ["ai_review", "code_intelligence"], ["a1", "c1"])


def test_a_finding_is_evidence_where_none_is_given(spark):
    (g,) = groups(spark, [finding(1, source="ai_review", symbol="s"), finding(0)])
    assert [tuple(x) for x in g.evidence] == [("f000", "static_analysis", "c", 10, None, None), ("f001", "ai_review", "c", 10, None, None)]
    assert (g.sources, g.symbol, g.n_evidence) == (["static_analysis", "ai_review"], None, 2)
