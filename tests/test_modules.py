"""Imports, re-exports, argument bindings and DNS providers, with expectations written out and plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from fathom.operators import modules, providers

FILES = ["a/b.ts", "a/b.js", "a/c/index.tsx", "a/c.d.ts", "a/d/index.js", "e.jsx", "a/x.json", "a/y.tsx", "index.ts", "src/f.ts", "a/h.js", "a/c/k.ts"]


@pytest.mark.parametrize(
    "path, specifier, target",
    [
        ("a/m.ts", "./b", "a/b.ts"),
        ("a/m.ts", "./b.js", "a/b.ts"),
        ("a/m.ts", "./h.js", "a/h.js"),
        ("a/m.ts", "./b.ts", "a/b.ts"),
        ("a/m.ts", "./c", "a/c.d.ts"),
        ("a/m.ts", "./c/", "a/c/index.tsx"),
        ("a/c/k.ts", ".", "a/c/index.tsx"),
        ("a/c/q/k.ts", "..", "a/c/index.tsx"),
        ("a/c/k.ts", "../d", "a/d/index.js"),
        ("a/c/k.ts", "./../../e", "e.jsx"),
        ("a/m.ts", "./y.jsx", "a/y.tsx"),
        ("a/m.ts", "./x.json", "a/x.json"),
        ("a/m.ts", "./x", None),
        ("a/m.ts", "../../e", None),
        ("a/m.ts", "react", None),
        ("a/m.ts", ".b", None),
        ("a/m.ts", "a/b", None),
        ("m.ts", "./src//f", "src/f.ts"),
    ],
)
def test_one_import(spark, path, specifier, target):
    files = spark.createDataFrame([(f,) for f in [*FILES, None, "a/b.ts"]], "path string")
    got = modules.resolve_imports(spark.createDataFrame([(path, 1, specifier)], "file_path string, line int, specifier string"), files).collect()
    assert [r.target for r in got] == [target]


def test_import_edges_are_once_by_first_line(spark):
    files = spark.createDataFrame([("a/b.ts",)], "path string")
    rows = [("m.ts", 4, "./a/b"), ("m.ts", 2, "./a/b.js"), ("m.ts", 2, "./a/b.js"), ("m.ts", 5, "z"), ("n.ts", 1, "z"), (None, 1, "z"), ("m.ts", 1, None)]
    r = modules.resolve_imports(spark.createDataFrame(rows, "file_path string, line int, specifier string"), files)
    got = sorted((e.id, e.specifier) for e in modules.import_edges(r).collect())
    assert got == [
        ("IMPORTS:file:m.ts:m.ts:0=>external_module:~:z", "z"),
        ("IMPORTS:file:m.ts:m.ts:0=>file:a/b.ts:a/b.ts:0", "./a/b.js"),
        ("IMPORTS:file:n.ts:n.ts:0=>external_module:~:z", "z"),
    ]
    assert [n.id for n in modules.external_modules(r).collect()] == ["external_module:~:z"]
    assert modules.resolve_imports(r.limit(0).select("file_path", "line", "specifier"), files.limit(0)).count() == 0


def walk(own, via, at):
    seen = set()
    while at not in own:
        if at in seen:
            return (None, None, "cycle")
        seen.add(at)
        if at not in via:
            return (None, None, "missing")
        at = min(via[at])
    return (*at, "declared")


def exports(spark, own, via):
    d = spark.createDataFrame(list(own) * 2, "module string, name string")
    return d, spark.createDataFrame([(*k, *t) for k, ts in via.items() for t in ts], "module string, name string, to_module string, to_name string")


def test_reexports_match_a_walk(spark):
    rng = random.Random(5)
    own = {(f"m{k}", "x") for k in range(6)}
    via = {(f"m{k}", "x"): [(f"m{rng.randrange(60)}", rng.choice("xxxxy")) for _ in range(rng.choice((1, 1, 2)))] for k in range(4, 50)}
    via |= {(f"c{k}", "z"): [(f"c{k + 1}", "z")] for k in range(70)}
    via |= {(f"r{k}", "z"): [(f"r{(k + 1) % 5}", "z")] for k in range(5)} | {("tail", "z"): [("r0", "z")], ("self", "z"): [("self", "z")]}
    own |= {("c70", "z")}
    got = {(r.module, r.name): (r.at_module, r.at_name, r.state) for r in modules.declared_at(*exports(spark, own, via)).collect()}
    assert got == {k: walk(own, via, k) for k in own | set(via)}
    assert {s for _, _, s in got.values()} == {"declared", "missing", "cycle"}


def test_no_exports(spark):
    d, v = exports(spark, {("a", "b")}, {("a", "b"): [("c", "d")]})
    assert modules.declared_at(d.limit(0), v.limit(0)).count() == 0


def test_arguments_meet_parameters_by_position(spark):
    exported = modules.declared_at(*exports(spark, {("lib.ts", "run"), ("m.ts", "own")}, {("index.ts", "go"): [("lib.ts", "run")]}))
    b = spark.createDataFrame([("m.ts", "f", "index.ts", "go"), ("m.ts", "own2", None, "own")], "file_path string, local string, target string, name string")
    p = spark.createDataFrame([("lib.ts", "run", 0, "a"), ("lib.ts", "run", 1, "b"), ("m.ts", "own", 0, "q")], "module string, function string, position int, parameter string")
    c = spark.createDataFrame([(1, "m.ts", "f", 1, "id"), (1, "m.ts", "f", 2, "rest"), (2, "m.ts", "own", 0, "v"), (3, "m.ts", "own2", 0, "v"), (4, "m.ts", "nope", 0, "v"), (5, "n.ts", "f", 0, "v")], "call_id int, file_path string, callee string, position int, argument string")
    got = sorted(map(tuple, modules.bind_arguments(c, b, exported, p).collect()))
    assert got == [(1, 1, "id", "lib.ts", "run", "b"), (2, 0, "v", "m.ts", "own", "q")]


@pytest.mark.parametrize(
    "value, provider",
    [
        ("ada.NS.CloudFlare.com", "Cloudflare"),
        ("cloudflare.com", None),
        (".cloudflare.com", "Cloudflare"),
        ("evilcloudflare.com", None),
        ("ns-7.awsdns-12.co.uk", "AWS Route 53"),
        ("awsdns-12.com", None),
        ("x.awsdns-#.com", None),
        ("x.awsdns-.com", None),
        ("x.y-3.awsdns-4.net", "AWS Route 53"),
        ("a.ns.porkbun.com", "Porkbun"),
        ("ns.porkbun.com", None),
        ("ns.name.com.", None),
        ("a.dnſimple.com", None),
        ("", None),
        (None, None),
    ],
)
def test_nameserver(spark, value, provider):
    x = spark.createDataFrame([(value,)], "v string").select(providers.provider_of(F.col("v"), providers.NAMESERVERS).alias("p"))
    assert x.first().p == provider


def test_detect(spark):
    host = spark.createDataFrame([("app.x.com",), ("y.com",), ("z.com",), ("w.v.x.com",), ("app.x.com",), (None,)], "host string")
    record = "name string, position int, value string"
    ns = spark.createDataFrame([("x.com", 1, "a.dynect.net"), ("w.v.x.com", 2, "q.hostgator.com"), ("w.v.x.com", 1, "unknown.org"), ("y.com", 1, "no.org"), (None, 1, "a.name.com"), ("z.com", 1, None)], record)
    cn = spark.createDataFrame([("app.x.com", 2, "b.fly.dev"), ("app.x.com", 1, "Netlify.APP")], record)
    ad = spark.createDataFrame([("y.com", "185.199.110.153"), ("y.com", "1.1.1.1"), ("app.x.com", "185.199.108.153")], "name string, value string")
    got = {r.host: tuple(r)[1:] for r in providers.detect(host, ns, cn, ad).collect()}
    assert got == {
        "app.x.com": (True, "Oracle Dyn", "Netlify.APP", "Netlify"),
        "y.com": (True, None, None, "GitHub Pages"),
        "z.com": (False, None, None, None),
        "w.v.x.com": (True, "HostGator", None, None),
    }


def test_edges_are_gathered_before_ids_are_made(spark):
    rows = [("a.ts", 3, "x", None), ("a.ts", 1, "x", None), ("a.ts", 2, "./b", "b.ts"), ("a.ts", 1, "./b.js", "b.ts")]
    e = modules.import_edges(spark.createDataFrame(rows, "file_path string, line int, specifier string, target string"))
    assert sorted((x.to_id, x.specifier) for x in e.collect()) == [("external_module:~:x", "x"), ("file:b.ts:b.ts:0", "./b.js")]
    plan = e._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(file_path" in plan and "hashpartitioning(from_id" not in plan


def test_files_are_not_broadcast(spark, tmp_path):
    # a stored file whose size says nothing of its stems: short numbers give long paths
    spark.range(20000).write.parquet(str(tmp_path / "files"))
    files = spark.read.parquet(str(tmp_path / "files")).selectExpr("'a/' || repeat('long/', 40) || 'm' || id || '/index.ts' AS path")
    imports = spark.range(300).selectExpr("'a/m.ts' AS file_path", "cast(id AS int) AS line", "'./' || repeat('long/', 40) || 'm' || id * 100 AS specifier")
    r = modules.resolve_imports(imports, files)
    assert r.filter("target is not null").count() == 200
    assert "Broadcast" not in r._jdf.queryExecution().executedPlan().toString()
    r.collect()
    assert "Broadcast" not in r._jdf.queryExecution().executedPlan().toString()
