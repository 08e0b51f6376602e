"""Components of few edges take one written table and one step; those of more go by star steps to the same result."""

import random

import numpy as np
import pytest

from fathom.llm import components as C


def plain(edges):
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    return {x: find(x) for x in linked}


def graph():
    rnd = random.Random(5)
    chain = [(k, k + 1) for k in range(-300, 300)]
    star = [(5000, 1000 + k) for k in range(200)]
    loose = [(rnd.randrange(10_000, 10_400), rnd.randrange(10_000, 10_400)) for _ in range(250)]
    out = [*chain, *star, *loose, (7, 7), (99_999, 99_999), (2**62, -(2**62))]
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize("at_once", [C.TASK_EDGES, 0])
def test_components(spark, monkeypatch, at_once):
    monkeypatch.setattr(C, "TASK_EDGES", at_once)
    edges = graph()
    got = [(r.node, r.component) for r in C.components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()]
    assert len(got) == len(dict(got)) and dict(got) == plain(edges)
    assert C.components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_few_edges_take_few_jobs(spark):
    """Each star round cost the driver a dozen jobs with their broadcasts and compiled stages, however few the edges."""
    edges = spark.createDataFrame(graph(), "a long, b long")
    sc = spark.sparkContext
    sc.setJobGroup("components", "components of few edges")
    try:
        C.components(edges).collect()
        assert len(sc.statusTracker().getJobIdsForGroup("components")) <= 4
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_least_reachable():
    rnd = np.random.default_rng(3)
    for n in (1, 10, 300):
        a, b = rnd.integers(-50, 50, (2, n))
        node, least = C.least_reachable(a, b)
        want = plain(zip(a.tolist(), b.tolist())) | {}
        assert {x: y for x, y in zip(node.tolist(), least.tolist()) if x in want} == want
