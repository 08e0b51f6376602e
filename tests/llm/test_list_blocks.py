"""Blocks of a list meet in the list's row: no pair of different components is missed, and blocks aren't joined by list."""

from fathom.llm import jaccard


def test_blocks_of_a_list(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LIST_BLOCK", 4)
    rows = [(1, k, k, 5, True, k % 3 if k < 20 else 7) for k in range(40)] + [(2, k, k, 5, True, k) for k in range(3)]
    made = jaccard.block_pairs(spark.createDataFrame(rows, "list long, k long, class long, n long, small boolean, comp long"))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1
    got = set()
    for r in made.collect():
        cut = sum(not x.second for x in r.e)
        for a in range(cut):
            for b in range(cut if cut < len(r.e) else a + 1, len(r.e)):
                got.add((r.list, *sorted((r.e[a].k, r.e[b].k))))
    want = {(x[0], x[1], y[1]) for x in rows for y in rows if x[0] == y[0] and x[1] < y[1] and x[5] != y[5]}
    assert want <= got
    # members of component 7 fill blocks of their own, which don't meet
    assert (1, 30, 39) not in got
