"""Lines shorter than the full threshold asks are judged too."""

import random

import numpy as np

from fathom.llm import lines


def test_short_lines(spark):
    rng = random.Random(9)
    pool = ["".join(rng.choice("abc ") for _ in range(rng.randint(1, 24))) for _ in range(60)]
    pool += [x[:k] + "b" + x[k + 1 :] for x in pool if len(x) > 9 for k in (3, 8)] + ["", " ", "x", "xy"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(6))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kinds = list(dict.fromkeys(x for _, t in rows for x in t.split("\n") if x.strip() or len(x) >= 20))
    root = {x: x for x in kinds}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    points = {x: np.frombuffer(x.encode("utf-32-le"), "<u4") for x in kinds}
    for k, x in enumerate(kinds):
        for y in kinds[k + 1 :]:
            t = min(2, min(len(x), len(y)) // 10)
            if t and lines._distance(points[x], points[y]) <= t:
                root[top(y)] = top(x)
    first = {}
    for i, t in rows:
        for k, x in enumerate(t.split("\n")):
            if x in root:
                first.setdefault(top(x), (i, k))
    got = {r.doc_id: r.text for r in lines.dedup_lines(docs).collect()}
    for i, t in rows:
        assert got[i] == "\n".join(x for k, x in enumerate(t.split("\n")) if x not in root or first[top(x)] == (i, k))
