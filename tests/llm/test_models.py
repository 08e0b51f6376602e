"""Methods with a model or rounds of their own, against brute force on small tables with awkward rows."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest

from fathom.llm import ann, ngram_lm, suffix

WORD = r"[^\x20\x09-\x0D]+"


def lower(t):
    return (t or "").translate({k: k + 32 for k in range(65, 91)})


@pytest.fixture(scope="module")
def rows():
    """Null and repeated ids, null and empty texts, copies and near copies."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(2, 400))) for _ in range(6)]
    out = [(None, base[0]), (3, base[1]), (3, base[1]), (3, base[2]), (4, None), (5, ""), (None, None)]
    for i in range(6, 40):
        t = rng.choice(base)
        k = rng.randrange(len(t))
        out.append((i, t[:k] + rng.choice(["x", "", "\n", " 漢字 "]) + t[k + rng.randint(0, 3) :]))
    return out




@pytest.mark.parametrize("length", [100, 101, 30, 900])
def test_doubling_at_any_length(spark, rows, length):
    # texts that share an id are ordered by their hash, which only Spark has: one of them here
    rows = [r for r in rows if r != (3, rows[3][1])]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, start string, block int").repartition(3)
    distinct = sorted({((i is not None), i or 0, t) for i, t in rows if t is not None})
    first = {}
    for key in distinct:
        b = key[2].encode()
        for p in range(len(b) - length + 1):
            first.setdefault(b[p : p + length], (key, p))
    want = collections.Counter()
    for i, t in rows:
        key, b = (i is not None, i or 0, t), (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] != (key, p):
                gone[p : p + length] = b"\1" * length
        want[i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()] += 1
    got = collections.Counter(map(tuple, suffix.dedup_bytes(docs, length).collect()))
    assert got == want


def test_model_against_plain_counts(spark, rows):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string").repartition(3)
    training = [re.findall(WORD, lower(t)) + ["\0"] for i, t in rows if i is not None and i % 4]
    one = collections.Counter(w for t in training for w in t)
    two = collections.Counter(p for t in training for p in zip(t, t[1:]))
    three = collections.Counter(p for t in training for p in zip(t, t[1:], t[2:]))
    after1, after2 = collections.Counter(a for a, _ in two), collections.Counter(p[:2] for p in three)
    total, kinds = sum(one.values()), len(one)

    def discount(c):
        n = collections.Counter(c.values())
        return min(max(n[1] / (n[1] + 2 * n[2]), 0.05), 0.999)

    d2, d3 = discount(two), discount(three)

    def log10(t):
        out = 0.0
        for k, w in enumerate(t):
            p = (one[w] + 0.1) / (total + 0.1 * (kinds + 1))
            if k and one[t[k - 1]]:
                a = t[k - 1]
                p = max(two[a, w] - d2, 0) / one[a] + d2 * after1[a] / one[a] * p
                if k > 1 and two[t[k - 2], a]:
                    b = (t[k - 2], a)
                    p = max(three[*b, w] - d3, 0) / two[b] + d3 * after2[b] / two[b] * p
            out += math.log10(p)
        return out

    trie = ngram_lm.train(docs.filter("doc_id % 4 <> 0"))
    assert trie.nodes == len(three)
    texts = [*rows, (50, "unheard of words"), (51, (rows[0][1] + " new ") * 2)]
    got = ngram_lm.score(spark.createDataFrame(texts, "doc_id long, text string"), trie).collect()
    by = collections.defaultdict(list)
    for i, t in texts:
        by[i].append(log10(re.findall(WORD, lower(t)) + ["\0"]))
    for r in got:
        # quantised to 1 / 4096 of a power of ten, at most three values a token
        assert min(abs(r.score - x) for x in by[r.doc_id]) < 4e-4 * r.n_tokens + 1e-9


def test_long_documents_are_scored_in_pieces(spark, monkeypatch):
    text = " ".join(f"w{k * k % 91}" for k in range(500))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    trie = ngram_lm.train(docs)
    data, offs = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])
    m = ngram_lm.opened(trie)
    ids, n, _ = m.vocabulary.tokens(data, offs, 0, 1, 1)
    whole = m.probabilities(ids, n, np.array([0]))
    cut = np.concatenate([m.probabilities(ids[max(0, a - 2) : a + 7], n[max(0, a - 2) : a + 7], np.array([0]))[min(a, 2) :] for a in range(0, len(ids), 7)])
    assert np.allclose(whole, cut)


def test_repeated_query_ids_still_find_twenty(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(90, 6))
    rows = [(0 if k < 60 else k, [float(v) for v in r], "x") for k, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = ann.search(df, df.filter("vec_id % 20 = 0")).toPandas()
    assert (got[got.query_id == 0].vec_id != 0).all()
    assert sorted(got.groupby("query_id").size()) == [20, 20, 20]
    assert ann.search(df.limit(0), df).count() == 0
