"""Operators without an SQL form against brute force on small, awkward tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from fathom.llm import ann, bpe, jaccard, langid, lines, mixing, ngram_lm, quality, simple8b, suffix
from fathom.llm.eliasfano import EliasFano
from fathom.llm.queries import tokenizer

WORD = r"[^\x20\x09-\x0D]+"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, n double"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(200)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [text(rng.randint(3, 150)) for _ in range(25)]
    out = []
    for i in range(120):
        t = rng.choice(base)
        if rng.random() < 0.5:
            k = rng.randrange(len(t))
            t = t[:k] + rng.choice(["x", "", "\n", " 漢字 "]) + t[k + rng.randint(0, 3) :]
        out.append((i, t))
    out += [(200, None), (201, ""), (202, " \n\t"), (203, "a"), (204, "1234 $$$"), (205, "ab " * 5000), (206, "z" * 20000), (207, text(6000)), (208, base[0]), (209, base[0])]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    full = [(i, t, None if i % 9 == 0 else "en", None if i % 10 == 0 else f"s{i % 3}", None, 1, 0.5, 0.1) for i, t in rows]
    return spark.createDataFrame(full, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words_of(t):
    return re.findall(WORD, t or "")


def lower(t):
    return (t or "").translate({k: k + 32 for k in range(65, 91)})


def test_quality(docs, rows, empty):
    got = {r.doc_id: r for r in quality.compression_quality(docs).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        w = words_of(t)
        seen, dup = set(), 0
        for line in (t or "").split("\n"):
            if words_of(line):
                dup += line in seen
                seen.add(line)
        count = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {k + x for k in range(len(w) - 7) if count[tuple(w[k : k + 8])] > 1 for x in range(8)}
        base = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), dup, len(covered), base)
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", t or ""))
        assert not (r.base_failed and r.kept)
    assert quality.compression_quality(empty).count() == 0


def test_suffix(docs, rows, empty):
    first = {}
    raw = sorted((i, (t or "").encode()) for i, t in rows)
    for i, b in raw:
        for p in range(len(b) - 99):
            first.setdefault(b[p : p + 100], (i, p))
    got = {r.doc_id: r for r in suffix.dedup_bytes(docs).collect()}
    for i, b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if first[b[p : p + 100]] != (i, p):
                gone[p : p + 100] = b"\1" * 100
        runs = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    assert suffix.dedup_bytes(empty).count() == 0


def test_jaccard(docs, rows, empty):
    sets = {}
    for i, t in rows:
        w = words_of(lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    least = {i: i for i in sets}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                least[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    assert got == {i: (len(sets[i]), root(i)) for i in ids}
    kept = {r.doc_id for r in jaccard.one_of_each_group(docs).collect()}
    assert kept == {i for i in ids if root(i) == i}
    assert jaccard.jaccard_components(empty).count() == 0


def test_language_model(docs, rows, empty):
    trie = ngram_lm.train(docs.filter("doc_id % 4 <> 0"))
    got = {r.doc_id: r for r in ngram_lm.score(docs, trie).collect()}
    tokens = {i: words_of(lower(t)) + ["\0"] for i, t in rows}
    count = collections.Counter(w for i, t in tokens.items() if i % 4 for w in t)
    total = sum(count.values())
    for i, t in tokens.items():
        base = sum(math.log10((count[w] + 0.1) / (total + 0.1 * (len(count) + 1))) for w in t)
        r = got[i]
        assert (r.n_tokens, r.n_known) == (len(t), sum(count[w] > 0 for w in t))
        assert abs(r.base_score - base) < 1e-6 * abs(base) + 1e-9
        assert r.score < 0
    assert sum(r.score for r in got.values()) > sum(r.base_score for r in got.values())
    none = ngram_lm.train(empty)
    assert all(r.n_known == 0 for r in ngram_lm.score(docs, none).collect())


def test_successor_search():
    rng = np.random.default_rng(1)
    for top in (3, 1000, 1 << 40):
        v = np.unique(rng.integers(0, top, 5000).astype(np.uint64))
        e = EliasFano(EliasFano.build(v, "x"), "x")
        assert (e.get(np.arange(len(v))) == v).all()
        probe = np.concatenate([v, rng.integers(0, 2 * top, 3000).astype(np.uint64)])
        place = {x: k for k, x in enumerate(v.tolist())}
        assert e.find(probe).tolist() == [place.get(x, -1) for x in probe.tolist()]


def test_mixing(docs, rows, empty):
    got = {r.doc_id: r for r in mixing.mix_sources(docs).collect()}
    again = {r.doc_id: r for r in mixing.mix_sources(docs).collect()}
    assert {i: r.taken for i, r in got.items()} == {i: r.taken for i, r in again.items()}
    by = collections.defaultdict(list)
    for i, t in rows:
        assert got[i]["size"] == len(words_of(t)) and got[i].taken <= 2 * got[i]["size"]
        by[got[i].source].append(got[i])
    for own in by.values():
        assert sum(r["size"] for r in own) == own[0].source_size
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r["size"] for r in own)
    assert mixing.mix_sources(empty).count() == 0


def test_overlapping_sources():
    flow = mixing.solve({("a",): 10, ("a", "b"): 10, ("b",): 10}, {"a": 30.0, "b": 15.0}, 2)
    assert flow[("a",), "a"] + flow[("a", "b"), "a"] == 30 and flow[("a", "b"), "b"] + flow[("b",), "b"] == 15
    assert mixing.water_fill(30, [3, 1, 2], [10, 20, 8]) == [10.0, 12.0, 8.0]


def test_language(docs, rows, empty):
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    for i, t in rows:
        letters = t is not None and any(c.isalpha() for c in t)
        assert got[i].lang_pred == ("en" if letters else "und") and 0 <= got[i]["score"] <= 1
    assert all(r.lang_pred == "und" for r in langid.predict(docs, langid.fit(empty)).collect())


def test_lines(docs, rows, empty):
    rng = random.Random(5)
    for t in (1, 2, 3):
        a, b = [], []
        for _ in range(300):
            x = [rng.choice("abc") for _ in range(rng.randint(5, 50))]
            y = list(x)
            for _ in range(rng.randint(0, 5)):
                y[rng.randrange(len(y)) :][:1] = rng.choice([[], ["a"], ["b", "c"]])
                y.insert(rng.randrange(len(y) + 1), rng.choice("abc")) if rng.random() < 0.5 else y.pop()
                y = y or ["a"]
            a.append(np.array([ord(c) for c in x], np.uint32))
            b.append(np.array([ord(c) for c in y], np.uint32))
        assert lines.edits_within(a, b, t).tolist() == [lines._distance(x, y) <= t for x, y in zip(a, b)]
    judged = [(i, k, x) for i, t in sorted(rows, key=lambda r: r[0]) for k, x in enumerate((t or "").split("\n")) if len(x) >= 20]
    distinct = list(dict.fromkeys(x for *_, x in judged))
    root = {x: x for x in distinct}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    point = {x: np.frombuffer(x.encode("utf-32-le"), "<u4") for x in distinct}
    for k, x in enumerate(distinct):
        for y in distinct[k + 1 :]:
            if abs(len(x) - len(y)) <= 2 and len(x) < 5000 and lines.edits_within([point[x]], [point[y]], 2)[0]:
                root[top(y)] = top(x)
    first = {}
    for i, k, x in judged:
        first.setdefault(top(x), (i, k))
    got = {r.doc_id: r.text for r in lines.dedup_lines(docs).collect()}
    for i, t in rows:
        want = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if len(x) < 20 or first[top(x)] == (i, k))
        assert got[i] == want
    assert lines.dedup_lines(empty).count() == 0


def test_token_files(docs, rows, empty):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in simple8b.token_file_digest(docs, path).collect()}
    start = 0
    for i, t in sorted(rows, key=lambda r: r[0]):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert simple8b.token_file_digest(empty, path).count() == 0
    rng = np.random.default_rng(2)
    for n in (0, 1, 59, 1024, 1025, 5000):
        for high in (1, 300, 1 << 40, (1 << 64) - 1):
            x = rng.integers(0, high, n, dtype=np.uint64, endpoint=True)
            assert (simple8b.decode(*simple8b.encode(x), n) == x).all()


def test_bpe(docs, rows, empty):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    lib, own = Tokenizer.from_file(path), bpe.WordBpe(path)
    rng = random.Random(8)
    for t in ["".join(rng.choice("abcde  ÀéΣσ漢'sİ12\t\x1c\x85!☃<|>") for _ in range(40)) for _ in range(400)] + ["<|endoftext|>x <|startoftext|>", "a" * 3000]:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids and own.decode(ids) == lib.decode(ids, skip_special_tokens=False)
    got = {r.doc_id: r for r in bpe.encode_documents(docs, path).collect()}
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_documents(empty, path).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 8)).round(2)
    x[100:300] = x[100]  # a third are one vector
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(700, None), (701, [0.0] * 8), (702, [1.0, None] * 4), (703, [float("nan")] * 8), (704, [1.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, df.filter("vec_id % 20 = 0")).toPandas()
    hit = 0
    for q in range(0, 600, 20):
        s = np.einsum("xd,d->x", x, x[q])
        s[q] = -np.inf
        want = np.lexsort((np.arange(600), -s))[:20]
        own = got[got.query_id == q].sort_values("rank")
        assert list(own["rank"]) == list(range(1, 21))
        hit += len(set(own.vec_id) & set(want))
    assert hit >= 0.9 * 600
    assert ann.search(df.filter("vec_id > 9000"), df).count() == 0
    few = df.filter("vec_id in (0, 1, 2)")
    assert ann.search(few, few).count() == 6
