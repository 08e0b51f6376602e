import random
import re
import zlib
from collections import Counter

import pytest

from fathom.llm import spelling
from fathom.llm.spelling import SpellingRules


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    p = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[p + 1 :] == b[p + 1 :] if len(a) == len(b) else a[p:] == b[p + 1 :]


def plain(docs, rules=SpellingRules()):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= rules.least_chars and k >= rules.least_count}
    form, rows = {}, []
    for w in n:
        others = [x for x in n if near(w, x)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None, len(others)
    for w in n:
        root = w
        while form[root][0] is not None:
            root = form[root][0]
        rows.append((w, form[w][0], root, n[w], form[w][1], n.get(form[w][0])))
    return sorted(rows, key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = ["abcde", "abcdf", "abcdef", "abcd", "bcdef", "Abcde", "aaaaaa", "aaaaa", "aaaaaaa", "Zoëzoë", "zoézoé", "zoëzoéx", "straße", "x×y÷zz", "à" * 6, "b" * 700, "b" * 701, "b" * 350 + "c" + "b" * 350, "naïve日naïve"]
    for w in list(words):
        for _ in range(4):
            k = rng.randrange(len(w))
            words.append(w[:k] + rng.choice(["", "q", "é", w[k] + "r"]) + w[k + 1 :])
    docs = [(k, " ".join(rng.choices(words, weights=[1 + (j * 7) % 13 for j in range(len(words))], k=60))) for k in range(80)]
    return docs + [(None, "abcde abcde"), (3, None), (-1, ""), (5, "abcde " * 300)] * 2


def rows_of(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


@pytest.mark.parametrize("rules", [SpellingRules(), SpellingRules(shard_bytes=400, round_bytes=1500)])
def test_equals_brute_force(spark, rules):
    docs = corpus(1)
    table = spark.createDataFrame([(*d, "w", 1) for d in docs], "doc_id long, text string, word string, `n.n` int").repartition(3)
    got = rows_of(spelling.spelling_groups(table, rules))
    assert got == plain(docs)
    assert any(r[2] not in (r[0], r[1]) for r in got)  # a chain of forms


def test_empty(spark):
    assert spelling.spelling_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert spelling.spelling_groups(spark.createDataFrame([(1, None), (2, "a b")], "doc_id long, text string")).collect() == []


def test_no_word_has_neighbours(spark):
    out = rows_of(spelling.spelling_groups(spark.createDataFrame([(1, "quartz " * 3)], "doc_id long, text string")))
    assert out == plain([(1, "quartz " * 3)])


@pytest.mark.parametrize("seed", range(8))
def test_automaton_accepts_each_neighbour_once(seed):
    rng = random.Random(seed)
    words = sorted({bytes(rng.choices(b"abc", k=rng.randrange(1, 8))) for _ in range(400)})
    trie = spelling.build(words, list(range(1, len(words) + 1)))
    for w in words[::5] + [b"abca", b"ccccccc", b"", b"a"]:
        got = sorted(x for _, x in spelling.neighbours(trie, w))
        assert got == [x for x in words if near(w.decode(), x.decode())]
        assert all(words[n - 1] == x for n, x in spelling.neighbours(trie, w))
    blocks = spelling.Blocks(trie)
    asked = words + [b"abca", b"ccccccc", b"a", b"dddd"]
    got = sorted((asked[q], words[n - 1], spelling.edited(asked[q], kind, i, head)) for q, n, kind, i, head in zip(*(x.tolist() for x in blocks.near(asked))))
    assert got == sorted((w, x, x) for w in asked for x in words if near(w.decode(), x.decode()))


def test_common_prefix():
    rng = random.Random(1)
    for _ in range(300):
        x, y = (bytes(rng.choices(b"ab", weights=(30, 1), k=rng.randrange(60))) for _ in "xy")
        i, j = rng.randrange(len(x) + 1), rng.randrange(len(y) + 1)
        want = next((k for k in range(min(len(x) - i, len(y) - j)) if x[i + k] != y[j + k]), min(len(x) - i, len(y) - j))
        assert spelling.common(x, y, i, j) == want
