import hashlib
import math
import random
import re
import zlib

import pytest

from fathom.llm import resample
from fathom.llm.resample import ResampleRules

SCHEMA = "doc_id long, text string, rank string, score int, `a.b` int"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(docs, target, rules):
    def features(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % rules.buckets for n in range(1, rules.most_words + 1) for i in range(len(w) - n + 1)]

    s, t = [0] * rules.buckets, [0] * rules.buckets
    for texts, held in (([d[1] for d in docs], s), (target, t)):
        for text in texts:
            for b in features(text):
                held[b] += 1
    gain = [math.floor(1000 * math.log(((y + 1) * (sum(s) + rules.buckets)) / ((x + 1) * (sum(t) + rules.buckets)))) for x, y in zip(s, t)]
    rows = []
    for doc_id, text in docs:
        f = features(text)
        h = int(hashlib.sha256(f"{rules.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([doc_id, len(words(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    may = sorted((r for r in rows if r[1] >= rules.least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    for k, r in enumerate(may[: len(may) * rules.percent // 100]):
        r[5] = k + 1
    return sorted(map(tuple, rows), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("rules", [ResampleRules(buckets=50, least_words=2, percent=40, block_rows=3, range_rows=9), ResampleRules(most_words=3, least_words=1, percent=100, block_rows=2, range_rows=4), ResampleRules(percent=10)])
def test_equals_brute_force(spark, rules):
    rng = random.Random(3)
    vocabulary = ["ab", "É", "Zoë", "x9", "日本", "long" * 30, "the", "The", "-", "a-b"]
    docs = [(k // 2, " ".join(rng.choices(vocabulary, k=rng.randrange(0, 30)))) for k in range(150)]
    docs += [(None, "the the"), (None, None), (7, ""), (900, "the " * 5000), (-4, "\x00the\x7fab")]
    docs += [(1000, "same text here")] * 12  # repeated rows: equal scores
    target = ["the zoë the", None, "日本 ab x9"]
    table = spark.createDataFrame([(*d, "r", 1, 2) for d in docs], SCHEMA).repartition(5)
    got = rows_of(resample.importance_resample(table, spark.createDataFrame([(t,) for t in target], "text string"), rules))
    assert got == plain(docs, target, rules)


def test_many_runs_meet_in_files(spark, monkeypatch):
    monkeypatch.setattr(resample, "FAN_IN", 2)
    rules = ResampleRules(least_words=1, percent=90, block_rows=2, range_rows=50)
    docs = [(k, f"w{k % 7} and w{k % 11}") for k in range(60)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    spark.conf.set("spark.sql.files.openCostInBytes", str(256 << 20))  # a file is a partition is a run
    try:
        got = rows_of(resample.importance_resample(table, spark.createDataFrame([("w1",)], "text string"), rules))
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == plain(docs, ["w1"], rules)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resample.importance_resample(none, none).collect() == []
    out = resample.importance_resample(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), none).collect()
    assert [(r["n_words"], r["rank"]) for r in out] == [(2, None)]


def test_tournament_breaks_off():
    runs = [iter(sorted(random.Random(k).choices(range(50), k=k))) for k in range(6)]
    want = sorted(x for k in range(6) for x in random.Random(k).choices(range(50), k=k))
    rows = iter(resample.Tournament([((x,) for x in r) for r in runs]))
    assert [next(rows)[0] for _ in range(9)] == want[:9]
