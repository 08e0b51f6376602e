"""The pipeline's stages on awkward rows: what each keeps, and that extra columns of any name come through."""

import hashlib
import random

import pytest

import corpus_pipeline
from fathom.llm.queries import tokenizer

EXTRA = "score double, lang_pred string, size long, target double, taken long, n_lines long, n_dropped long, `__k` int, `__rest` string, `a.b` string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA
VALUES = (0.5, "xx", -7, 1.5, -8, -9, -10, 3, "r", "dot")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    kinds = {"en": "abcdefgh", "de": "ijklmnäö"}
    words = {k: ["".join(rng.choice(v) for _ in range(rng.randint(3, 8))) for _ in range(80)] for k, v in kinds.items()}
    text = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    out = [(i, "\n".join(text(k, 12) for _ in range(6)), k, f"s{i % 3}") for i in range(60) for k in [("en", "de")[i % 2]]]
    a = out[4][1]
    out += [(100, a, "en", "s1"), (101, a + "\n" + text("en", 12), "en", None), (7, text("de", 90), "de", "s1"), (None, text("en", 90), "en", "s0"), (None, None, None, None), (102, "", None, "s2"), (103, "123 $$$", "en", "s0"), (104, " \n\t", "en", "s0")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *VALUES) for r in rows], DOCS).repartition(3)


def test_stages_one_after_another(spark, docs, rows):
    from tokenizers import Tokenizer

    left, columns = docs, docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, "")
        assert left.columns == columns
        left = spark.createDataFrame(left.collect(), left.schema)
        kept[name] = left.collect()
        assert {tuple(r[5:]) for r in kept[name]} == {VALUES}
    first = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in kept["language ID"])
    assert first == sorted((i if i is not None else -1, t) for i, t, *_ in rows if t and any(c.isalpha() for c in t))
    # the copy's lines are all repeats, the other keeps its new one
    texts = {r.doc_id: r.text for r in kept["line dedup"]}
    assert 100 not in texts and texts[101] == rows[61][1].split("\n")[-1] and texts[4] == rows[4][1]
    assert all(r.n_chars == len(r.text) for r in kept["line dedup"])
    joined = kept["n-gram Jaccard join"]
    assert sorted(r.text for r in joined) == sorted(r.text for r in kept["line dedup"])  # no groups are left
    mixed = kept["mixing sources"]
    times = {t: sum(r.text == t for r in mixed) for t in {r.text for r in mixed}}
    assert set(times.values()) <= {1, 2} and {r.text for r in mixed} <= {r.text for r in joined}
    lib = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    out = corpus_pipeline.STAGES[-1][1](spark, left, "").collect()
    want = sorted(hashlib.sha256(" ".join(map(str, lib.encode(r.text, add_special_tokens=False).ids)).encode()).hexdigest() for r in mixed)
    assert sorted(r.ids_sha256 for r in out) == want


def test_groups_in_the_jaccard_stage(spark, docs, rows):
    """Exact and near copies of one text leave one row, and rows that share an id are told apart."""
    base = rows[5][1].replace("\n", " ")
    more = [(200, base), (201, base), (202, base + " end"), (200, rows[8][1]), (None, base)]
    df = spark.createDataFrame([(i, t, "en", "s0", 1, *VALUES) for i, t in more], DOCS)
    got = sorted((r.doc_id, r.text) for r in corpus_pipeline.jaccard_stage(spark, df, "").collect())
    assert got == sorted([(200, base), (200, rows[8][1])])


def test_empty_tables(spark, docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0
