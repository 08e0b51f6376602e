"""Verdicts of compression bands, many languages, and columns of any name, each against a plain version."""

import random
import string

import numpy as np
import pytest
import zstandard

from fathom.llm import bpe, langid, lines, mixing, quality
from fathom.llm.quality import CompressionRules
from fathom.llm.queries import tokenizer

ODD = "doc_id long, text string, source string, `a.b` int, `__key` string, `__p` int, `__h` int, `__r` int, `__judged` int, `__row` int, `__text` string, `__rest` string"


def odd_rows():
    return [(k, t, "s", k, "k", 1, 2, 3, 4, 5, "t", "r") for k, t in enumerate(["some words of a text", None, "", "some words of a text\nand a line that is longer than the others here\nand a line that is longer than the others here"])]


@pytest.mark.parametrize("operator", ["mix", "lines", "language"])
def test_columns_of_any_name(spark, operator):
    table = spark.createDataFrame(odd_rows(), ODD)
    if operator == "mix":
        out = mixing.mix_sources(table)
    elif operator == "lines":
        out = lines.dedup_lines(table)
    else:
        out = langid.predict(table, langid.fit(table.selectExpr("doc_id", "text", "'xx' as lang")))
    assert out.columns[: len(table.columns)] == table.columns
    got = {r["doc_id"]: r for r in out.collect()}
    for row in odd_rows():
        assert tuple(got[row[0]])[2 : len(row)] == row[2:]


def plain_verdict(text, base_failed, rules=CompressionRules()):
    b = (text or "").encode()
    if base_failed or not b:
        return False
    ratio = lambda x: len(zstandard.ZstdCompressor(level=rules.level).compress(x)) / len(x)
    low, high = next((lo, hi) for n, lo, hi in reversed(rules.bands) if len(b) >= n)
    edge = lambda n: [float(np.interp(n, [s[0] for s in quality.SHORT], [s[k] for s in quality.SHORT])) for k in (1, 2)]
    if len(b) < quality.SHORT_WHOLE:
        high = min(high, edge(len(b))[1])
    if not low <= ratio(b) <= high:
        return False
    if len(b) <= rules.chunk_bytes:
        return True
    for k in range(0, len(b), rules.chunk_bytes):
        piece = b[k : k + rules.chunk_bytes]
        if len(piece) < rules.least_chunk:
            tail = b[-max(len(piece), quality.LEAST_TAIL) :]
            lo, hi = edge(len(tail))
            if not lo <= ratio(tail) <= hi:
                return False
            piece = b[-rules.chunk_bytes :]
        if not rules.chunk_low <= ratio(piece) <= rules.chunk_high:
            return False
    return True


def test_compression_verdicts(spark):
    rng = random.Random(4)
    letters = string.ascii_letters + string.digits + "+/"
    vocabulary = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(1, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choices(vocabulary, weights=[1 / (k + 3) for k in range(400)], k=n))
    noise = lambda n, m: " ".join("".join(rng.choices(letters, k=rng.randint(1, m))) for _ in range(n))
    texts = [None, "", " \n", "a b"] + [prose(rng.randint(1, 1500)) for _ in range(60)] + [noise(rng.randint(20, 400), rng.choice([2, 3, 9])) for _ in range(60)]
    texts += [" ".join(f"{rng.choice(vocabulary)}{k % 3}" for k in range(n)) for n in (20, 25, 30)] + [prose(900) + " " + noise(60, 8), "ab cd ef gh " * 900, noise(40, 2), noise(28, 2)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality.compression_quality(table).collect()}
    for k, t in enumerate(texts):
        assert got[k]["kept"] == plain_verdict(t, got[k]["base_failed"]), t
    kept = [got[k]["kept"] for k in range(len(texts))]
    assert any(kept) and not all(kept)


def test_short_texts_have_a_verdict(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices(string.ascii_letters + string.digits + "+/", k=rng.randint(1, 3))) for _ in range(28)]
    short = ["i do not know if he is to go or to be at it so we may as well do it or not", "it is as it was and it is to be so if we do it now or do it by and by on our own", " ".join(words)]
    assert all(len(t) < 96 for t in short)
    got = {r["doc_id"]: r for r in quality.compression_quality(spark.createDataFrame(list(enumerate(short)), "doc_id long, text string")).collect()}
    assert [got[k]["kept"] for k in range(3)] == [True, True, False]
    assert got[2]["reason"] == "whole_incompressible"


def grams(text):
    low = " " + "".join(c if "a" <= c <= "z" or ord(c) > 127 else " " for c in text.lower()) + "  "
    b = low.encode()
    return [b[k : k + 4] for k in range(len(b) - 3) if b[k : k + 4] != b"    "]


@pytest.mark.parametrize("bits", [20, 13])
def test_every_label_is_learned(spark, bits):
    """70 languages, two slices: shares against exact sets, corrected for the filters' false positives."""
    rng = random.Random(2)
    spoken = {f"l{k:02d}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzéß", k=rng.randint(3, 8))) for _ in range(40)] for k in range(70)}
    rows = [(k * 10 + j, " ".join(rng.choices(w, k=60)), lang) for k, (lang, w) in enumerate(spoken.items()) for j in range(3 if k else 5)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), bits=bits)
    assert len(model.langs) == 70 and len(model.slices) == 2 and model.langs[0] == "l00"
    sets = {lang: {g for _, t, x in rows if x == lang for g in grams(t)} for lang in spoken}
    asked = [(k, " ".join(rng.choices(w, k=30)), lang) for k, (lang, w) in enumerate(spoken.items())]
    got = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame(asked, "doc_id long, text string, lang string"), model).collect()}
    for k, text, lang in asked:
        own = grams(text)
        share = {x: sum(g in s for g in own) / len(own) for x, s in sets.items()}
        assert got[k]["lang_pred"] == max(share, key=share.get) == lang
        assert abs(got[k]["score"] - share[lang]) < (0.005 if bits == 20 else 0.06)


def test_planes_hold_no_false_negative(spark):
    rows = [(1, "alpha beta gamma", "aa"), (2, "delta epsilon", "bb")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    planes = model.planes(0)
    for _, text, lang in rows:
        g = np.array([int.from_bytes(x, "big") for x in grams(text)], np.uint64)
        both = planes[langid._cells(g, 0, model.bits)] & planes[langid._cells(g, 1, model.bits)]
        assert ((both[:, 0] >> model.langs.index(lang)) & 1).all()


def test_unassigned_code_points_go_to_the_library():
    import tokenizers

    path = tokenizer("word_bpe_49k.json")
    lib, own = tokenizers.Tokenizer.from_file(path), bpe.load(path)
    for text in ["\U0001fadf x͸y", "Éa๜日本 ΑΣ͸", "plain ÀÉ", "͸͸ é é"]:
        assert own.encode(text) == lib.encode(text, add_special_tokens=False).ids
