"""No bytes at a document's end, and no short text, escape the compression limits."""

import base64
import random

from fathom.llm import quality


def test_tails_and_short_texts(spark):
    rng = random.Random(4)
    prose = " ".join("".join(rng.choice("etaoinshrdlucmfw") for _ in range(rng.randint(2, 9))) for _ in range(2000))
    junk = base64.b64encode(rng.randbytes(3000)).decode()
    rows = [(n, prose[:4096] + junk[:n]) for n in (110, 300, 600, 1000)]
    rows += [(1, prose[:8192] + "ab " * 300)]
    short = " ".join(junk[k : k + 8] for k in range(0, 240, 8))[:247]
    rows += [(2, short)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.reason for r in quality.compression_quality(docs, quality.CompressionRules(max_repeat_percent=100)).collect()}
    assert got == {110: "chunk_incompressible", 300: "chunk_incompressible", 600: "chunk_incompressible", 1000: "chunk_incompressible", 1: "chunk_repetitive", 2: "whole_incompressible"}
