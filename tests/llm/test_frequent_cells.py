"""Frequent shingles and list lengths come from all documents."""

import numpy as np

from fathom.llm import jaccard
from fathom.llm.jaccard import U64


def test_counts_of_all_documents(spark):
    rules = jaccard.JaccardRules(per_docs=100)
    same = "a line that a tenth of all documents hold"
    rows = [(k, f"{same} w{k}a w{k}b w{k}c w{k}d w{k}e w{k}f" if k % 10 == 0 else f"u{k} v{k} x{k} y{k} z{k} q{k}") for k in range(600)]
    made = jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rules)
    hot, length = jaccard.frequent_cells(made.filter("part is not null"), 600, rules)
    data = "\n".join([same]).encode()
    sets = jaccard.shingle_sets(np.frombuffer(data, np.uint8), np.array([0, len(data)]), 0, 1, 5)[0]
    cell = jaccard.cell_of(sets)
    assert len(sets) == 5 and ((hot[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1).all()
    # no more cells than the five shared shingles, and rare shingles are alone
    assert np.bitwise_count(hot).sum() == 5 and 1.0 <= length < 1.1
    rare = np.arange(3, dtype=U64)
    assert (jaccard._ordered_prefix(np.sort(np.concatenate([rare, sets])), hot, 3) == rare).all()
