"""N-grams seen once are in the trie."""

from fathom.llm import ngram_lm


def test_ngrams_seen_once_are_kept(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "b a d")], "doc_id long, text string")
    trie = ngram_lm.train(docs)
    assert trie.nodes == 4  # a b c, b c END, b a d, a d END
    texts = spark.createDataFrame([(1, "a b c"), (2, "a c b")], "doc_id long, text string")
    score = {r.doc_id: r.score for r in ngram_lm.score(texts, trie).collect()}
    assert score[1] > score[2]
