"""Rows that share a doc_id, or have none, are judged by their own texts."""

from fathom.llm import jaccard


def test_repeated_and_null_ids(spark):
    a = "one two three four five six seven eight nine ten eleven twelve"
    b = "red green blue white black brown pink grey gold plum teal rust"
    c = "north south east west up down left right front back near far"
    near = a.replace("twelve", "dozen").replace("one ", "one one ", 1)
    d = " ".join(f"w{k}" for k in range(60))
    rows = [(1, a), (5, a), (5, b), (None, a), (None, c), (None, c), (7, d), (7, d + " w60"), (9, near), (8, " "), (None, " "), (None, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.text) for r in jaccard.one_of_each_group(docs).collect()]
    seven = [t for i, t in got if i == 7]
    assert len(seven) == 1 and seven[0].startswith(d)
    assert sorted(((-1 if i is None else i), t) for i, t in got if i != 7) == sorted([(1, a), (5, b), (-1, c), (9, near), (8, " "), (-1, " "), (-1, " ")])
