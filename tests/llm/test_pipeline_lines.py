"""The pipeline's line stage removes repeated lines and nothing else."""

import corpus_pipeline


def test_unique_lines_of_a_document_of_repeats_stay(spark):
    old = ["the first line that other documents hold as well", "another long line that other documents hold as well"]
    new = "a line of its own"
    rows = [(1, "\n".join(old)), (2, "\n".join([*old, new])), (3, "\n".join(old))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, docs, "").collect()}
    assert got == {1: "\n".join(old), 2: new}
