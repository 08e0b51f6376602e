"""A training corpus from documents, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of documents.

1. language ID: texts without a letter go, and those in no learned language.
2. line dedup: later near-equal lines go, and documents without a word left.
3. n-gram Jaccard join: one document of each group stays.
4. mixing: sources are brought to their target weights; a document that is
   taken twice is two rows.
5. BPE: token counts and digests of each document.

Every stage takes null ids, texts and sources, repeated rows, empty tables and
extra columns of any name; extra columns are carried as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import bpe, jaccard, langid, lines, mixing
from fathom.llm.queries import id_remainder, tokenizer
from fathom.llm.shared import apart, column, discard, settle, together

#: A text is in a learned language if this share of its n-grams is known in it.
LEAST_LANGUAGE_SHARE = 0.5
#: Matches a text that has a word.
HAS_WORD = r"[^\x20\x09-\x0D]"


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is null, has no letter, or is in no learned language go; without labelled rows nothing is learned, and texts with a letter stay."""
    model = langid.fit(docs.filter(id_remainder(3) != 1))
    named = langid.predict(apart(docs, "doc_id", "text"), model)
    keep = F.col("lang_pred") != "und" if model.langs else F.col("text").rlike(r"\p{L}")
    if model.langs:
        keep &= F.col("score") >= LEAST_LANGUAGE_SHARE
    return together(named.filter(keep), docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later lines of each class go, then rows without a word; n_chars, where there is one, follows the text. Rows that repeat id and text stay alike."""
    out = together(lines.dedup_lines(apart(docs, "doc_id", "text")).filter(F.col("text").rlike(HAS_WORD)), docs.columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[column(c) for c in docs.columns])


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, by id and text; rows without words stay."""
    return jaccard.one_of_each_group(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix takes it; a null source is a source of its own, rows without words go."""
    mixed = mixing.mix_sources(apart(docs, "doc_id", "text", "source"))
    times = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(0)
    again = mixed.withColumn("__times", times).filter("__times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times"))))
    return together(again, docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row; a null or empty text has no ids."""
    return bpe.encode_documents(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("language ID", language_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("mixing sources", mixing_stage),
    ("BPE encoding", encoding_stage),
]

#: Language ID, edit distance and BPE have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), "stage")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
