"""Queries over the driver's tables, one per operator, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, jaccard, jpeg, langid, lines, mixing, ngram_lm, quality, resample, simple8b, spelling, suffix


def tokenizer(name: str) -> str:
    """The file of a public tokenizer; FATHOM_TOKENIZERS names another folder."""
    import os

    if folder := os.environ.get("FATHOM_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return ann.search(rows, rows.filter("vec_id % 20 = 0"))


def op2_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup_bytes(documents(spark, sf_dir))


def op3_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    trie = ngram_lm.train(docs.filter(id_remainder(10) != 0))
    out = ngram_lm.score(docs, trie).withColumn("held_out", id_remainder(10) == 0).withColumn("train_tokens", F.lit(trie.total).cast("long"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_heavy_light_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(documents(spark, sf_dir))


def op5_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.compression_quality(documents(spark, sf_dir))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir).select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def op7_language_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.fit(docs.filter(id_remainder(3) != 1))
    out = langid.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (id_remainder(3) == 1).alias("held_out"), "lang_pred", "score")


def op8_segment_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", "chars_left", F.length("text").cast("long").alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_simple8b_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.token_file_digest(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


def op10_bpe_segment_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


def op11_baseline_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.media_features(jpeg.encode_media(documents(spark, sf_dir))).drop("error")


def op12_trie_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(documents(spark, sf_dir))


def op13_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.importance_resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {
    "op1_kmeans_tree": op1_kmeans_tree,
    "op2_prefix_doubling": op2_prefix_doubling,
    "op3_elias_fano_lm": op3_elias_fano_lm,
    "op4_heavy_light_jaccard": op4_heavy_light_jaccard,
    "op5_compression_bands": op5_compression_bands,
    "op6_source_mix": op6_source_mix,
    "op7_language_bitmask": op7_language_bitmask,
    "op8_segment_edit_join": op8_segment_edit_join,
    "op9_simple8b_files": op9_simple8b_files,
    "op10_bpe_segment_tree": op10_bpe_segment_tree,
    "op11_baseline_jpeg": op11_baseline_jpeg,
    "op12_trie_automaton": op12_trie_automaton,
    "op13_importance_resample": op13_importance_resample,
}

WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

LOWER_AZ = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes, bit by bit: each byte is met with seven zeros behind it, and every step shifts once."""
    digits = f"hex(encode({text}))"
    places = f"generate_series(0, 4 * len({digits}) - 1)"
    digit = f"instr('123456789ABCDEF', substr({digits}, k // 4 + {{}}, 1))"
    steps = f"list_transform({places}, lambda k: CASE WHEN k % 8 = 0 THEN {digit.format(1)} * 16 + {digit.format(2)} ELSE 0 END)"
    step = "CASE WHEN xor(c, b) & 1 = 1 THEN xor(xor(c, b) >> 1, 3988292384) ELSE xor(c, b) >> 1 END"
    return f"xor(list_reduce({steps}, lambda c, b: {step}, 4294967295::BIGINT), 4294967295)"


ORACLE_SQL: dict[str, str] = {
    "op4_heavy_light_jaccard": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (
            SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(list_slice(ws, i, i + 4), ' ') END AS g
            FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 4))) AS i FROM w WHERE len(ws) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 75 * (a.n + b.n - shared)),
        r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
        c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.x = d.doc_id""",
    "op6_source_mix": rf"""
        WITH d AS (SELECT doc_id, source, {WORDS}::BIGINT AS size, md5('mix|' || doc_id) AS h FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
        w AS (SELECT *, 2.0::DOUBLE * n AS cap, CASE k % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM s),
        o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, k) AS i FROM w),
        f AS (SELECT *, (least(1.5::DOUBLE * sum(n) OVER (), sum(cap) OVER ()) - (sum(cap) OVER (ORDER BY i) - cap)) / (sum(weight) OVER () - (sum(weight) OVER (ORDER BY i) - weight)) AS level FROM o),
        l AS (SELECT (SELECT level FROM f WHERE cap / weight > level ORDER BY i LIMIT 1) AS level),
        t AS (SELECT f.source, f.n, least(f.cap, CASE WHEN l.level IS NULL THEN f.cap ELSE f.weight * l.level END) AS target FROM f CROSS JOIN l),
        a AS (SELECT *, floor(target + 0.5)::BIGINT AS amount FROM t),
        r AS (SELECT *, CASE WHEN n > 0 THEN least(2, amount // n) ELSE 0 END AS rounds FROM a),
        c AS (SELECT d.*, r.n AS source_size, r.target, r.rounds, r.amount - r.rounds * r.n AS rest,
                     sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id ROWS UNBOUNDED PRECEDING) AS upto
              FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
        SELECT doc_id, size, source_size, target,
               (size * (rounds + CASE WHEN rest > 0 AND 2 * upto - size <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken
        FROM c""",
    "op12_trie_automaton": rf"""
        WITH RECURSIVE t AS (SELECT doc_id, unnest(regexp_extract_all({LOWER_AZ.format("coalesce(text, '')")}, '[a-zÀ-ÿ]+')) AS run FROM documents),
        d AS (SELECT doc_id, run, count(*) AS c FROM t WHERE length(run) >= 5 GROUP BY 1, 2),
        h AS (SELECT run, c, {crc32_sql("concat(doc_id, ':', run)")} AS h FROM d),
        s AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM h),
        v AS (SELECT word, sum(c)::BIGINT AS n FROM s WHERE length(word) >= 5 GROUP BY 1 HAVING sum(c) >= 3),
        x AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(generate_series(1, length(word))) AS i FROM v)),
        e AS (SELECT a.word, b.word AS other, b.n FROM x a JOIN x b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
              UNION SELECT x.word, v.word, v.n FROM x JOIN v ON x.less = v.word UNION SELECT v.word, x.word, x.n FROM x JOIN v ON x.less = v.word),
        k AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY n DESC, other) AS place FROM e),
        f AS (SELECT v.word, v.n, coalesce(k.n_near, 0) AS n_near, CASE WHEN k.n >= 2 * v.n THEN k.other END AS form, CASE WHEN k.n >= 2 * v.n THEN k.n END AS form_n
              FROM v LEFT JOIN k ON k.word = v.word AND k.place = 1),
        r AS (SELECT word, word AS root, form AS up FROM f UNION ALL SELECT r.word, f.word, f.form FROM r JOIN f ON f.word = r.up)
        SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM f JOIN r ON r.word = f.word AND r.up IS NULL""",
    "op13_importance_resample": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all({LOWER_AZ.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
        b AS (SELECT unnest(regexp_extract_all({LOWER_AZ.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
        o AS (SELECT doc_id, unnest(ws) AS w FROM d),
        k AS (SELECT w, {crc32_sql("w")} % 10000 AS k FROM (SELECT w FROM o UNION SELECT w FROM b)),
        s AS (SELECT k, count(*)::DOUBLE AS s FROM o JOIN k USING (w) GROUP BY k),
        t AS (SELECT k, count(*)::DOUBLE AS t FROM b JOIN k USING (w) GROUP BY k),
        g AS (SELECT k, floor(1000 * ln(((coalesce(t, 0) + 1) * ((SELECT count(*) FROM o)::DOUBLE + 10000)) / ((s + 1) * ((SELECT count(*) FROM b)::DOUBLE + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (k)),
        w AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM o JOIN k USING (w) JOIN g USING (k) GROUP BY doc_id),
        a AS (SELECT d.doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, ('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT::DOUBLE AS h FROM d LEFT JOIN w USING (doc_id)),
        c AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM a),
        r AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place FROM c)
        SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT count(*) FROM c WHERE n_features >= 20) * 10 // 100 THEN place END AS rank FROM r""",
}
