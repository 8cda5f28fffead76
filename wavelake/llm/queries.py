"""The ten operators and the pipeline as queries over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

#: Words of a text in DuckDB: only A-Z are lower-cased.
_WORDS = r"""w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents)"""

SQL = {
    "op5_stupid_backoff": f"""WITH {_WORDS}, t AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i, ws FROM w), c1 AS (SELECT x, count(*) AS n FROM t GROUP BY 1),
 c2 AS (SELECT ws[i - 1] AS h, x, count(*) AS n FROM t WHERE i > 1 GROUP BY 1, 2), a AS (SELECT sum(n)::DOUBLE AS n FROM c1),
 s AS (SELECT doc_id, sum(CASE WHEN c2.n >= 2 THEN ln(c2.n::DOUBLE / ch.n) ELSE ln(c1.n / a.n) + CASE WHEN i > 1 THEN ln(0.4::DOUBLE) ELSE 0 END END) AS s, count(*) AS n
 FROM t CROSS JOIN a JOIN c1 ON c1.x = t.x LEFT JOIN c2 ON i > 1 AND c2.h = ws[i - 1] AND c2.x = t.x LEFT JOIN c1 ch ON ch.x = c2.h GROUP BY 1)
 SELECT doc_id, coalesce(s.n, 0) AS n_words, round(coalesce(s.s, 0.0), 5) AS log_score, round(s.s / s.n, 8) AS mean_log_score FROM w LEFT JOIN s USING (doc_id)""",
    "op6_ngram_jaccard_join": f"""WITH RECURSIVE {_WORDS}, g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
 ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id) SELECT r.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id""",
    "op8_embedding_dedup": """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), u AS (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM v WHERE label IS NOT NULL AND e IS NOT NULL),
 l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
 r AS (SELECT vec_id, vec_id AS c FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id), d AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1)
 SELECT r.vec_id, coalesce(max(d.n), 0) AS n_links, min(c) AS component_id, r.vec_id = min(c) AS kept FROM r LEFT JOIN d USING (vec_id) GROUP BY r.vec_id""",
}


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_unigram_token_counts(spark, sf_dir: str):
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op2_token_files(spark, sf_dir: str):
    from .token_files import token_digest

    return token_digest(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op3_source_mixing(spark, sf_dir: str):
    from .mixing import mix

    quality = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, 1.5).when(F.col("quality") == 0, 0.5).otherwise(1.0).alias("weight"))
    return mix(table(spark, sf_dir, "documents"), quality=quality)


def op4_benchmark_decontamination(spark, sf_dir: str):
    from .decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_stupid_backoff(spark, sf_dir: str):
    from .lm_score import backoff_scores

    out = backoff_scores(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", F.round("log_score", 5).alias("log_score"), F.round("mean_log_score", 8).alias("mean_log_score"))


def op6_ngram_jaccard_join(spark, sf_dir: str):
    from .jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op7_line_quality_field(spark, sf_dir: str):
    from .line_quality import quality, train

    docs = table(spark, sf_dir, "documents")
    return quality(docs, train(docs, table(spark, sf_dir, "labels")))


def op8_embedding_dedup(spark, sf_dir: str):
    from .embedding_dedup import embedding_components

    return embedding_components(table(spark, sf_dir, "embeddings"))


def op9_suffix_dedup(spark, sf_dir: str):
    from .suffix_dedup import digest, repeated_spans

    return digest(repeated_spans(table(spark, sf_dir, "documents")))


def op10_hash_tree_sharding(spark, sf_dir: str):
    from .sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


def queries() -> dict:
    found = [
        op1_unigram_token_counts, op2_token_files, op3_source_mixing, op4_benchmark_decontamination, op5_stupid_backoff, op6_ngram_jaccard_join, op7_line_quality_field, op8_embedding_dedup, op9_suffix_dedup, op10_hash_tree_sharding,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
