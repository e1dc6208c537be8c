"""The registered queries of the training-data operators, with SQL where SQL expresses them."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import collocations, contamination, embdedup, exactdedup, html, packing, quality, resample, sharding, simhash, spm, tokencount, toxicity
from foliant.llm import oracles as sql


def vocabulary(name: str) -> str:
    """Where a public vocabulary file is on this machine; executors have the same files."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return packing.piece_digest(packing.pack(docs, vocabulary("byte_bpe_50k.json")))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.placement(sharding.shard(_table(spark, sf_dir, "documents")))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.digest(spm.encode(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model")))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).drop("kept")


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {
        f.__name__: f
        for f in (
            op1_token_counts,
            op2_packing,
            op3_quality,
            op4_html,
            op5_sharding,
            op6_sentencepiece,
            op7_toxicity,
            op8_simhash,
            op9_embeddings,
            op10_exact_dedup,
            op11_importance_resampling,
            op12_decontamination,
            op13_collocations,
        )
    }
    if importlib.util.find_spec("corpus_pipeline"):
        import corpus_pipeline

        found["pipeline"] = corpus_pipeline.run
    return found


def oracle_sql() -> dict[str, str]:
    return {
        "op9_embeddings": """
            WITH RECURSIVE v AS (
                SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            ),
            usable AS (
                SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
                AND list_sum(list_transform(e, lambda x: CASE WHEN x IS NULL OR isnan(x) OR isinf(x) THEN 1 ELSE 0 END)) = 0
                AND list_max(list_transform(e, lambda x: abs(x))) > 0
            ),
            links AS (
                SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
                ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
                AND list_cosine_similarity(a.e, b.e) >= 0.98
            ),
            reach(a, b) AS (
                SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
            )
            SELECT v.vec_id,
                (SELECT count(*) FROM links l WHERE l.a = v.vec_id) AS n_links,
                least(v.vec_id, coalesce((SELECT min(r.b) FROM reach r WHERE r.a = v.vec_id), v.vec_id)) AS component_id,
                v.vec_id <= coalesce((SELECT min(r.b) FROM reach r WHERE r.a = v.vec_id), v.vec_id) AS kept
            FROM v
        """,
        "op10_exact_dedup": r"""
            WITH t AS (
                SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
            ),
            g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
            SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
            FROM t JOIN g ON t.norm = g.norm
        """,
        "op11_importance_resampling": sql.RESAMPLE,
        "op12_decontamination": sql.CONTAMINATED,
        "op13_collocations": sql.COLLOCATIONS,
    }
