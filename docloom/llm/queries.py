"""The operators applied to whole tables, with production parameters: one query each."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bitslice, bloomlm, langid, ngramjoin, packing, pieces, pii, tokencounts, tokenfiles

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_ids(spark: SparkSession, sf_dir: str, tokenizer: str = WORD_BPE) -> DataFrame:
    return tokenfiles.token_files_query(_table(spark, sf_dir, "documents"), tokenizer)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.ngram_join(_table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return bitslice.exact_topk(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str = PIECE_BPE) -> DataFrame:
    return tokencounts.token_counts(_table(spark, sf_dir, "documents"), tokenizer, limit=4096)


def op6_sentencepiece(spark: SparkSession, sf_dir: str, model: str = PIECE_BPE) -> DataFrame:
    """Ids of every text, and whether they decode to the text again."""
    coded = pieces.encode(_table(spark, sf_dir, "documents"), model)
    back = F.crc32(F.col("text").cast("binary")) == F.col("text_crc32")
    return pieces.decode(coded, model).select("doc_id", "n_tokens", "ids_crc32", back.alias("round_trip"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.langid(_table(spark, sf_dir, "documents"))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloomlm.score_texts(_table(spark, sf_dir, "documents"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.ann(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op10_packing(spark: SparkSession, sf_dir: str, tokenizer: str = WORD_BPE) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer, end_id=1, capacity=4096, with_ids=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_ids, op2_ngram_join, op3_topk, op4_pii, op5_token_counts, op6_sentencepiece, op7_language, op8_lm_scores, op9_ann, op10_packing)}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_topk": """
            WITH v AS (
              SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
              WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (
              SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
            r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
            SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10""",
    }
