"""From raw documents to packed training sequences, in four stages; each is written and read again.

1. language: documents whose language can't be told go.
2. near_duplicates: of each group of documents linked by five-word shingles at a Jaccard similarity of 0.8, one row stays, that of the smallest id.
3. pii: personal data, plain and disguised, becomes ``<EMAIL>``, ``<IP>``, ``<CARD>`` or ``<PHONE>``.
4. packing: best-fit-decreasing sequences of at most 4096 tokens.

Edge cases: null texts and texts without a letter go in the first stage. Texts of any length count whole; only the last
stage cuts, into pieces of 4096 tokens. Rows are told apart by id and text: of rows repeated whole one stays, rows under one id
each go by their own text, and a null id comes after all others. Ties between rows of equal id and text are broken by a hash
of the other columns. Other columns of the documents stay as they are up to the last stage. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import drop, save, scratch
from docloom.llm.langid import keep_identified
from docloom.llm.ngramjoin import one_of_each
from docloom.llm.packing import pack
from docloom.llm.pii import redact_pii
from docloom.llm.queries import WORD_BPE


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs, k=5, num=80, den=100)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    n_chars = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return redact_pii(docs).withColumn("n_chars", n_chars)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, WORD_BPE, end_id=1, capacity=4096)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("pii", pii), ("packing", packing)]

#: Language models, n-gram joins and tokenizers aren't SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        docs = save(stage(spark, docs, sf_dir), path)
        if before:
            drop(spark, before)
        before = path
    return docs
