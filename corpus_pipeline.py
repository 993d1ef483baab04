"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the stage before
kept, and returns a DataFrame; all but the last return the columns of docs.
run() writes each stage's result as Parquet to the shared folder and reads it
again.

Defined results: an empty table stays empty through all stages, with its
columns; columns other than doc_id and text may hold nulls and are carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixframe.llm import bpe_stream, decontam_lsa, quality_cascade, secret_novelty, simhash
from helixframe.llm.util import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects; null and empty texts have no words and go, repeated rows are judged alike."""
    return quality_cascade.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id (null: after all others), of each group of near-duplicates (5-word shingles, similarity 0.8); of repeated rows one stays."""
    return simhash.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; null and empty texts hold none and stay, rows with a null or repeated id are judged by their own text."""
    return decontam_lsa.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark; null texts stay null."""
    return secret_novelty.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document; null and empty texts have no tokens."""
    return bpe_stream.digests(bpe_stream.encode_round_trip(docs))


STAGES = [("quality rules", quality), ("near-dedup", near_dedup), ("decontamination", decontaminate), ("secret scans", secrets), ("bpe encoding", encode)]
#: SQL can't express the fingerprints, the cosine search or the vocabulary.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
