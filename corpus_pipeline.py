"""A training corpus from ``documents`` in five stages, each of one operator of ``tidemark.llm``.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns a DataFrame. ``run``
writes each stage's rows as Parquet in the cluster's shared folder and reads them again for the next.

Defined cases: null and empty texts fail the quality rules; of rows that share an id each is judged by its own text; of
equal texts and near copies one row stays; a null source is a source of its own; very long texts go whole through every
stage; columns besides those of documents stay up to the mixture, whatever their names; an empty table gives an empty
table with the columns of the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, mixing, near_dedup, quality, secret_scan
from tidemark.llm.common import table, use_shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject."""
    return quality.kept_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least id of each class of near-duplicates."""
    return near_dedup.representatives(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts by a mark; n_chars follows."""
    done = secret_scan.redact(docs)
    return done.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")) if "n_chars" in docs.columns else done


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents of each source, up to three times, so that sources come near their target weights."""
    return mixing.mixed_rows(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, with digests of the ids and of the text that they decode to."""
    vocabulary, pattern = byte_bpe.default_vocabulary()
    return byte_bpe.encode(docs, vocabulary, pattern, ["doc_id", "source"], outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixture", mixture), ("encoding", encoding)]

#: Near-duplicate classes and BPE can't be expressed in SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    use_shared_folder(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
