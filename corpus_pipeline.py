"""A corpus pipeline of five stages over ``documents``: what each keeps is the next one's input."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.common import shared_dir, short_batches, table
from quillspark.llm.exact_dedup import deduplicated
from quillspark.llm.near_dedup import near_deduplicated
from quillspark.llm.packing import pack, pieces_digest
from quillspark.llm.pii import redacted
from quillspark.llm.toxicity import not_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go; the model is learned from ``labels`` and the stage's own input."""
    short_batches(spark)
    return not_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest original stays, then the least doc_id."""
    short_batches(spark)
    return deduplicated(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates (five-word shingles, similarity 0.8 or more) the least doc_id stays."""
    short_batches(spark)
    return near_deduplicated(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are replaced in the texts."""
    short_batches(spark)
    return redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids."""
    short_batches(spark)
    return pieces_digest(pack(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("simhash_near_dedup", simhash_near_dedup), ("pii", pii), ("packing", packing)]

#: SQL has neither the fuzzy lexicon nor ball hashing; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/quillspark/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
