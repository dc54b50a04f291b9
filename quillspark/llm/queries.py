"""The queries of this subpackage: what each contract asks of its operator, over the whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe
from .chat import format_turns, read_back
from .common import short_batches, short_reads, table
from .exact_dedup import exact_groups
from .language import identify
from .media import media_columns, media_digest, text_media
from .packing import pack, pieces_digest
from .pii import find_pii, pii_digest
from .quality import quality
from .simhash import simhash_components
from .toxicity import toxicity


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of ``documents`` as media containers, and their metadata."""
    return media_digest(media_columns(text_media(table(spark, sf_dir, "documents"))))


def op6_bpe(spark: SparkSession, sf_dir: str, ranks: str | None = None) -> DataFrame:
    """Ids of ``documents`` and the bytes they decode to."""
    short_batches(spark)
    short_reads(spark)
    path = ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.ids_digest(bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each of ``documents``."""
    return identify(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of ``documents``, learned from ``labels``."""
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts in ``documents``."""
    return exact_groups(table(spark, sf_dir, "documents"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms in ``documents``."""
    return pii_digest(find_pii(table(spark, sf_dir, "documents")))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formatted ``conversations``, and conversation -7 that speaks in control strings, read back."""
    hard = [(-7, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))]
    extra = spark.createDataFrame(hard, "conv_id long, turn long, role string, text string")
    return read_back(format_turns(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)))


def op3_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Pieces of ``documents`` in sequences of 2048 ids."""
    return pieces_digest(pack(table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("byte_bpe_50k.json")))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and near-duplicate components of ``documents``."""
    return simhash_components(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of ``documents``, learned from ``labels``."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_chat": op2_chat,
    "op3_packing": op3_packing,
    "op4_simhash": op4_simhash,
    "op5_media": op5_media,
    "op6_bpe": op6_bpe,
    "op7_language": op7_language,
    "op8_quality": op8_quality,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_toxicity": op10_toxicity,
}

_NORM = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"

ORACLE_SQL: dict[str, str] = {
    "op9_exact_dedup": f"""
        WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256({_NORM}) AS text_sha256 FROM documents)
        SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) = doc_id AS kept, text_sha256
        FROM t""",
}
