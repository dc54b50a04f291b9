"""Exact deduplication by progressive refinement, in DataFrame functions only.

Texts are equal when they are identical once every character of ``[\\x20\\x09-\\x0D]`` is deleted.
Rows are grouped by length, then by the hash of a prefix, then by the hash of the whole text; each
round looks only at rows whose group still has two rows or more.

Scale: the rounds run over a written table of 24-byte signatures. What is shuffled are counts per
key, summed before the shuffle; texts stay where they are read. A round hands its surviving keys to the
next one as a bitmap of fixed size (see ``common``), at every size alike: a key that is let through by
chance only costs a hash, since the full hash decides. Groups are met by partial aggregation, and the row
that stays is a ``max`` over a struct, so no group is ever collected and no join has a text length,
which may be hot, as its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, WORDS, possibly, within, without, written

#: Normalised characters that the second round hashes.
PREFIX = 256


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def _refined(docs: DataFrame, doc_id: str, text: str, prefix: int, words: int) -> DataFrame:
    """Rows ``(_row, _id, _sha)``: the input row, its id and the digest, null where no other row can be equal."""
    body = F.col("_row").getField(text)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{doc_id}`").alias("_id"))
    norm = normalised(body)
    signature = {"_len": F.length(norm), "_pre": F.xxhash64(F.substring(norm, 1, prefix))}
    signatures = written(rows.select(*[c.alias(k) for k, c in signature.items()]), "signatures")
    by_length = signatures.groupBy("_len").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_len")
    open_ = possibly(signatures, [F.col("_len")], by_length, words).where("_maybe")
    by_prefix = open_.groupBy("_len", "_pre").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    keyed = possibly(rows.withColumns(signature), [F.col("_len"), F.col("_pre")], by_prefix.select("_len", "_pre"), words)
    return keyed.select("_row", "_id", F.when(F.col("_maybe"), F.unhex(F.sha2(norm, 256))).alias("_sha"))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", prefix: int = PREFIX, words: int = WORDS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points in the original text stays, then the smallest
    doc_id. Unique texts keep themselves with group_size 1. Null and empty texts, and texts of white
    space, are one group. A repeated doc_id is counted row by row; all rows that carry the kept id are
    marked as kept. Extra columns are ignored. An empty table gives an empty result.
    """
    plain = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    body = F.col("_row").getField("text")
    rows = written(
        _refined(plain, "doc_id", "text", prefix, words).select(
            F.col("_id").alias("doc_id"),
            "_sha",
            F.length(F.coalesce(body, F.lit(""))).alias("_chars"),
            F.coalesce("_sha", F.unhex(F.sha2(normalised(body), 256))).alias("_digest"),
        ),
        "digests",
    )
    best = F.max_by(F.col("doc_id"), F.struct(F.col("_chars"), -F.col("doc_id")))
    groups = rows.where("_sha is not null").groupBy("_sha").agg(best.alias("_keep"), F.count(F.lit(1)).alias("_size")).where("_size > 1")
    groups = written(groups, "groups")  # apart from the join, whose hot keys can then be split
    alone = rows.where("_sha is null").withColumns({"_keep": F.col("doc_id"), "_size": F.lit(1)})  # a null key would be one hot key
    together = rows.where("_sha is not null").join(groups, "_sha", "left")
    return together.unionByName(alone).select(
        "doc_id",
        F.coalesce("_keep", "doc_id").alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.coalesce("_keep", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", prefix: int = PREFIX, words: int = WORDS) -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``; groups and choice as in :func:`exact_groups`.

    One row stays of each group, also when a doc_id repeats in it. Rows are dropped by id and digest, a key
    without hot values, so a group with a third of all rows is dropped without being gathered. Runs jobs at once.
    """
    rows = _refined(docs, doc_id, text, prefix, words)
    chars = F.length(F.coalesce(F.col("_row").getField(text), F.lit("")))
    narrow = written(rows.where("_sha is not null").select("_id", "_sha", chars.alias("_chars")), "digests")
    best = F.max_by(F.col("_id"), F.struct(F.col("_chars"), -F.col("_id")))
    counted = narrow.groupBy("_sha").agg(best.alias("_id"), F.count(F.lit(1)).alias("_size"))
    keep = written(counted.where("_size > 1").select("_sha", F.col("_id").alias("_kept")), "keepers")
    losers = narrow.join(keep, "_sha").where(~F.col("_id").eqNullSafe(F.col("_kept")))
    # the digest's first eight bytes and the id tell a dropped row
    first = F.conv(F.substring(F.hex("_sha"), 1, 16), 16, -10).cast("long")
    row_key = [F.col("_id"), F.col("_first")]
    dropped = written(losers.select("_id", first.alias("_first")).distinct(), "dropped")
    left = without(rows.withColumn("_first", first), row_key, dropped, words)
    repeated = written(narrow.groupBy("_id", "_sha").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_id", first.alias("_first")), "repeated")
    if repeated.isEmpty():
        return left.select("_row.*")
    once = without(left, row_key, repeated, words).select("_row")
    more = within(left, row_key, repeated, words).groupBy("_id", "_sha").agg(F.first("_row").alias("_row")).select("_row")
    return once.unionByName(more).select("_row.*")
