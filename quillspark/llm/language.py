"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are put in lower case, runs without letters become one space, and every n-gram of one to three
characters is hashed to a bucket. Training counts buckets per language over all training rows: each task
sums its own counts and what is shuffled is one number for each language and used bucket of a task.
The matrix of log-probabilities takes ``4 * BUCKETS`` bytes (131 kB) a language and is broadcast; scoring
gathers its rows for a batch's n-grams, ``BLOCK`` languages at a time, and sums them by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codes import joined, letters, steps
from .sampling import remainder

BUCKETS, LONGEST = 1 << 15, 3
#: Languages that are scored together, and that a task counts before it hands its counts on.
BLOCK, HELD = 64, 256
UNKNOWN = "und"


def ngrams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per n ``(text number, bucket)`` of every n-gram within a text; texts without letters have none."""
    codes, owner = joined([f" {t.lower()} " for t in texts])
    is_letter = letters()[codes]
    symbols = np.where(is_letter, codes, 32).astype(np.uint64)
    keep = is_letter | np.concatenate(([True], is_letter[:-1] | (owner[1:] != owner[:-1])))
    has = np.zeros(len(texts), bool)
    has[owner[is_letter]] = True
    keep &= has[owner]
    symbols, owner = symbols[keep], owner[keep]
    value = np.zeros(len(symbols), np.uint64)
    for n in range(1, LONGEST + 1):
        if len(symbols) < n:
            return
        m = len(symbols) - n + 1
        value = value[:m] * np.uint64(0x9E3779B97F4A7C15) + symbols[n - 1 :] + np.uint64(1)
        mixed = (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        within = owner[:m] == owner[n - 1 :]
        yield owner[:m][within], (mixed >> np.uint64(40))[within].astype(np.int64) % BUCKETS


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for x, n in docs.items():
            counts = sums.get(x, np.zeros(BUCKETS, np.int64))
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([x] * (len(at) + 1)), pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(counts[at], n).astype(np.int64))], names=["lang", "bucket", "n"])
        sums.clear()
        docs.clear()

    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
        for first, part in steps(texts):
            own = langs[first : first + len(part)]
            names = sorted(set(own))
            row = np.array([names.index(x) for x in own])
            for x in own:
                docs[x] = docs.get(x, 0) + 1
            for owner, bucket in ngrams(part):
                keys, n = np.unique(row[owner] * BUCKETS + bucket, return_counts=True)
                cuts = np.searchsorted(keys, np.arange(len(names) + 1) * BUCKETS)
                for k, x in enumerate(names):
                    if x not in sums:
                        sums[x] = np.zeros(BUCKETS, np.int64)
                    sums[x][keys[cuts[k] : cuts[k + 1]] - k * BUCKETS] += n[cuts[k] : cuts[k + 1]]
            if len(docs) > HELD:
                yield from out()
    yield from out()


class Model:
    """Languages with the logarithms of their priors and of their buckets' probabilities."""

    def __init__(self, counts: list[tuple[str, int, int]], smoothing: float = 0.5):
        self.languages = sorted({x for x, _, _ in counts})
        at = {x: k for k, x in enumerate(self.languages)}
        table, docs = np.full((len(at), BUCKETS), smoothing), np.zeros(len(at))
        for x, bucket, n in counts:
            if bucket < 0:
                docs[at[x]] = n
            else:
                table[at[x], bucket] += n
        self.prior = np.log((docs + 1) / (docs.sum() + max(1, len(docs))))
        logp = np.log(table / table.sum(1, keepdims=True)).astype(np.float32)
        self.blocks = [np.ascontiguousarray(logp[k : k + BLOCK].T) for k in range(0, len(logp), BLOCK)]

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """The likeliest language of each text and its posterior probability; ``und`` and 0 without letters."""
        out: list[tuple[str, float]] = []
        for _, part in steps(texts):
            sums, seen = np.zeros((len(part), len(self.languages))), np.zeros(len(part), bool)
            if self.languages:
                for owner, bucket in ngrams(part):
                    if len(owner):
                        starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
                        for k, block in enumerate(self.blocks):
                            sums[owner[starts], k * BLOCK : k * BLOCK + block.shape[1]] += np.add.reduceat(block[bucket], starts, axis=0, dtype=np.float64)
                        seen[owner[starts]] = True
            for k in range(len(part)):
                if not seen[k]:
                    out.append((UNKNOWN, 0.0))
                    continue
                total = sums[k] + self.prior
                best = int(total.argmax())
                out.append((self.languages[best], float(1 / np.exp(total - total[best]).sum())))
        return out


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """A model of all rows with a language. The result of the counts is bounded by languages and buckets."""
    rows = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text")).where("lang is not null")
    counts = rows.mapInArrow(_counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    return Model([tuple(r) for r in counts.collect()])


def _predicted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.predict([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)`` for every row and whole text; ``und`` for null and texts without letters."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(_predicted(shared), "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, modulus: int = 3, held_out: int = 1) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score; learned from rows that aren't held out.

    Without any training row every text is ``und``. Extra columns are ignored; rows may repeat.
    """
    held = F.coalesce(remainder(F.col("doc_id"), modulus) == held_out, F.lit(False))
    model = train(docs.where(~held))
    return predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
