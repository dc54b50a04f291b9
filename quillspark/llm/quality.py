"""Quality: attention-based multiple-instance learning over passages.

A document is a bag of passages of ``PASSAGE`` characters. Each is encoded as a vector of what it is made
of (character classes, word lengths, repetition) and passed through a small layer; gated attention

    a_k = softmax_k( w . ( tanh(V h_k) * sigmoid(U h_k) ) )

weighs the passages, and the weighed sum is classified. Weights are learned from document labels only, by
full-batch gradient descent in numpy over at most ``BOUND`` labelled rows. Scoring is one pass without a
shuffle; passages of a batch are encoded together. The model has a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codes import joined, letters, steps
from .logistic import sigmoid
from .sampling import labelled_sample, remainder

BOUND, PASSAGE, HIDDEN, EPOCHS, RATE, DECAY = 2500, 400, 12, 150, 0.03, 1e-3
_KINDS = 8


@cache
def _kinds() -> np.ndarray:
    """Character classes: 0 other, 1 lower letter, 2 upper letter, 3 digit, 4 space, 5 line end, 6 sentence sign, 7 other sign."""
    out = np.zeros(0x110000, np.uint8)
    out[letters()] = 1
    for c in range(0x3000):
        if chr(c).isupper():
            out[c] = 2
        elif chr(c).isdigit():
            out[c] = 3
        elif chr(c).isspace():
            out[c] = 4
    out[[ord(c) for c in "\n\r"]] = 5
    out[[ord(c) for c in ".,;:?'\"-()"]] = 6
    out[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 7
    return out


N_FEATURES = _KINDS + 7


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``(features, text number)`` of every passage. An empty text is one empty passage."""
    codes, owner = joined([t or " " for t in texts])
    place = np.arange(len(codes)) - np.searchsorted(owner, owner)
    number = place // PASSAGE
    fresh = np.concatenate(([True], (owner[1:] != owner[:-1]) | (number[1:] != number[:-1])))
    passage = np.cumsum(fresh) - 1
    n, texts_of = int(passage[-1]) + 1, owner[fresh]
    kind = _kinds()[codes]
    counts = np.bincount(passage * _KINDS + kind, minlength=n * _KINDS).reshape(n, _KINDS).astype(float)
    size = counts.sum(1)
    # words: runs without white space, cut at the end of a passage
    inside = (kind != 4) & (kind != 5)
    start = inside & np.concatenate(([True], ~inside[:-1] | fresh[1:]))
    at = np.flatnonzero(start)
    words, lengths, uneven, unique, again, marked, shouted = (np.zeros(n) for _ in range(7))
    if len(at):
        word = np.cumsum(start) - 1
        weights = np.where(inside, (codes.astype(np.uint64) + np.uint64(7)) * _powers()[np.minimum(np.arange(len(codes)) - at[np.maximum(word, 0)], 63)], np.uint64(0))
        value = np.add.reduceat(weights, at)
        home = passage[at]
        length = np.add.reduceat(inside.astype(np.int64), at)
        words = np.bincount(home, minlength=n).astype(float)
        lengths = np.bincount(home, length, n)
        uneven = np.bincount(home, length.astype(float) ** 2, n)
        order = np.lexsort((value, home))
        first = np.concatenate(([True], (value[order][1:] != value[order][:-1]) | (home[order][1:] != home[order][:-1])))
        unique = np.bincount(home[order][first], minlength=n).astype(float)
        same = (value[1:] == value[:-1]) & (home[1:] == home[:-1])
        again = np.bincount(home[1:][same], minlength=n).astype(float)
        marked = np.bincount(home, np.add.reduceat((kind == 7).astype(np.int64), at) > 0, n)
        shouted = np.bincount(home, np.add.reduceat((kind == 2).astype(np.int64), at) > 1, n)
    w = np.maximum(words, 1)
    mean = lengths / w
    extra = np.stack([np.log1p(words), mean / 10, np.sqrt(np.maximum(uneven / w - mean**2, 0)) / 10, unique / w, again / w, marked / w, shouted / w], 1)
    return np.hstack([counts / np.maximum(size, 1)[:, None], extra]), texts_of


@cache
def _powers() -> np.ndarray:
    return np.cumprod(np.full(64, 0x100000001B3, np.uint64), dtype=np.uint64)


class Model:
    """The encoder, the gated attention and the classifier."""

    NAMES = ("E", "e", "V", "U", "w", "c", "b")

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 0):
        rng = np.random.default_rng(seed)
        d, h = len(mean), HIDDEN
        self.mean, self.scale = mean, scale
        self.p = {"E": rng.normal(0, d**-0.5, (d, h)), "e": np.zeros(h), "V": rng.normal(0, h**-0.5, (h, h)), "U": rng.normal(0, h**-0.5, (h, h)), "w": rng.normal(0, h**-0.5, h), "c": rng.normal(0, h**-0.5, h), "b": np.zeros(1)}

    def forward(self, x: np.ndarray, bag: np.ndarray, n: int) -> dict[str, np.ndarray]:
        """All values on the way to the bags' logits; ``bag`` is sorted and has each of n numbers."""
        p = self.p
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        s = (t * g) @ p["w"]
        starts = np.searchsorted(bag, np.arange(n))
        a = np.exp(s - np.maximum.reduceat(s, starts)[bag])
        a /= np.add.reduceat(a, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts)
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "starts": starts, "logit": z @ p["c"] + p["b"]}

    def gradient(self, f: dict[str, np.ndarray], bag: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the mean cross-entropy."""
        p = self.p
        dl = (sigmoid(f["logit"]) - y) / len(y)
        dz = dl[:, None] * p["c"]
        da = (dz[bag] * f["h"]).sum(1)
        ds = f["a"] * (da - np.add.reduceat(f["a"] * da, f["starts"])[bag])
        dt, dg = ds[:, None] * f["g"] * p["w"] * (1 - f["t"] ** 2), ds[:, None] * f["t"] * p["w"] * f["g"] * (1 - f["g"])
        dh = (f["a"][:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
        return {"E": f["x"].T @ dh, "e": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ ds, "c": f["z"].T @ dl, "b": np.array([dl.sum()])}

    def score(self, texts: list[str]) -> np.ndarray:
        """The probability of label 1 for each text."""
        out = np.zeros(len(texts))
        for first, part in steps(texts):
            x, bag = passages(part)
            out[first : first + len(part)] = sigmoid(self.forward(x, bag, len(part))["logit"])
        return out


def fit(sample: list[tuple[str, int]], epochs: int = EPOCHS, rate: float = RATE, decay: float = DECAY) -> Model:
    """A model of the labelled texts. Without texts of both labels the score is the smoothed base rate."""
    labels = np.array([y for _, y in sample], float)
    if not sample or labels.min() == labels.max():
        model = Model(np.zeros(N_FEATURES), np.ones(N_FEATURES))
        base = (labels.sum() + 0.5) / (len(labels) + 1)
        model.p["c"][:] = 0
        model.p["b"][:] = np.log(base / (1 - base))
        return model
    x, bag, done = [], [], 0
    for _, part in steps([t for t, _ in sample]):
        f, b = passages(part)
        x.append(f), bag.append(b + done)
        done += len(part)
    x, bag = np.concatenate(x), np.concatenate(bag)
    model = Model(x.mean(0), x.std(0) + 1e-3)
    model.p["b"][:] = np.log((labels.mean()) / (1 - labels.mean()))
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(w) for k, w in model.p.items()}
    for step in range(1, epochs + 1):
        grad = model.gradient(model.forward(x, bag, len(labels)), bag, labels)
        for k, g in grad.items():
            g = g + decay * model.p[k] * (k not in "eb")
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            model.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.score([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def score_documents(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, score)`` for every row and whole text; null counts as empty, which is a bag with one empty passage."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(_scored(shared), "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, bound: int = BOUND, threshold: float = 0.7, modulus: int = 4, held_out: int = 2) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Extra columns are ignored; rows may repeat."""
    model = fit(labelled_sample(docs, labels, "quality", bound, modulus, held_out))
    held = F.coalesce(remainder(F.col("doc_id"), modulus) == held_out, F.lit(False))
    return score_documents(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
