"""Toxicity: a lexicon's Levenshtein automaton finds terms and their misspellings, and the context weighs them.

The lexicon is learned from labelled rows: words and word beginnings (stems) that are far more frequent
in toxic texts, chosen greedily; of entries that begin alike each has to explain texts that the others
don't. Words form a trie;
the automaton that accepts every string within the allowed edits of a trie word is the intersection of
the Levenshtein automata with the trie, made deterministic as it is used. A word is read once, and most
words leave the automaton after a few characters. Each hit is weighed by its context window: less within
quotation marks or after words of report, more beside words of address. A logistic model over the
weighed hits gives the score.

Scale: fitting uses at most ``bound`` labelled rows; scoring is one pass over the documents without a
shuffle. What is broadcast is the model: a lexicon of words of those rows, which bound it.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .logistic import fit as fit_logistic
from .logistic import sigmoid
from .sampling import labelled_sample, remainder

BOUND, LEAST_EVIDENCE = 4000, 9.0
#: Words whose hits a task remembers.
REMEMBERED = 150_000
#: Runs of letters and digits, with the signs that stand for letters inside them.
WORD = re.compile(r"[^\W_]+(?:[!@$*][^\W_]+)*")
#: Signs and digits that stand for letters in disguised words.
DISGUISES = str.maketrans({"4": "a", "@": "a", "3": "e", "1": "i", "!": "i", "0": "o", "5": "s", "$": "s", "7": "t"})
#: Words of report and of address in the languages at hand.
REPORT = frozenset("said says wrote writes quoted quote called term word sagte schrieb nannte zitat wort dit écrit appelé mot dijo escribió llamó palabra".split())
ADDRESS = frozenset("you your yourself du dich dir dein ihr tu toi vous ton votre usted te ti tus".split())
QUOTES = {"“": "”", "«": "»", "„": "“"}
WINDOW = 48
#: A misspelling must not be a word of this many clean texts of the sample, and of no more toxic ones.
CLEAN_TEXTS = 2


def allowed_edits(length: int) -> int:
    """Edits that a term of this length may have."""
    return 0 if length < 4 else 1 if length < 8 else 2


class FuzzyTrie:
    """Deterministic automaton of the strings within the allowed edits of a set of words."""

    #: Transitions kept; beyond it they are forgotten and made again as needed.
    KEEP = 50_000

    def __init__(self, words: dict[str, float]):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        for w in sorted(words):
            node = 0
            for ch in w:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                node = self.children[node][ch]
            self.term[node] = w
        # edits that some word below may still use
        self.most = [0] * len(self.children)
        for node in range(len(self.children) - 1, -1, -1):
            own = allowed_edits(len(self.term[node])) if self.term[node] else 0
            self.most[node] = max([own, *(self.most[c] for c in self.children[node].values())])
        self.alphabet = {ch for kids in self.children for ch in kids}
        self._reset()

    def _reset(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.sets: list[dict[int, int]] = []
        self.steps: list[dict[str, int]] = []
        self.accept: list[tuple[str, int] | None] = []
        self.count = 0
        self.start = self._state({0: 0})

    def _state(self, reached: dict[int, int]) -> int:
        """The state of (node: edits used), with trie letters skipped at an edit each."""
        reached = dict(reached)
        open_ = sorted(reached)
        while open_:
            node = open_.pop()
            for child in self.children[node].values():
                used = reached[node] + 1
                if used <= self.most[child] and used < reached.get(child, 99):
                    reached[child] = used
                    open_.append(child)
        key = frozenset(reached.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(reached)
            self.steps.append({})
            best = min(((used, t) for n, used in reached.items() if (t := self.term[n]) and used <= allowed_edits(len(t))), default=None)
            self.accept.append((best[1], best[0]) if best else None)
        return self.states[key]

    def _step(self, state: int, ch: str) -> int:
        out: dict[int, int] = {}
        for node, used in self.sets[state].items():
            for letter, child in self.children[node].items():
                cost = used + (letter != ch)
                if cost <= self.most[child] and cost < out.get(child, 99):
                    out[child] = cost
            if used + 1 <= self.most[node] and used + 1 < out.get(node, 99):
                out[node] = used + 1
        return self._state(out) if out else -1

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term within its allowed edits, and the edits; ties go to the lesser term."""
        if self.count > self.KEEP:
            self._reset()
        state = self.start
        for ch in word:
            known = ch if ch in self.alphabet else ""
            nxt = self.steps[state].get(known)
            if nxt is None:
                nxt = self.steps[state][known] = self._step(state, known)
                self.count += 1
            if nxt < 0:
                return None
            state = nxt
        return self.accept[state]


_MEMORY: dict[str, tuple[FuzzyTrie, dict]] = {}


@dataclass
class Model:
    """A fitted lexicon with the weights of its features."""

    words: dict[str, float]
    stems: dict[str, float]
    #: What misspellings are held against: the words, and the stems' words with the stems' weights.
    fuzzy: dict[str, float]
    harmless: frozenset[str]
    weights: np.ndarray
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def _memory(self) -> tuple[FuzzyTrie, dict[str, tuple[int, float] | None]]:
        """The automaton and the words seen. A process keeps those of the last model only, though old models may linger in it."""
        if self.name not in _MEMORY:
            _MEMORY.clear()
            _MEMORY[self.name] = FuzzyTrie(self.fuzzy), {}
        return _MEMORY[self.name]

    def _look_up(self, word: str) -> tuple[int, float] | None:
        if word in self.words:
            return 0, self.words[word]
        if stem := self._stem(word):
            return 1, self.stems[stem]
        if word in self.harmless:
            return None
        plain = word.translate(DISGUISES) if not word.isalpha() and any(c.isalpha() for c in word) else word
        if plain != word:
            if plain in self.words:
                return 2, self.words[plain]
            if stem := self._stem(plain):
                return 1, self.stems[stem]
        if len(word) >= 3 and (hit := self._memory()[0].match(plain)):
            return 2 if hit[0] in self.words else 1, self.fuzzy[hit[0]] / (1 + hit[1])
        return None

    def _stem(self, word: str) -> str | None:
        return next((word[:k] for k in range(3, min(8, len(word) - 1) + 1) if word[:k] in self.stems), None)

    def hits(self, words: set[str]) -> dict[str, tuple[int, float]]:
        """(0 term, 1 stem or a misspelling of its words, 2 misspelling of a term; weight) of those of the lower-case words that are hits."""
        known = self._memory()[1]
        if len(known) > REMEMBERED:
            known.clear()
        for word in words:
            if word not in known:
                known[word] = self._look_up(word)
        return {w: h for w in words if (h := known[w]) is not None}

    def features(self, text: str) -> np.ndarray:
        """Weighed hits by kind, their density and number of different ones, of the whole text."""
        low = text.lower()
        words = WORD.findall(low)
        hits = self.hits(set(words))
        sums, kinds = np.zeros(3), np.zeros(3)
        if hits:
            for m in WORD.finditer(low):
                if (h := hits.get(m[0])) is not None:
                    sums[h[0]] += h[1] * context_weight(low, m.start(), m.end())
            for kind, _ in hits.values():
                kinds[kind] += 1
        return np.concatenate([np.log1p(sums), sums / math.sqrt(len(words) + 20), np.log1p(kinds)])

    def score(self, text: str) -> float:
        return float(sigmoid(self.features(text) @ self.weights[:-1] + self.weights[-1]))


def context_weight(low: str, start: int, end: int) -> float:
    """How much of a hit counts as abuse: 0.25 quoted or reported, 1.25 beside words of address, else 1."""
    before, after = low[max(0, start - WINDOW) : start], low[end : end + WINDOW]
    quoted = before.count('"') % 2 == 1 and '"' in after
    quoted = quoted or any(before.rfind(a) > before.rfind(b) and b in after for a, b in QUOTES.items())
    near = set(WORD.findall(before)) | set(WORD.findall(after))
    if quoted or REPORT & set(WORD.findall(before)[-4:]):
        return 0.25
    return 1.25 if ADDRESS & near else 1.0


def _evidence(toxic: int, clean: int, base: float) -> float:
    """Log-likelihood ratio of the counts against the base rate; 0 if not more frequent in toxic texts."""
    n = toxic + clean
    if not n or toxic / n <= base:
        return 0.0
    p = toxic / n
    return toxic * math.log(p / base) + (clean * math.log((1 - p) / (1 - base)) if clean else 0.0)


def learn_lexicon(sample: list[tuple[str, int]]) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems with their weights. An entry counts by the texts that have it, or have it twice."""
    base = min(0.9, max(0.02, sum(y for _, y in sample) / max(1, len(sample))))
    seen: set[str] = set()
    holders: dict[tuple, set[int]] = defaultdict(set)
    clean: Counter = Counter()

    def entries(text: str) -> set[tuple]:
        counts = Counter(w for w in WORD.findall(text.lower()) if len(w) > 2)
        stems: Counter = Counter()
        for w, n in counts.items():
            for k in range(3, min(8, len(w) - 1) + 1):
                stems[w[:k]] += n
        return {("w", w, 1) for w in counts} | {("s", s, n) for s, c in stems.items() for n in (1, 2, 3) if c >= n}

    toxic = [t for t, y in sample if y]
    for i, t in enumerate(toxic):
        if t not in seen:
            seen.add(t)
            for e in entries(t):
                holders[e].add(i)
    holders = {e: h for e, h in holders.items() if len(h) >= 3}
    for t, y in sample:
        if not y and t not in seen:
            seen.add(t)
            clean.update(e for e in entries(t) if e in holders)
    words: dict[str, float] = {}
    stems: dict[str, float] = {}
    explained: dict[tuple, set[int]] = defaultdict(set)
    rank = {e: _evidence(len(h), clean[e], base) for e, h in holders.items()}
    rank = {e: v for e, v in rank.items() if v >= LEAST_EVIDENCE}
    while rank:
        # whole words first where they explain as much
        best = max(rank, key=lambda e: (round(rank[e], 6), e[0] == "w", -e[2], e[1]))
        n1, n0 = len(holders[best]), clean[best]
        weight = math.log((n1 + 0.5) / (n0 + 0.5)) - math.log(base / (1 - base))
        into = words if best[0] == "w" else stems
        into[best[1]] = max(into.get(best[1], 0), round(max(weight, 0.1), 4))
        del rank[best]
        # what entries of the same family still explain
        for e in [e for e in rank if e[1].startswith(best[1]) or best[1].startswith(e[1])]:
            explained[e] |= holders[best]
            rank[e] = _evidence(len(holders[e] - explained[e]), clean[e], base)
            if rank[e] < LEAST_EVIDENCE:
                del rank[e]
    return words, stems


def fit(sample: list[tuple[str, int]]) -> Model:
    """A model of the labelled texts. Without toxic or without clean texts the score is the base rate."""
    rate = (sum(y for _, y in sample) + 0.5) / (len(sample) + 1)
    flat = Model({}, {}, {}, frozenset(), np.array([0.0] * 9 + [math.log(rate / (1 - rate))]))
    if not 0 < sum(y for _, y in sample) < len(sample):
        return flat
    words, stems = learn_lexicon(sample)
    toxic, clean = Counter(), Counter()
    for text, y in sample:
        (toxic if y else clean).update(set(WORD.findall(text.lower())))
    # a stem's words: those that toxic texts have more often than clean ones
    family = {w: stems[w[:k]] for w, n in toxic.items() for k in range(3, min(8, len(w) - 1) + 1) if w[:k] in stems and n > clean[w]}
    fuzzy = family | words
    trie = FuzzyTrie(fuzzy)
    harmless = frozenset(w for w, n in clean.items() if n >= CLEAN_TEXTS and n >= toxic[w] and w not in fuzzy and trie.match(w))
    model = Model(words, stems, fuzzy, harmless, flat.weights)
    x = np.array([model.features(t) for t, _ in sample])
    # misspellings are too rare among the labels to be weighed on their own: they take the terms' weights
    terms = x.copy()
    terms[:, 0::3] += terms[:, 2::3]
    terms[:, 2::3] = 0
    model.weights = fit_logistic(terms, np.array([y for _, y in sample], float), ridge=0.3)
    model.weights[2:9:3] = model.weights[0:9:3]
    return model


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = model.value
        for batch in batches:
            scores = [fitted.score(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def fitted_model(docs: DataFrame, labels: DataFrame, bound: int = BOUND, modulus: int = 5, held_out: int = 0) -> Model:
    """The model of at most ``bound`` labelled rows outside the held-out remainder."""
    return fit(labelled_sample(docs, labels, "toxic", bound, modulus, held_out))


def score_documents(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, score)`` for every row and whole text; null counts as empty, and an empty text gets the score without hits."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return plain.mapInArrow(_scored(shared), "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, bound: int = BOUND, threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Extra columns are ignored; rows may repeat."""
    scored = score_documents(docs, fitted_model(docs, labels, bound))
    held = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def not_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", bound: int = BOUND, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` scored below the threshold, with their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted_model(docs, labels, bound))
    at = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            mask = [model.score(t.as_py() or "") < threshold for t in batch.column(at)]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
