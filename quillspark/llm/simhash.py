"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits meet in at least one value within half the radius of both.
So every fingerprint stands for all its variants within ``radius // 2`` bits, and fingerprints that
have a variant in common are linked. By the triangle inequality each such pair is within the radius;
the pairs are verified all the same.

The variants are made in two steps that keep the shuffle small: a fingerprint is sent once to each
*variant prefix* within half the radius (22 rows for 6 bits, 211 for 20), and the receiving task
enumerates the variants that begin with that prefix (2,081 in all). The prefixes are as long as the
number of fingerprints asks, so that one holds ``FULL`` on average. Rows are counted per prefix first:
where there are more than ``LIMIT``, the prefix is dealt anew as longer ones, and so on, so a task never
holds more than that many fingerprints at a time, however alike they are. Fingerprints that share
variants are joined in a forest per prefix (never all pairs), and the forests in distributed components.
Equal fingerprints are one node from the start, so a group of copies costs one row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components

#: Variants that a task holds at a time.
CHUNK = 1_000_000
#: Fingerprints of a prefix: on average at most, and the number beyond which the prefix is dealt anew with ``STEP`` more bits.
FULL, LIMIT, STEP = 100_000, 500_000, 8


def words_of(text: str | None) -> list[bytes]:
    """The words of the text in UTF-8, A-Z in lower case, split at space and U+0009 to U+000D."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], size: int) -> list[bytes]:
    """Runs of ``size`` words with repeats; fewer words are one shingle, no words none."""
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [joined[a:b] for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)]


def fingerprint(features: Iterable[bytes], seed: int = 42, bits: int = 64) -> int:
    """A bit is 1 if it is set in over half of the features' XXH64 values; 0 without features."""
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(x, seed) for x in features], dtype="<u8"), bits)


def majority(values: np.ndarray, bits: int = 64) -> int:
    """The lowest ``bits`` bits that are set in over half of the 64-bit values; 0 without values."""
    if not len(values):
        return 0
    counts = np.zeros(64, np.int64)
    for k in range(0, len(values), 1 << 16):
        counts += np.unpackbits(values[k : k + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > len(values), bitorder="little").tobytes(), "little") & ((1 << bits) - 1)


def _fingerprints(size: int, seeds: tuple[int, ...], bits: int, distinct: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            features = (shingles(words_of(t.as_py()), size) for t in texts)
            found = [[fingerprint(f, s, bits) for s in seeds] for f in (set(x) if distinct else x for x in features)]
            values = np.array(found, dtype=np.uint64).reshape(-1, len(seeds)).view(np.int64)
            for k in range(len(seeds)):
                yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(np.full(len(ids), k, np.int32)), pa.array(np.ascontiguousarray(values[:, k]))], names=["doc_id", "view", "fp"])

    return run


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle_words: int = 4, seeds: tuple[int, ...] = (42,), bits: int = 64, distinct: bool = False) -> DataFrame:
    """``(doc_id, view, fp)`` per document and seed, over whole texts; null and blank texts have fingerprint 0.

    ``distinct``: shingles count once instead of with repeats. ``fp`` is the unsigned fingerprint in a signed long. A repeated doc_id has a row for each of its rows.
    """
    plain = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return plain.mapInArrow(_fingerprints(shingle_words, tuple(seeds), bits, distinct), "doc_id long, view int, fp long")


@cache
def masks(bits: int, most: int) -> np.ndarray:
    """All masks over ``bits`` bits with at most ``most`` set, fewest first."""
    return np.array([sum(1 << b for b in c) for n in range(most + 1) for c in combinations(range(bits), n)], dtype=np.uint64)


#: A key is the view, the prefix's length and the prefix: 4, 6 and 53 bits.
_LENGTH, _VIEW = 53, 59


def _key(view: np.ndarray, length: int, value: np.ndarray) -> np.ndarray:
    return (view.astype(np.int64) << _VIEW) | (length << _LENGTH) | value.view(np.int64)


def _dealt(view: np.ndarray, fp: np.ndarray, bits: int, prefix: int, half: int, hot: list[np.ndarray], level: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(keys, rows)``: the prefixes to which each fingerprint goes. Those in ``hot`` (sorted keys of each level) are left for longer ones.

    ``level``: only the keys of that level, whether hot or not.
    """
    rows, value, owed, length = np.arange(len(fp)), np.zeros(len(fp), np.uint64), np.full(len(fp), half), 0
    for k in range(len(hot) + 1):
        step = prefix if k == 0 else STEP
        following = (fp[rows] >> np.uint64(bits - length - step)) & np.uint64((1 << step) - 1)
        parts = []
        for o in np.unique(owed):
            at = np.flatnonzero(owed == o)
            flips = masks(step, int(o))
            wide = ((value[at] << np.uint64(step)) | following[at])[:, None] ^ flips[None, :]
            left = np.broadcast_to(o - np.bitwise_count(flips).astype(np.int64), wide.shape)
            parts.append((np.repeat(rows[at], len(flips)), wide.ravel(), left.ravel()))
        if not parts:
            return
        rows, value, owed = (np.concatenate(x) for x in zip(*parts, strict=True))
        length += step
        keys = _key(view[rows], length, value)
        again = np.isin(keys, hot[k]) if k < len(hot) else np.zeros(len(keys), bool)
        if level is None or level == k:
            go = ~again if level is None else slice(None)
            yield keys[go], rows[go]
        rows, value, owed = rows[again], value[again], owed[again]


def _to_prefixes(bits: int, prefix: int, half: int, hot: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                view, fp = part.column(0).to_numpy(), part.column(1).to_numpy().view(np.uint64)
                for keys, rows in _dealt(view, fp, bits, prefix, half, hot):
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[rows].view(np.int64))], names=["prefix", "fp"])

    return run


def _hot_prefixes(distinct: DataFrame, bits: int, prefix: int, half: int, limit: int) -> list[np.ndarray]:
    """Per level the sorted keys with more rows than ``limit``. Only counts are shuffled; there are less than rows / limit such keys."""
    hot: list[np.ndarray] = []
    while prefix + (len(hot) + 1) * STEP <= min(_LENGTH, bits - STEP):

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                view, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
                for keys, _ in _dealt(view, fp, bits, prefix, half, hot, level=len(hot)):
                    key, n = np.unique(keys, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])

        sums = distinct.select("view", "fp").mapInArrow(counted, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        full = sorted(r["key"] for r in sums.where(F.col("n") > limit).select("key").collect())
        if not full:
            break
        hot.append(np.array(full, np.int64))
    return hot


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least label reachable of each of n nodes, over the edges (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(before, label):
            return label


def _meet(fp: np.ndarray, owed: np.ndarray, fixed: np.ndarray, free: int, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between fingerprints that have a variant in common.

    ``owed``: flips left for the lowest ``free`` bits; ``fixed``: what identifies the prefix, the same for rows that can meet.
    """
    if len(fp) < 2:
        return
    counts = np.array([len(masks(free, int(o))) for o in range(int(owed.max()) + 1)])
    if counts[owed].sum() > limit and free > 4:
        # divide by the next four bits of the variants
        step = 4
        nibble = (fp >> np.uint64(free - step)) & np.uint64(15)
        for value in range(16):
            left = owed - np.bitwise_count(nibble ^ np.uint64(value)).astype(np.int64)
            rows = np.flatnonzero(left >= 0)
            for a, b in _meet(fp[rows], left[rows], fixed[rows], free - step, limit):
                yield rows[a], rows[b]
        return
    low = fp & np.uint64((1 << free) - 1)
    variant, source = [], []
    for o in range(int(owed.max()) + 1):
        rows = np.flatnonzero(owed == o)
        if len(rows):
            flips = masks(free, o)
            variant.append(((fixed[rows] << np.uint64(free)) | low[rows])[:, None] ^ flips[None, :])
            source.append(np.repeat(rows, len(flips)))
    variant, source = np.concatenate([v.ravel() for v in variant]), np.concatenate(source)
    ordered = np.sort(variant)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return
    at = np.minimum(np.searchsorted(twice, variant), len(twice) - 1)
    hit = np.flatnonzero(twice[at] == variant)
    at, source = at[hit], source[hit]
    order = np.lexsort((source, at))
    at, source = at[order], source[order]
    first = np.concatenate(([True], at[1:] != at[:-1]))
    head = source[np.flatnonzero(first)[np.cumsum(first) - 1]]
    apart = head != source
    yield head[apart], source[apart]


def _linked(bits: int, radius: int, limit: int):
    half = radius // 2

    def links(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        # fingerprints of one view and length of prefix can meet
        kind = key >> _LENGTH
        for k in np.unique(kind):
            mine = np.flatnonzero(kind == k)
            view, free = int(k) >> (_VIEW - _LENGTH), bits - (int(k) & ((1 << (_VIEW - _LENGTH)) - 1))
            own, f = key[mine] & ((1 << _LENGTH) - 1), fp[mine]
            owed = half - np.bitwise_count((f >> np.uint64(free)) ^ own.view(np.uint64)).astype(np.int64)
            found = list(_meet(f, owed, np.unique(own, return_inverse=True)[1].astype(np.uint64), free, limit))
            if not found:
                continue
            a, b = np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
            near = np.bitwise_count(f[a] ^ f[b]) <= radius  # verified, though the triangle inequality has it so
            a, b = a[near], b[near]
            # one node for each fingerprint, whatever the prefixes it came by
            node_fp, node = np.unique(f if bits == 64 else f | np.uint64(view << bits), return_inverse=True)
            label = _forest(len(node_fp), node[a], node[b])
            child = np.flatnonzero(label != np.arange(len(node_fp)))
            if len(child):
                yield pa.RecordBatch.from_arrays([pa.array(node_fp[child].view(np.int64)), pa.array(node_fp[label[child]].view(np.int64))], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held, most = 0, max(1, limit // 16)
        for batch in batches:
            key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if not len(key):
                continue
            parts.append((key, fp))
            held += len(key)
            if held > most and parts[0][0][0] != key[-1]:
                # close what is held at the last change of prefix
                all_key, all_fp = (np.concatenate(x) for x in zip(*parts, strict=True))
                cut = int(np.searchsorted(all_key, all_key[-1]))
                parts, held = [(all_key[cut:].copy(), all_fp[cut:].copy())], len(all_key) - cut
                yield from links(all_key[:cut], all_fp[:cut])
        if held:
            yield from links(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    return run


def fingerprint_links(distinct: DataFrame, radius: int = 4, bits: int = 64, prefix: int | None = None, chunk: int = CHUNK, full: int = FULL, limit: int = LIMIT) -> DataFrame:
    """Links ``(u, v)`` that span the same components as all pairs of fingerprints within ``radius`` bits.

    ``distinct``: (view int below 16, fp long) without repeats, a written table; fingerprints meet within a view
    only. With fewer than 64 bits, ``u`` and ``v`` carry the view above the fingerprint; with 64 there is one view.
    Each link is a pair that a chain of verified pairs connects. ``prefix``, ``full`` and ``limit`` divide the work;
    they change no result.
    """
    half = radius // 2
    if prefix is None:
        n = distinct.count()
        prefix = next((p for p in range(6, 21) if n * len(masks(p, half)) <= full << p), 20)
    if radius % 2 or not 0 < prefix < bits <= 64:
        raise ValueError("the radius is even; the prefix is shorter than the fingerprint")
    hot = _hot_prefixes(distinct, bits, prefix, half, limit)
    sent = distinct.select("view", "fp").mapInArrow(_to_prefixes(bits, prefix, half, hot), "prefix long, fp long")
    dealt = sent.repartition("prefix").sortWithinPartitions("prefix")
    return dealt.mapInArrow(_linked(bits, radius, chunk), "u long, v long")


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 4, shingle_words: int = 4, seed: int = 42) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable over links).

    Null, empty and blank texts have fingerprint 0 and link like any other. Copies share a fingerprint
    and are expanded only in the result. Extra columns are ignored; an empty table gives an empty result.
    """
    prints = written(fingerprints(docs, doc_id, text, shingle_words, (seed,)).select("doc_id", "fp"), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    links = fingerprint_links(nodes.select(F.lit(0).alias("view"), "fp"), radius)
    roots = components(links)
    member = nodes.join(roots, nodes["fp"] == roots["u"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    member = written(member, "members")
    lowest = member.groupBy("root").agg(F.min("least").alias("component_id"))
    labelled = member.join(lowest, "root").select("fp", "component_id")
    return prints.join(labelled, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
