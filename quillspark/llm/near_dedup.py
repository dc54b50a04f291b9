"""Near-duplicate removal: SimHash groups, completed and verified by the texts' shingles.

What counts is the similarity (Jaccard) of the sets of five-word shingles: 0.8 or more. The groups are the
components of all such pairs. They are found in four steps.

1. Texts with equal shingle sets are one from here on (a 128-bit digest of the set).
2. Ball hashing (see ``simhash``) of a fingerprint of the *distinct words* gives groups of look-alike texts: a
   changed word moves one feature there but five of the shingles. Each member is paired with its group's least id.
3. SimHash misses pairs, most of all where a passage was added or cut off. A prefix filter is exact: in any
   total order of the shingles, two sets of similarity s share one among the first ``n - ceil(s n) + 1`` of each.
   Rare shingles come first, by their counts over all documents (the order costs or saves work but never a pair).
   Each text is paired with the least id of each prefix shingle that it shares.
   The pairs of steps 2 and 3 are verified, and those that hold make groups.
4. Prefix shingles whose texts are in several groups by then pair all texts of the lesser groups with those of the
   others. Copies are in one group already, so a large group of copies makes no pairs. Positions in the order and
   sizes rule out most of the rest before verification: an exact bound on what two texts can have in common.

Scale: texts are read where they lie; what is shuffled are the shingles' hashes with each task's counts, prefix
shingles packed by their hash's first bits (an eighth of the text or so), the few of them that repeat, and, of texts
in some pair only, packed shingle sets. A
leader's set is repeated once for every ``BLOCK`` of its pairs, so a large group has no hot key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import within, without, written
from .components import components
from .simhash import fingerprint_links, majority, words_of

#: Shingles that are sent to every task, to come last in the order.
LISTED = 200_000
#: Prefix shingles of a bucket on average, and those that a task holds before it hands them on.
BUCKET, HELD = 250_000, 200_000
#: Pairs for which a leader's set is sent once.
BLOCK = 256
#: The bits of a shingle's hash that verification compares.
KEPT = 40

_FACTORS = np.random.Generator(np.random.PCG64(7)).integers(1 << 63, size=64, dtype=np.uint64) | np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word of the text, in order."""
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w, 5) for w in words_of(text)], dtype=np.uint64)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The sorted, distinct hashes of all runs of ``size`` words; fewer words are one run, no words none."""
    n = len(words)
    if n <= size:
        return _mixed((words * _FACTORS[:n]).sum(keepdims=True) + np.uint64(n)) if n else words
    total = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        total += words[k : n - size + 1 + k] * _FACTORS[k % len(_FACTORS)]
    return np.unique(_mixed(total))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """``(doc_id, word hashes)`` of each row of (doc_id, text)."""
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield i, word_hashes(t.as_py())


def _sketched(size: int):
    """Per text the size of its shingle set, a 128-bit digest of it, and the fingerprint of its distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for i, words in _texts(batches):
            h = shingle_hashes(words, size)
            digest = np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), np.int64)
            rows.append((i, len(h), *digest.tolist(), int(np.uint64(majority(_mixed(np.unique(words)))).view(np.int64))))
            if len(rows) == 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "size", "digest", "digest2", "fp"])
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "size", "digest", "digest2", "fp"])

    return run


def _every_shingle(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words in _texts(batches):
            yield pa.RecordBatch.from_arrays([pa.array(shingle_hashes(words, size).view(np.int64))], names=["token"])

    return run


def _common(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of more than one document, sorted, with their counts over all: the most frequent ones, ``LISTED`` at most."""
    counted = written(texts.mapInArrow(_every_shingle(size), "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "near-common")
    least, total = 2, 0
    for n, many in sorted(((r["n"], r["many"]) for r in counted.groupBy("n").agg(F.count(F.lit(1)).alias("many")).collect()), reverse=True):
        total += many
        if total > LISTED:
            least = n + 1
            break
    rows = counted.where(F.col("n") >= least).toArrow()
    keys, counts = rows.column("token").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], counts[order]


def _prefixes(size: int, similarity: float, shift: int, common):
    """Packed prefix rows ``(bucket, packed)``. Listed shingles are known to repeat: they go to buckets below 0, which need no look-up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = common.value
        parts: list[tuple[np.ndarray, ...]] = []
        held = made = 0

        def out() -> pa.RecordBatch:
            token, listed = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            n = [len(p[0]) for p in parts]
            place = np.concatenate([np.arange(k, dtype=np.int32) for k in n])
            ids, sizes = (np.repeat(np.array([p[k] for p in parts], np.int64), n) for k in (2, 3))
            bucket = np.where(listed, -1 - (made & 0xFFFF), (token >> np.uint64(shift)).view(np.int64) if shift < 64 else 0)
            order = np.lexsort((token, bucket))
            cuts = np.flatnonzero(np.diff(bucket[order])) + 1
            groups = np.split(order, cuts)
            packed = [b"".join((token[g].tobytes(), ids[g].tobytes(), sizes[g].astype(np.int32).tobytes(), place[g].tobytes())) for g in groups]
            return pa.RecordBatch.from_arrays([pa.array(bucket[[g[0] for g in groups]]), pa.array(packed, pa.binary())], names=["bucket", "packed"])

        for i, words in _texts(batches):
            h = shingle_hashes(words, size)
            n = len(h)
            if not n:
                continue
            count = np.zeros(n, np.int64)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                count = np.where(keys[at] == h, counts[at], 0)
            order = np.lexsort((h, count))[: n - math.ceil(similarity * n - 1e-9) + 1]
            parts.append((h[order], count[order] > 0, i, n))
            held += len(order)
            if held >= HELD:
                yield out()
                parts, held, made = [], 0, made + 1
        if parts:
            yield out()

    return run


def _unpacked(packed: list[bytes]) -> list[np.ndarray]:
    """Tokens, ids, sizes and places of packed prefix rows."""
    columns: list[list[np.ndarray]] = [[], [], [], []]
    for p in packed:
        n = len(p) // 24
        for k, (kind, at) in enumerate(((np.int64, 0), (np.int64, 8), (np.int32, 16), (np.int32, 20))):
            columns[k].append(np.frombuffer(p, kind, n, at * n))
    return [np.concatenate(c) for c in columns]


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The prefix rows whose token is in two texts or more: one bucket after another."""

    def out(bucket: int, packed: list[bytes]) -> pa.RecordBatch:
        token, ids, sizes, places = _unpacked(packed)
        if bucket >= 0:
            ordered = np.sort(token)
            twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
            keep = np.flatnonzero(np.isin(token, twice))
            token, ids, sizes, places = token[keep], ids[keep], sizes[keep], places[keep]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (token, ids, sizes, places)], names=["token", "doc_id", "size", "place"])

    now, held = None, []
    for batch in batches:
        for bucket, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if held and (bucket != now or bucket < 0):
                yield out(now, held)
                held = []
            now = bucket
            held.append(packed.as_py())
    if held:
        yield out(now, held)


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, words in _texts(batches):
            h = np.unique(shingle_hashes(words, size) >> np.uint64(64 - KEPT))
            packed = np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : KEPT // 8]).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([packed], pa.binary())], names=["doc_id", "shingles"])

    return run


def _set(packed: bytes) -> np.ndarray:
    wide = np.zeros((len(packed) * 8 // KEPT, 8), np.uint8)
    wide[:, : KEPT // 8] = np.frombuffer(packed, np.uint8).reshape(-1, KEPT // 8)
    return wide.view("<u8").ravel()


def _similar(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yes = []
        for a, b in zip(batch.column(2), batch.column(3), strict=True):
            x, y = _set(a.as_py()), _set(b.as_py())
            both = len(np.intersect1d(x, y, assume_unique=True))
            yes.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
        yield batch.select([0, 1]).filter(pa.array(yes, pa.bool_()))


def _verified(texts: DataFrame, pairs: DataFrame, size: int, similarity: float) -> DataFrame:
    """Those of the pairs ``(doc_id, leader)`` (a written table) that are similar, as ``(u, v)``."""
    wanted = pairs.select("doc_id").union(pairs.select("leader"))
    sets = written(within(texts, [F.col("doc_id")], wanted).mapInArrow(_sets(size), "doc_id long, shingles binary"), "near-sets")
    blocks = written(pairs.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "near-blocks")
    dealt = pairs.join(blocks, "leader").select("doc_id", "leader", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("block"))
    mine = dealt.join(sets, "doc_id").select("doc_id", "leader", "block", F.col("shingles").alias("mine"))
    other = sets.withColumnRenamed("doc_id", "leader").join(blocks, "leader").select("leader", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("shingles").alias("other"))
    both = mine.join(other, ["leader", "block"]).select("doc_id", "leader", "mine", "other")
    found = both.mapInArrow(lambda b: _similar(b, similarity), "doc_id long, leader long")
    return written(found.select(F.greatest("doc_id", "leader").alias("u"), F.least("doc_id", "leader").alias("v")), "near-found")


def _fits(similarity: float) -> Column:
    """Whether two texts a and b that share a shingle at their places, and none before, can be similar."""
    larger, smaller = F.greatest("a.size", "b.size"), F.least("a.size", "b.size")
    rest = F.least(F.col("a.size") - F.col("a.place"), F.col("b.size") - F.col("b.place"))
    return (smaller >= similarity * larger - 1e-9) & (rest >= similarity / (1 + similarity) * (larger + smaller) - 1e-9)


def _lookalikes(reps: DataFrame, radius: int, similarity: float) -> DataFrame:
    """Pairs ``(doc_id, leader)`` within the groups of ball hashing, each member with its group's least id."""
    nodes = written(reps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "near-nodes")
    roots = written(components(fingerprint_links(nodes.select(F.lit(0).alias("view"), "fp"), radius)), "near-roots")
    grouped = nodes.join(roots, nodes["fp"] == roots["u"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("group"))
    crowded = grouped.groupBy("group").agg(F.min("least").alias("leader"), F.sum("n").alias("many")).where("many > 1").select("group", "leader")
    led = written(grouped.join(crowded, "group").select("fp", "leader"), "near-led")
    return reps.join(led, "fp").where("doc_id <> leader").select("doc_id", "leader")


def near_links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle_words: int = 5, similarity: float = 0.8, radius: int = 4) -> DataFrame:
    """Verified links ``(u, v)`` between ids, u > v, whose components are those of all pairs with the similarity.

    Blank texts (no words) are near-duplicates of each other. Rows that share an id are one document, which
    is compared by its least text; rows with a null id take no part. Runs jobs at once.
    """
    size = shingle_words
    plain = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).where("doc_id is not null")
    twice = written(plain.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "near-repeated")
    if twice.isEmpty():
        texts = plain
    else:
        texts = without(plain, [F.col("doc_id")], twice).unionByName(within(plain, [F.col("doc_id")], twice).groupBy("doc_id").agg(F.min("text").alias("text")))
    sketch = written(texts.mapInArrow(_sketched(size), "doc_id long, size long, digest long, digest2 long, fp long"), "near-sketch")
    classes = written(sketch.groupBy("digest", "digest2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1"), "near-classes")
    equal = written(sketch.join(classes, ["digest", "digest2"]).where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")), "near-equal")
    reps = written(without(sketch.select("doc_id", "size", "fp"), [F.col("doc_id")], equal.select("u")), "near-reps")
    totals = reps.agg(F.sum(F.floor("size") * (1 - similarity) + 1).alias("rows")).first()

    common = docs.sparkSession.sparkContext.broadcast(_common(texts, size))
    bits = next((b for b in range(17) if (totals["rows"] or 0) <= BUCKET << b), 17)
    own = texts if equal.isEmpty() else without(texts, [F.col("doc_id")], equal.select("u"))
    packed = own.mapInArrow(_prefixes(size, similarity, 64 - bits, common), "bucket long, packed binary")
    met = packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_repeated, "token long, doc_id long, size int, place int")
    met = written(met, "near-met")

    # steps 2 and 3
    least = met.groupBy("token").agg(F.min(F.struct("doc_id", "size", "place")).alias("b")).select("token", "b.*")
    star = met.alias("a").join(least.alias("b"), "token").where((F.col("a.doc_id") != F.col("b.doc_id")) & _fits(similarity))
    star = star.select(F.col("a.doc_id").alias("doc_id"), F.col("b.doc_id").alias("leader"))
    pairs = written(_lookalikes(reps, radius, similarity).union(star).distinct(), "near-pairs")
    links = written(equal.union(_verified(texts, pairs, size, similarity)), "near-links")

    # step 4
    roots = written(components(links).withColumnRenamed("u", "doc_id"), "near-groups")
    placed = met.join(roots, "doc_id", "left").select("token", "doc_id", "size", "place", F.coalesce("root", "doc_id").alias("root"))
    counts = written(placed.groupBy("token", "root").agg(F.count(F.lit(1)).alias("n")), "near-counts")
    mixed = counts.groupBy("token").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("groups")).where("groups > 1").select("token", "main")
    open_ = written(placed.join(mixed, "token"), "near-open")
    a, b = open_.where("root <> main").alias("a"), open_.alias("b")
    apart = (F.col("b.root") == F.col("b.main")) | (F.col("a.root") > F.col("b.root"))
    rest = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.root") != F.col("b.root")) & apart & _fits(similarity))
    rest = rest.select(F.greatest("a.doc_id", "b.doc_id").alias("doc_id"), F.least("a.doc_id", "b.doc_id").alias("leader")).distinct()
    known = pairs.select(F.greatest("doc_id", "leader").alias("doc_id"), F.least("doc_id", "leader").alias("leader"))
    rest = written(rest.join(known, ["doc_id", "leader"], "left_anti"), "near-rest")
    return links.union(_verified(texts, rest, size, similarity))


def near_deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """``docs`` without near-duplicates: of each group the least id stays, with all its rows and columns.

    Rows with a null id stay. An empty table gives an empty result. Runs jobs at once.
    """
    gone = written(components(near_links(docs, doc_id, text, **settings)).select(F.col("u").alias("gone")).distinct(), "near-gone")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return without(rows, [F.col("_row").getField(doc_id).cast("long")], gone).select("_row.*")
