"""Sequence packing by Karmarkar-Karp multiway differencing.

Each task tokenizes its documents and packs them on its own, so nothing is shuffled and a lost task is
simply run again. A document's ids are cut into whole windows, which are sequences as they are, and a
rest in parts of at most ``part`` ids. Parts are packed block by block: a block has a fixed number of
windows' worth of ids, and the differencing method deals its parts to windows: the two partial
partitions with the largest imbalance are merged so that the imbalances oppose each other, until one
partition is left. If a window exceeds the capacity, the block is dealt again to one more window.

A block is bounded (``windows * (capacity - slack)`` ids; a part is cut to end it exactly), so memory and
the heap are bounded too, whatever the table's size. The slack of a few ids is what lets near-equal
windows fit at the least count. Each task leaves one window partly filled, at most.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator
from functools import cache
from itertools import count

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY, WINDOWS, PART, SLACK = 2048, 128, 512, 4
#: Id that ends each document.
END = 1


def _difference(parts: list[int], k: int) -> list[list[int]]:
    """The parts' indices in k bins with near-equal sums, by multiway differencing."""
    order = count()
    # a partition: (sum, members) of its bins that aren't empty, largest first; the other bins have sum 0
    heap = [(-n, next(order), [(n, (i,))]) for i, n in enumerate(parts)]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        if len(a) + len(b) <= k:
            merged = a + b
        else:
            free = k - len(a)  # bins of a that are empty take the largest of b
            merged = a[: k - len(b)] + b[:free]
            merged += [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a[k - len(b) :], reversed(b[free:]), strict=True)]
        merged.sort(key=lambda x: -x[0])
        if len(merged) == k and (least := merged[-1][0]):
            merged = [(s - least, m) for s, m in merged]
        heapq.heappush(heap, (merged[-1][0] * (len(merged) == k) - merged[0][0], next(order), merged))
    bins: list[list[int]] = []
    for _, tree in heap[0][2]:
        found, open_ = [], [tree]
        while open_:
            x = open_.pop()
            if isinstance(x, int):
                found.append(x)
            else:
                open_.extend(x)
        bins.append(sorted(found))
    return bins


def balanced(parts: list[int], capacity: int) -> list[list[int]]:
    """Indices of the parts by window; no window's sum exceeds the capacity, and sums are near-equal.

    Starts from the least number of windows that can do, one more each time a window overflows.
    """
    if not parts:
        return []
    if max(parts) > capacity:
        raise ValueError("a part is longer than a window")
    k = -(-sum(parts) // capacity)
    while True:
        bins = _difference(parts, k) if k > 1 else [list(range(len(parts)))]
        if all(sum(parts[i] for i in b) <= capacity for b in bins):
            return bins
        k += 1


@cache
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Ids of a text by the byte-level BPE vocabulary in ``path``, special tokens as ordinary text.

    A ``.json`` file is read by ``tokenizers``. Where the same vocabulary lies beside it as ranks
    (``.tiktoken``, the same merges and ids), those are applied, for they give the same ids about four
    times as fast; a text on which that library gives up is encoded from the ``.json`` file.
    """
    from pathlib import Path

    from tokenizers import Tokenizer

    @cache
    def slow() -> Tokenizer:
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        tokenizer.encode_special_tokens = True
        return tokenizer

    def by_tokenizers(text: str) -> np.ndarray:
        return np.array(slow().encode(text, add_special_tokens=False).ids, dtype="<u4")

    ranks = Path(path).with_suffix(".tiktoken")
    if not ranks.exists():
        return by_tokenizers
    import public_tokenizers

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.open("rb"))}
    fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def by_ranks(text: str) -> np.ndarray:
        try:
            return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), dtype="<u4")
        except (KeyboardInterrupt, SystemExit):
            raise
        except BaseException:  # a panic of the library is no Exception
            return by_tokenizers(text)

    return by_ranks


_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_NAMES = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]


class _Packer:
    """Pieces of one task's documents, as rows of ``_SCHEMA``."""

    def __init__(self, first: int, capacity: int, windows: int, part: int, slack: int):
        self.sequence, self.capacity, self.part, self.goal = first, capacity, part, windows * (capacity - slack)
        self.usable = capacity - slack
        self.parts: list[tuple] = []
        self.held = 0
        self.rows: list[tuple] = []

    def _emit(self, members: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in members:
            self.rows.append((doc, start, len(ids), ids.tobytes(), total, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def add(self, doc: int, ids: np.ndarray) -> None:
        total, at = len(ids), 0
        while total - at >= self.capacity:
            self._emit([(doc, at, ids[at : at + self.capacity], total)])
            at += self.capacity
        while at < total:
            n = min(self.part, total - at, self.goal - self.held)
            self.parts.append((doc, at, ids[at : at + n], total))
            at += n
            self.held += n
            if self.held == self.goal:
                self._deal(self.parts)
                self.parts, self.held = [], 0

    def _deal(self, parts: list[tuple]) -> None:
        for members in balanced([len(p[2]) for p in parts], self.capacity):
            self._emit([parts[i] for i in members])

    def close(self) -> None:
        """What is left: as many near-equal windows as it fills, and one for the rest."""
        full, taken, whole = (self.held // self.usable) * self.usable, 0, []
        while self.parts and taken < full:
            doc, at, ids, total = self.parts.pop(0)
            n = min(len(ids), full - taken)
            whole.append((doc, at, ids[:n], total))
            taken += n
            if n < len(ids):
                self.parts.insert(0, (doc, at + n, ids[n:], total))
        self._deal(whole)
        if self.parts:
            self._emit(self.parts)
        self.parts, self.held = [], 0

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True))
        self.rows = []
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=_NAMES)


def _packed(path: str, end: int, capacity: int, windows: int, part: int, slack: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        packer = _Packer((context.partitionId() if context else 0) << 33, capacity, windows, part, slack)
        encode, tail = encoder(path), np.array([end], dtype="<u4")
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc, np.concatenate([encode(text.as_py() or ""), tail]))
                if len(packer.rows) >= 512:
                    yield packer.batch()
        packer.close()
        if packer.rows:
            yield packer.batch()

    return run


def pack(
    docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end: int = END, capacity: int = CAPACITY, windows: int = WINDOWS, part: int = PART, slack: int = SLACK
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    ``tokenizer``: path of the vocabulary on every executor. Each document's ids, ended by ``end``, lie in
    exactly one piece each; a sequence holds ``capacity`` ids at most and its pieces lie gapless from 0.
    Null and empty texts are the end id alone. A row with a repeated doc_id is a document of its own; a
    null doc_id stays null. Extra columns are ignored; an empty table gives an empty result.
    """
    if not 0 < part <= capacity - slack:
        raise ValueError("a part fits into a window")
    plain = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return plain.mapInArrow(_packed(tokenizer, end, capacity, windows, part, slack), _SCHEMA)


def pieces_digest(pieces: DataFrame) -> DataFrame:
    """The contract's columns: :func:`pack`'s rows with a checksum in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
