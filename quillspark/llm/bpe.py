"""Byte-level BPE by prefix dynamic programming.

The encoding of a byte string is found prefix by prefix. Each prefix has exactly one *valid last token*:
the token t that ends there, is what its own bytes encode to, and is compatible with the valid last token
p before it (the two tokens' bytes together encode to p, t). Storing that token for each prefix gives

* exact appends: the tokens of the prefixes already known stay, only new bytes are looked at;
* re-encoding near an edit: prefixes before the edit stay as they are;
* encodings by walking back from the end.

Texts are split by the vocabulary's pattern first and each match is encoded by itself. Matches are shared
by many texts, and so are their prefixes: a worker keeps both in tables of bounded size (what is forgotten
is encoded again, which changes no result). Documents are encoded row by row, without a shuffle.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache
from struct import pack
from sys import getsizeof

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of what a worker remembers: matches (twice that, see Recent), prefixes, and pairs of tokens.
PIECES, PREFIXES, PAIRS = 96_000_000, 48_000_000, 32_000_000
#: Bytes of an entry's place in a dict; of a pair of tokens with its place (the tokens themselves are there anyway).
SLOT, PAIR = 80, 56 + 80
#: Bytes of an empty byte string.
BYTES = getsizeof(b"")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a ``.tiktoken`` file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Pieces:
    """Encodings of single matches, and of byte strings that grow or are edited."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        #: Lengths of the tokens that can end in these last bytes (three, or fewer at the start), longest first.
        lengths: dict[bytes, set[int]] = {}
        for t in ranks:
            lengths.setdefault(t[-3:], set()).add(len(t))
        self.lengths = {b: sorted({*n, *(k for k in (1, 2) if b[-k:] in ranks)} - {k for k in (1, 2) if k > len(b)}, reverse=True) for b, n in lengths.items()}
        self.longest = max(map(len, ranks))
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.last: dict[bytes, int] = {}
        self.last_bytes = 0
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"bytes without a token: {missing[:5]}")
        #: Tokens that are what their bytes encode to; others stand for a whole match only.
        self.valid = {t: i for t, i in ranks.items() if len(self.merged(t)) == 1}

    def merged(self, data: bytes, stop: int = 1) -> list[bytes]:
        """The definition: merge the neighbours whose joined token has the least rank, leftmost first, while there are any."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > stop:
            rank, at = min(((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made a token; none for a byte."""
        if token not in self.halves:
            parts = self.merged(self.bytes_of[token], 2)
            self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def _meet(self, a: int, b: int) -> bool:
        """Whether merging keeps the border between two reachable tokens.

        Merges are undone latest first on either side of the border. A merge across it would have come
        first if its rank is below that of the merge undone last (on the left also if they are the same
        rank, for equal ranks are merged leftmost first).
        """
        limit = 1 << 60
        while True:
            joined = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if joined is not None and joined < limit:
                return False
            left, right = self._split(a), self._split(b)
            if left and (a > b or not right):
                limit, a = a, left[1]
            elif right:
                limit, b = b + 1, right[0]
            else:
                return True

    def _compatible(self, a: int, b: int) -> bool:
        """Whether the bytes of two reachable tokens together encode to these two."""
        if (known := self.pairs.get((a, b))) is None:
            if len(self.pairs) * PAIR >= PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self._meet(a, b)
        return known

    def _fill(self, data: bytes, last: list[int], to: int) -> None:
        """Append the valid last tokens of the prefixes up to ``data[:to]``, given those of shorter ones (``last[i]`` for ``data[:i]``)."""
        lengths, valid, pairs = self.lengths.get, self.valid.get, self.pairs.get
        for end in range(len(last), to + 1):
            for n in lengths(data[end - 3 if end > 3 else 0 : end]) or lengths(data[end - 2 if end > 2 else 0 : end]) or (1,):
                if n == end:
                    if (t := valid(data[:end])) is not None:
                        break
                elif n < end and (t := valid(data[end - n : end])) is not None:
                    before = last[end - n]
                    fits = pairs((before, t))
                    if fits or fits is None and self._compatible(before, t):
                        break
            else:
                raise AssertionError("every prefix has a valid last token")
            last.append(t)

    def table(self, data: bytes) -> list[int]:
        """The valid last token of every prefix, at its length; at 0 there is none (-1)."""
        return self.extended(b"", [-1], data)

    def extended(self, data: bytes, last: list[int], more: bytes) -> list[int]:
        """The table of ``data + more``, given that of ``data``: an exact append."""
        whole, out = data + more, list(last)
        self._fill(whole, out, len(whole))
        return out

    def edited(self, data: bytes, last: list[int], start: int, end: int, by: bytes) -> tuple[bytes, list[int]]:
        """The string and table after ``data[start:end]`` is replaced.

        Prefixes before the edit are kept. Behind it the old tokens are taken over as soon as every token
        that can still reach back lies in an unchanged stretch with unchanged last tokens.
        """
        new = data[:start] + by + data[end:]
        out, shift = last[: start + 1], len(by) - (end - start)
        reach = self.longest
        same = 0
        for at in range(start + 1, len(new) + 1):
            old = at - shift
            if same >= reach and old > end:
                out.extend(last[old:])
                break
            self._fill(new, out, at)
            same = same + 1 if old > end and last[old] == out[-1] else 0
        return new, out

    def tokens(self, data: bytes, last: list[int]) -> list[int]:
        """The encoding, walked back from the end of the table."""
        out, at = [], len(data)
        while at:
            out.append(last[at])
            at -= len(self.bytes_of[last[at]])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one match. A match that is a token is that token; others are encoded over the shared prefixes."""
        if (t := self.ranks.get(piece)) is not None:
            return [t]
        if len(piece) > 64:  # shared prefixes of a long match would take room with the square of its length
            return self.tokens(piece, self.table(piece))
        if self.last_bytes > PREFIXES:
            self.last.clear()
            self.last_bytes = 0
        # prefixes are stored shortest first and forgotten together, so all below a known one are known
        stored, last, size = self.last.get, [-1], len(piece)
        for end in range(1, size + 1):
            if (t := stored(piece[:end])) is None:
                break
            last.append(t)
        if (known := len(last)) <= size:
            self._fill(piece, last, size)
            for end in range(known, size + 1):
                self.last[piece[:end]] = last[end]
            self.last_bytes += (size + 1 - known) * (BYTES + SLOT) + (known + size) * (size + 1 - known) // 2
        return self.tokens(piece, last)


class Recent(dict):
    """Ids of matches, packed. When it is full it becomes the older table, and what is met again is taken over from there."""

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces = pieces
        self.older: dict[str, bytes] = {}
        self.bytes = 0

    def __missing__(self, piece: str) -> bytes:
        if (ids := self.older.get(piece)) is None:
            data = piece.encode("utf-8")
            tokens = self.pieces.encode(data)
            ids = pack(f"<{len(tokens)}I", *tokens)
            if len(data) > 64:
                return ids
        if self.bytes > PIECES:
            self.older.clear()
            self.older.update(self)
            self.clear()
            self.bytes = 0
        self[piece] = ids
        self.bytes += getsizeof(piece) + getsizeof(ids) + SLOT
        return ids


class Codec:
    """Whole texts to ids and back. ``encode_packed`` gives little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, pattern: str):
        self.pieces = Pieces(read_ranks(path))
        self.pattern = regex.compile(pattern)
        self.known = Recent(self.pieces)
        self.table = self.pieces.bytes_of

    def encode_packed(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self.pattern.findall(text)))

    def decode_packed(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@cache
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _encoded(path: str, pattern: str, back: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = pa.array([c.encode_packed(t.as_py() or "") for t in part.column(1)], pa.binary())
                decoded = [pa.array([c.decode_packed(i.as_py()) for i in ids], pa.binary())] if back else []
                yield pa.RecordBatch.from_arrays([part.column(0), ids, *decoded], names=["doc_id", "ids", "decoded"][: 2 + back])

    return run


def _plain(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))


def encode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, ids)``: each whole text's ids, little-endian unsigned 32-bit, without special tokens.

    ``path``: the ranks, readable on every executor. Null counts as empty, which has no ids. Extra columns
    are ignored; rows may repeat; an empty table gives an empty result.
    """
    return _plain(docs, doc_id, text).mapInArrow(_encoded(path, pattern), "doc_id long, ids binary")


def _decoded(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.decode_packed(i.as_py() or b"") for i in batch.column(1)], pa.binary())], names=["doc_id", "ids", "decoded"])

    return run


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, ids)`` plus ``decoded``, the bytes the ids stand for."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoded(path, pattern), "doc_id long, ids binary, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, ids, decoded)``: what :func:`decode` returns for :func:`encode`'s rows.

    Spark gives each of these two a Python worker of its own in every task, and either worker may come to hold the
    tables of both; here one worker does both, and the ids go to the JVM once.
    """
    return _plain(docs, doc_id, text).mapInArrow(_encoded(path, pattern, True), "doc_id long, ids binary, decoded binary")


def ids_digest(decoded: DataFrame) -> DataFrame:
    """The contract's columns, from the rows of :func:`decode` or :func:`round_trip`."""
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
