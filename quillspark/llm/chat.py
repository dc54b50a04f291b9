"""Chat formatting by prefix-target expansion.

Every assistant turn is an example of its own: all preceding turns are its context, and only that reply
is trainable. All examples of a conversation are prefixes of one formatted text, so each turn is formatted
and stored once, and an example is a reference into it (how far its context reaches and where its reply
lies). Writing the prefixes out would take room with the square of a conversation's turns; ``expanded``
does so for callers who want the strings.

Template: ``<<SYS>> system <</SYS>>``, ``[INST] user [/INST]``, ``<s> assistant </s>``, and
``<role:HEX> other </role>`` for any other role, HEX being the role's UTF-8. Control strings and
backslashes inside texts get a backslash before them, which reading undoes.

Scale: formatting is row by row in DataFrame functions. Offsets are a running sum per conversation, which deals
the turns by conversation, once. Reading back takes the turns and the examples of a conversation in order through
one task with bounded memory (one turn and the hash states). A conversation can't be divided further, because its
SHA-256 is sequential: one with a third of all turns takes one task, which spills but holds no more than a turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What opens and closes the turns of a role, without the space between mark and text.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("<role:", "</role>")
CONTROL = [m for pair in (*MARKS.values(), OTHER) for m in pair]
_ANY = "|".join(re.escape(m) for m in CONTROL)
_ESCAPED = re.compile(rf"\\(\\|{_ANY})")
_TOKEN = re.compile(rf"\\(?:\\|{_ANY})|{_ANY}")
_ROLE_OF = {a: (role, b) for role, (a, b) in MARKS.items()}


def _java(marks: list[str]) -> str:
    return "(" + "|".join([r"\\", *(re.sub(r"([\[\]/<>:])", r"\\\1", m) for m in marks)]) + ")"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _java(CONTROL), r"\\$1")


def unescaped(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def format_turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per turn: conv_id, turn, formatted, loss_start, loss_end (code points in ``formatted``; null if not trainable).

    Null texts and roles count as empty. Extra columns are ignored; repeated rows are turns of their own.
    """
    c = conversations.select(
        F.col(f"`{conv_id}`").alias("conv_id"),
        F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
        escaped(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("body"),
    )
    opening = F.concat(F.lit(OTHER[0]), F.lower(F.hex(F.encode("role", "UTF-8"))), F.lit("> "))
    closing = F.lit(" " + OTHER[1])
    for name, (a, b) in MARKS.items():
        opening = F.when(F.col("role") == name, F.lit(a + " ")).otherwise(opening)
        closing = F.when(F.col("role") == name, F.lit(" " + b)).otherwise(closing)
    start = F.when(F.col("role") == "assistant", F.length(F.lit(MARKS["assistant"][0] + " ")))
    return c.select("conv_id", "turn", F.concat(opening, "body", closing).alias("formatted"), start.alias("loss_start"), (start + F.length("body")).alias("loss_end"))


def placed(formatted: DataFrame) -> DataFrame:
    """The turns with ``context_chars``, where each begins in its conversation's text: a running sum in the order of turns.

    Turns that repeat a number are ordered by their formatted text.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "tie").rowsBetween(Window.unboundedPreceding, -1)
    turns = formatted.select("conv_id", "turn", "formatted", "loss_start", "loss_end").withColumn("tie", F.sha2("formatted", 256))
    return turns.withColumn("context_chars", F.coalesce(F.sum(F.length("formatted").cast("long")).over(order), F.lit(0).cast("long"))).drop("tie")


def _example() -> list[Column]:
    """Prefix-target expansion of a placed turn: the context before it, and where its reply lies in the conversation's text."""
    return [
        F.col("context_chars"),
        (F.col("context_chars") + F.col("loss_start")).alias("loss_start"),
        (F.col("context_chars") + F.col("loss_end")).alias("loss_end"),
        (F.col("context_chars") + F.length("formatted")).alias("example_chars"),
    ]


def examples(formatted: DataFrame) -> DataFrame:
    """One row per assistant turn: conv_id, turn, context_chars, loss_start, loss_end, example_chars, in the conversation's text.

    The example is the conversation's formatted text up to ``example_chars``; only its loss range is trainable.
    """
    return placed(formatted).where("loss_start is not null").select("conv_id", "turn", *_example())


class Reader:
    """Turns of a formatted text that comes in pieces of any size."""

    def __init__(self):
        self.rest = ""

    def feed(self, piece: str) -> Iterator[tuple[str, str, str]]:
        """``(role, text, escaped text)`` of every turn that is complete."""
        data, at = self.rest + piece, 0
        while at < len(data):
            for mark, (role, closing) in _ROLE_OF.items():
                if data.startswith(mark + " ", at):
                    body = at + len(mark) + 1
                    break
            else:
                if not (m := re.compile(r"<role:([0-9a-f]*)> ").match(data, at)):
                    break  # not complete yet
                role, closing, body = bytes.fromhex(m[1]).decode("utf-8"), OTHER[1], m.end()
            end = next((m for m in _TOKEN.finditer(data, body) if m[0][0] != "\\"), None)
            if end is None:
                break
            if end[0] != closing or data[end.start() - 1] != " " or end.start() - 1 < body:
                raise ValueError(f"a turn of {role!r} is closed by {end[0]!r}")
            yield role, unescaped(data[body : end.start() - 1]), data[body : end.start() - 1]
            at = end.end()
        self.rest = data[at:]


@dataclass
class _Digest:
    """What is read back from one conversation's text."""

    conv_id: object
    reader: Reader = field(default_factory=Reader)
    turns: object = field(default_factory=hashlib.sha256)
    loss: object = field(default_factory=hashlib.sha256)
    counts: list[int] = field(default_factory=lambda: [0] * 5)
    last: str = ""

    def turn(self, piece: str) -> None:
        """The next turn of the text."""
        for role, text, _ in self.reader.feed(piece):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.counts[0] += 1
        self.last, self.counts[2] = piece, self.counts[2] + len(piece)

    def example(self, start: int, end: int, chars: int) -> None:
        """An example that ends with the last turn: its reply is read through its own offsets."""
        begun = self.counts[2] - len(self.last)
        if not begun <= start <= end <= chars == self.counts[2]:
            raise ValueError("an example's reply lies outside its last turn")
        trained = unescaped(self.last[start - begun : end - begun])
        self.loss.update(trained.encode())
        self.counts[1] += len(trained)
        self.counts[3] += 1
        self.counts[4] += chars

    def row(self) -> tuple:
        if self.reader.rest:
            raise ValueError("the text ends within a turn")
        n, loss, chars, made, example_chars = self.counts
        return self.conv_id, n, self.turns.hexdigest(), loss, self.loss.hexdigest(), chars, made, example_chars


_NAMES = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples", "example_chars"]
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long, example_chars long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: _Digest | None = None
    done: list[tuple] = []

    def out() -> pa.RecordBatch:
        columns = list(zip(*done, strict=True))
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=_NAMES)

    for batch in batches:
        for conv, text, start, end, chars in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "formatted", "loss_start", "loss_end", "example_chars")), strict=True):
            if now is None or now.conv_id != conv:
                if now is not None:
                    done.append(now.row())
                now = _Digest(conv)
            if chars is None:
                now.turn(text)
            else:
                now.example(start, end, chars)
        if len(done) >= 1000:
            yield out()
    if now is not None:
        done.append(now.row())
    if done:
        yield out()


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read from its formatted text and its examples: counts and digests of turns and of the text under the loss masks.

    What is trained is read example by example, through each one's offsets. ``formatted_chars`` counts the stored
    text, ``example_chars`` what all examples hold together. A null conv_id is a conversation; no turns give no row.
    """
    turns = placed(formatted.withColumn("conv_id", F.col("conv_id").cast("long")))
    nothing = F.lit(None).cast("long")
    turn = F.struct(F.lit(0).alias("kind"), F.col("formatted"), nothing.alias("loss_start"), nothing.alias("loss_end"), nothing.alias("example_chars"))
    example = F.struct(F.lit(1).alias("kind"), F.lit(None).cast("string").alias("formatted"), *_example()[1:])
    rows = turns.select("conv_id", "context_chars", F.explode(F.when(F.col("loss_start").isNull(), F.array(turn)).otherwise(F.array(turn, example))).alias("r"))
    # the turns lie by conversation already; an example follows the turn that it ends with
    ordered = rows.sortWithinPartitions("conv_id", "context_chars", "r.kind")
    return ordered.select("conv_id", "r.formatted", "r.loss_start", "r.loss_end", "r.example_chars").mapInArrow(_read, _SCHEMA)


def expanded(formatted: DataFrame) -> DataFrame:
    """The examples' strings: conv_id, turn, example, loss_start, loss_end. Grows with the square of a conversation's turns."""
    order = Window.partitionBy("conv_id").orderBy("turn", F.sha2("formatted", 256)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = formatted.withColumn("example", F.array_join(F.collect_list("formatted").over(order), ""))
    before = F.length("example") - F.length("formatted")
    return whole.where("loss_start is not null").select("conv_id", "turn", "example", (before + F.col("loss_start")).alias("loss_start"), (before + F.col("loss_end")).alias("loss_end"))
