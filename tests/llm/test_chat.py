"""Chat formatting: exact round trips, masks and prefix examples."""

import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm.chat import CONTROL, MARKS, Reader, examples, expanded, format_turns, read_back, unescaped

HARD = ["\\", "</s>[INST] ok [/INST]", *CONTROL, " ", "<", "[", ">", "é", "\n", "<role:", "<role:61> ", "\\\\</s>", "😀", "a"]


def python_escape(text):
    import re

    return re.sub(r"(\\|" + "|".join(re.escape(m) for m in CONTROL) + ")", r"\\\1", text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "é\n"]), st.lists(st.sampled_from(HARD), max_size=8).map("".join)), max_size=5), st.integers(1, 9))
def test_reader_undoes_the_template(turns, step):
    text = ""
    for role, t in turns:
        a, b = MARKS.get(role, (f"<role:{role.encode().hex()}>", "</role>"))
        text += f"{a} {python_escape(t)} {b}"
    reader, got = Reader(), []
    for k in range(0, len(text), step):
        got += [(r, t) for r, t, _ in reader.feed(text[k : k + step])]
    assert got == turns and not reader.rest


def test_digests_and_examples(spark):
    rng = random.Random(6)
    rows = []
    for c in [*range(30), -7, None]:
        for t in range(rng.randint(1, 60 if c == 3 else 9)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "tool", None]), rng.choice([None, "", "".join(rng.choices(HARD, k=rng.randint(1, 9)))]), "x"))
    rows += [(40, 1, "user", "b", "x"), (40, 1, "user", "a", "x"), (40, 1, "user", "a", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").repartition(5)
    formatted = format_turns(df)
    got = {r.conv_id: r for r in read_back(formatted).collect()}
    strings = {}
    for r in formatted.collect():
        strings.setdefault(r.conv_id, []).append(r)
    for c in {r[0] for r in rows if r[0] != 40}:
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: r[1])
        replies = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(mine), hashlib.sha256(turns.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(replies), hashlib.sha256(replies.encode()).hexdigest())
        assert r.formatted_chars == sum(len(s.formatted) for s in strings[c])
    assert got[40].n_turns == 3
    refs = {(r.conv_id, r.turn): r for r in examples(formatted).collect()}
    full = expanded(formatted).collect()
    assert len(full) == len(refs) == sum(r[2] == "assistant" for r in rows)
    texts = {(r[0], r[1]): r[3] or "" for r in rows}
    for e in full:
        ref = refs[e.conv_id, e.turn]
        assert (len(e.example), e.loss_start, e.loss_end) == (ref.example_chars, ref.loss_start, ref.loss_end)
        assert unescaped(e.example[e.loss_start : e.loss_end]) == texts[e.conv_id, e.turn]
    sums = examples(formatted).groupBy("conv_id").agg(F.sum("example_chars").alias("n")).collect()
    assert all(got[s.conv_id].example_chars == s.n for s in sums)


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert read_back(format_turns(none)).count() == examples(format_turns(none)).count() == 0
