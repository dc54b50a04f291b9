"""Personal data against a brute-force version with Python's own pattern engine."""

import hashlib
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from quillspark.llm.pii import KINDS, find_pii, pii_digest, redacted

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(value):
    d = [int(c) for c in value if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def valid(kind, m):
    n = sum(c.isdigit() for c in m)
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.split(".")), "card": 12 <= n <= 19 and luhn(m), "phone": 9 <= n <= 15}[kind]


def base(text):
    return sorted((m.start(), k, m.end(), m[0]) for k, kind in enumerate(KINDS) for m in re.finditer(BASE[kind], text) if valid(kind, m[0]))


def digest(text):
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in base(text)).encode()).hexdigest()


def cases():
    rng = random.Random(3)
    texts = [None, "", "a@b.c_d@e.f", "x" * 30000, "1" * 30000, "1." * 5000, "a@" + "b." * 4000 + "c", "+1 (487) 555-7209", "999.1.2.3.4.5.6.7", "😀 4111 1111 1111 1111 é 4111-1111-1111-1112", "00000255.1.1.1", "1 4111111111111111", "a@b@c.d.e..f", "+12345678 + 9", "4111111111111111 4111111111111111 4", "a.b@c-.d-,é@x.y"]
    alphabet = ["1", "2", "9", "0", ".", "-", " ", "+", "(", ")", "a", "B", "@", "é", "😀", "_", "%", "\n", "4111111111111111", "a@b.co", "10.0.0.1", "+4930123456"]
    texts += ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(400)]
    return list(enumerate(texts))


def test_base_spans_match_brute_force(spark):
    rows = cases()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("base", F.lit("clash")).withColumn("start", F.lit(1))
    got = {r.doc_id: r for r in pii_digest(find_pii(docs)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        want = base(t or "")
        assert got[i].base_sha256 == digest(t or ""), (i, t, want, got[i])
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(k == j for _, k, _, _ in want) for j in range(4)]


def key_of(k, value):
    return k, value.lower() if k == 0 else value if k == 1 else re.sub("[^0-9]", "", value)


def words_outside_mail(text):
    at, out = 0, []
    for m in [*re.finditer(BASE["email"], text), None]:
        end = m.start() if m else len(text)
        out += [(w.start() + at, w.end() + at, w[0].lower()) for w in re.finditer(r"[^\W\d_]{3,}", text[at:end])]
        at = m.end() if m else end
    return out


def brute_spans(rows, generalise=0.8, remove=0.95):
    """All spans of each row, with a pair count over the whole table."""
    n, df, dfe, both = len(rows), Counter(), Counter(), Counter()
    held = []
    for _, t in rows:
        t = t or ""
        entities, terms = {key_of(k, v) for _, k, _, v in base(t)}, {w for _, _, w in words_outside_mail(t)}
        held.append((entities, terms))
        df.update(terms)
        dfe.update(entities)
        both.update((e, w) for e in entities for w in terms)
    out = []
    for (_, t), (entities, terms) in zip(rows, held, strict=True):
        t, kinds = t or "", {}
        for w in terms:
            ratios = [math.log(n * both[e, w] / df[w] / dfe[e]) / math.log(n / dfe[e]) for e in entities if dfe[e] < n]
            if ratios and max(ratios) >= generalise - 1e-9:
                kinds[w] = 5 if max(ratios) >= remove - 1e-9 else 4
        out.append(sorted([(s, k, e) for s, k, e, _ in base(t)] + [(s, kinds[w], e) for s, e, w in words_outside_mail(t) if w in kinds]))
    return out


def test_terms_follow_the_disclosure_ratio(spark):
    rng = random.Random(8)
    filler = ["word" + "".join(rng.choices("abcdefgh", k=3)) for _ in range(60)]
    texts = []
    for i in range(120):
        t = " ".join(rng.choices(filler, k=20))
        if i % 15 == 0:
            t += f" Zanzibar secret boss@corp.example {filler[0]} quietly"
        if i % 10 == 1:
            t += " quietly"
        if i % 9 == 2:
            t = f"Straße{i}é {t} me{i}@x.example, 10.0.0.{i} and +4930 123 45{i:03d} Zanzibar"
        if i % 3 == 0:
            t += " desk@corp.example"
        texts.append((i, t))
    texts += [(400 + k, f"Twice both{k}@x.example") for k in range(2)]
    texts += [(3, texts[3][1]), (200, None), (201, ""), (None, texts[15][1]), (None, texts[15][1])]
    texts += [(300 + k, f"tie{'abc'[k % 3]} same words tie@corp.example") for k in range(2)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("term", F.lit("clash"))
    got = sorted((r.doc_id if r.doc_id is not None else -1, [(s.start, s.kind, s.end) for s in r.spans]) for r in find_pii(df).collect())
    want = sorted((i if i is not None else -1, spans) for (i, _), spans in zip(texts, brute_spans(texts), strict=True))
    assert got == want
    assert {s[1] for _, spans in got for s in spans} >= {0, 1, 3, 4, 5}


def test_spans_of_the_small_table_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: [(s.start, s.kind, s.end) for s in r.spans] for r in find_pii(docs).collect()}
    assert got == {i: spans for (i, _), spans in zip(rows, brute_spans(rows), strict=True)}


def test_a_text_with_thousands_of_entities(spark):
    text = " ".join(f"user{i}@host{i}.example Wörter 10.{i % 250}.{i // 250}.7" for i in range(6000))
    rows = [(1, text), (2, "Wörter überall")] + [(i, "plain") for i in range(3, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.kind, s.end) for s in r.spans] for r in find_pii(docs).collect()}
    assert [s for s in got[1] if s[1] < 4] == [(s, k, e) for s, k, e, _ in base(text)]
    clean = {r.doc_id: r.text for r in redacted(docs).collect()}
    assert "@" not in clean[1] and clean[1].count("[EMAIL]") == 6000 and clean[1].count("[IP]") == 6000 and clean[3] == "plain"


def test_terms_of_an_entity_of_one_document(spark):
    far = "plain " * 100
    texts = [(i, "plain words everywhere") for i in range(99)] + [(99, f"plain Zanzibar a@b.example words {far}Zanzibar")]
    got = {r.doc_id: [(s.start, s.kind, s.end) for s in r.spans] for r in find_pii(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    end = len(texts[-1][1])
    assert got.pop(99) == [(6, 5, 14), (15, 0, 26), (end - 8, 5, end)]
    assert not any(got.values())


def test_redaction_keeps_all_else(spark):
    docs = spark.createDataFrame([(1, "Mail é me@x.example now 10.0.0.1", "k"), (2, None, None), (3, "clean mail now", "k"), (1, "Mail é me@x.example now 10.0.0.1", "k"), (4, "mail now", "k"), (5, "now mail", "k")], "doc_id long, text string, _id string")
    out = redacted(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text or "", r._id or "") for r in out.collect()) == [(1, "Mail é [EMAIL] now [IP]", "k"), (1, "Mail é [EMAIL] now [IP]", "k"), (2, "", ""), (3, "clean mail now", "k"), (4, "mail now", "k"), (5, "now mail", "k")]


def test_empty_table(spark):
    assert pii_digest(find_pii(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
