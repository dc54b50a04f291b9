"""Personal data: patterns, and information-theoretic sanitisation of the terms that reveal what they find.

Patterns find e-mail addresses, IP addresses, card and phone numbers; each value found is a
*protected entity*. Words of a document may reveal its entities. How strongly is read off the whole corpus:
with ``df`` document counts and ``c(t, e)`` the documents that hold both term t and entity e,

    PMI(t; e) = ln(N c(t, e) / (df(t) df(e)))        IC(e) = ln(N / df(e))

A term whose PMI reaches ``generalise`` times IC(e) is generalised, from ``remove`` times on it is
removed (PMI = IC means that the term occurs with that entity only), everywhere in the documents that hold the
entity. Rare entities and terms count like any other: most personal data occurs in one document, and a rare
word beside it tells the most. Terms are runs of three letters or more, in lower case, outside e-mail addresses.

Entities with the same documents disclose alike, so they are one *class*: a document with thousands of addresses
that occur nowhere else has one class to weigh its words against, not thousands.

DataFrame functions only. Scale: texts are scanned once for patterns and once for document counts. What is
shuffled are counts (summed before), the distinct terms of the documents with entities, and of those documents
that have a disclosing term the text, once. Terms too frequent to reach the threshold with any entity leave before
pairs are made. Work within a text is linear in its length, but for look-ups among its disclosing terms, which
are rare. No side is broadcast by hand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

KINDS = ("email", "ip", "card", "phone")
#: Kinds of spans that the method adds.
TERM_KINDS = ("generalised", "removed")

#: Java patterns, possessive where that can't change a match, so that long runs neither recurse nor rescan.
#: Card: maximal digit runs with 12 to 19 digits; others fail anyway.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_SPAN = "array<struct<start:int,end:int,value:string>>"
_WORD = r"\p{L}{3,}"
#: Elements that are summed, or code points that are cut, together.
BLOCK = 256


def _let(value: Column, body) -> Column:
    """``body`` of the value, which is evaluated once: a lambda would evaluate a column from outside for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _scan(values: Column, join) -> Column:
    """For each int what ``join`` makes of those before it, from 0, in blocks, so that arrays are built in nearly linear time."""

    def within_block(block: Column, start: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            return F.struct(join(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

        return F.aggregate(block, F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])

    def of_blocks(blocks: Column) -> Column:
        totals = within_block(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), join)), F.lit(0))
        return F.flatten(F.zip_with(blocks, totals, within_block))

    def of_values(v: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(BLOCK))
        return _let(F.transform(starts, lambda i: F.slice(v, i, BLOCK)), of_blocks)

    return _let(values, of_values)


def _before(lengths: Column) -> Column:
    """For each length the sum of those before it."""
    return _scan(lengths, lambda x, y: x + y)


def _located(text: Column, pattern: str) -> Column:
    """All matches with their places in code points: the gaps between them come from ``split``."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    found = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), gaps, lambda v, g: F.struct(v.alias("value"), g.alias("gap")))
    found = F.filter(found, lambda f: f["value"].isNotNull())

    def span(f: Column, at: Column) -> Column:
        start = at + f["gap"]
        return F.struct(start.alias("start"), (start + F.length(f["value"])).alias("end"), f["value"].alias("value"))

    def spans(f: Column) -> Column:
        return F.zip_with(f, _before(F.transform(f, lambda x: x["gap"] + F.length(x["value"]))), span)

    return F.when(text.rlike(pattern), _let(found, spans)).otherwise(F.array().cast(_SPAN))


def _outside_mail(text: Column) -> Column:
    """The parts of the text between its e-mail addresses."""
    return F.when(F.contains(text, F.lit("@")), F.split(text, PATTERNS["email"], -1)).otherwise(F.array(text))


def _terms(text: Column) -> Column:
    """The distinct terms of the text."""
    words = F.array_join(F.regexp_extract_all(F.array_join(_outside_mail(text), " "), F.lit(_WORD), F.lit(0)), " ")
    return F.array_remove(F.array_distinct(F.split(F.lower(words), " ")), "")


def _term_spans(text: Column, generalised: Column, removed: Column) -> Column:
    """The places of the terms listed in the two strings (each term between spaces)."""
    mails = F.when(F.contains(text, F.lit("@")), F.regexp_extract_all(text, F.lit(PATTERNS["email"]), F.lit(0))).otherwise(F.array().cast("array<string>"))

    def tokens(part: Column, mail: Column) -> Column:
        words = F.zip_with(
            F.split(part, _WORD, -1),
            F.regexp_extract_all(part, F.lit(_WORD), F.lit(0)),
            lambda g, w: F.struct(F.length(g).alias("gap"), F.coalesce(F.length(w), F.lit(0)).alias("size"), F.lower(w).alias("term")),
        )
        return F.concat(words, F.array(F.struct(F.lit(0).alias("gap"), F.coalesce(F.length(mail), F.lit(0)).alias("size"), F.lit(None).cast("string").alias("term"))))

    flat = F.flatten(F.zip_with(_outside_mail(text), mails, tokens))

    def listed(terms: Column, t: Column) -> Column:
        return F.contains(terms, F.concat(F.lit(" "), t, F.lit(" ")))

    def span(t: Column, at: Column) -> Column:
        kind = F.when(listed(removed, t["term"]), 5).when(listed(generalised, t["term"]), 4)
        return F.struct((at + t["gap"]).alias("start"), kind.alias("kind"), (at + t["gap"] + t["size"]).alias("end"))

    spans = _let(flat, lambda f: F.zip_with(f, _before(F.transform(f, lambda t: t["gap"] + t["size"])), span))
    return F.filter(spans, lambda s: s["kind"].isNotNull())


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    def passes(turned: Column) -> Column:
        def add(total: Column, i: Column) -> Column:
            d = F.substring(turned, i, F.lit(1)).cast("int")
            return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

        return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) % 10 == 0

    return _let(F.reverse(_digits(value)), passes)


_VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$"),
    "card": _luhn,
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
}
#: A character without which no match is possible, as a cheap first test.
_NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}


def _spans_of(text: Column, kind: str) -> Column:
    k = KINDS.index(kind)
    valid = F.filter(_located(text, PATTERNS[kind]), lambda s: _VALID[kind](s["value"]))
    spans = F.transform(valid, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))
    kindless = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    return F.when(F.contains(text, F.lit(_NEEDS[kind])), spans).otherwise(kindless) if _NEEDS[kind] else spans


def _with_base(text: Column) -> Column:
    return F.array_sort(F.concat(*[_spans_of(text, k) for k in KINDS]))


def _entities(base: Column) -> Column:
    """The distinct values of the spans as hashes: mail without case, numbers without punctuation."""
    one = lambda s: F.xxhash64(s["kind"], F.when(s["kind"] == 0, F.lower(s["value"])).when(s["kind"] == 1, s["value"]).otherwise(_digits(s["value"])))
    return F.array_distinct(F.transform(base, one))


def disclosing_terms(texts: DataFrame, found: DataFrame, documents: int, generalise: float = 0.8, remove: float = 0.95) -> DataFrame:
    """``(did, row_key, term, removed)``: the terms of each document with entities that disclose one of them.

    ``texts``: the corpus as (text); ``found``: the documents with entities as (did, row_key, text, base), a
    written table. A term discloses an entity if PMI / IC reaches ``generalise``; ``removed`` tells whether it
    reaches ``remove``; a ratio at a threshold reaches it. An entity in every document has no information to protect and discloses nothing.
    Rows that repeat count as documents of their own, among the entities and terms alike.
    """
    n = float(max(1, documents))
    # rows that repeat are one row with a count
    alike = written(found.groupBy("did", "row_key").agg(F.count(F.lit(1)).alias("copies"), F.first(_entities(F.col("base"))).alias("entities"), F.first(_terms(F.col("text"))).alias("terms")), "pii-documents")
    held = alike.select("did", "row_key", "copies", F.explode("entities").alias("entity"))
    entities = written(held.groupBy("entity").agg(F.sum("copies").alias("df_entity"), F.bit_xor(F.xxhash64("did", "row_key")).alias("members"), F.sum(F.hash("did", "row_key").cast("long")).alias("members2")), "pii-entities")
    # entities of one document need no join: nothing else can share them
    shared = written(entities.where((F.col("df_entity") > 1) & (F.col("df_entity") < n)), "pii-shared")
    classes = held.join(shared, "entity").select("did", "row_key", "copies", "df_entity", "members", "members2").distinct()
    own = held.join(entities.where("df_entity = 1"), "entity", "left_semi").select("did", "row_key").distinct().where(F.lit(n > 1))
    alone = own.select("did", "row_key", F.lit(1).cast("long").alias("copies"), F.lit(1).cast("long").alias("df_entity"), F.lit(0).cast("long").alias("members"), F.lit(0).cast("long").alias("members2"))
    classes = written(classes.unionByName(alone), "pii-classes")
    # PMI >= g IC needs df_term <= c (N / df_entity)^(1 - g), and c <= df_entity
    most = F.col("df_entity") * F.pow(n / F.col("df_entity"), F.lit(1 - generalise)) + 1e-6
    bounds = classes.groupBy("did", "row_key").agg(F.max(most).alias("bound"))
    top = (classes.agg(F.max(most)).first() or [None])[0] or 0.0
    counts = texts.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df_term")).where(F.col("df_term") <= top)
    mine = alike.select("did", "row_key", F.explode("terms").alias("term"))
    rare = written(mine.join(counts, "term").join(bounds, ["did", "row_key"]).where(F.col("df_term") <= F.col("bound")).select("did", "row_key", "term", "df_term"), "pii-rare")
    pairs = rare.join(classes, ["did", "row_key"]).where(F.col("df_term") <= most)
    # classes of one document: c is 1; the others are counted over their documents
    single = pairs.where("df_entity = 1").withColumn("c", F.lit(1).cast("long"))
    several = written(pairs.where("df_entity > 1"), "pii-pairs")
    key = ["members", "members2", "df_entity", "term"]
    together = several.groupBy(*key).agg(F.sum("copies").alias("c"))
    several = several.join(together, key)
    columns = ["did", "row_key", "term", "df_term", "df_entity", "c"]
    rated = single.select(columns).unionByName(several.select(columns))
    ratio = F.ln(F.lit(n) * F.col("c") / (F.col("df_term") * F.col("df_entity"))) / F.ln(F.lit(n) / F.col("df_entity"))
    rated = rated.withColumn("ratio", ratio).where(F.col("ratio") >= generalise - 1e-9)
    return rated.groupBy("did", "row_key", "term").agg((F.max("ratio") >= remove - 1e-9).alias("removed"))


def _found(docs: DataFrame, doc_id: str, text: str, generalise: float, remove: float, whole: bool) -> tuple[DataFrame, DataFrame]:
    """Rows ``(_row, base, spans)`` with pattern spans, and ``(_row)`` without; ``_row`` is the input row as a struct.

    ``whole``: the texts without spans are asked for too; else they are null there.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    body = F.coalesce(F.col("_row").getField(text), F.lit(""))
    based = rows.withColumn("base", _with_base(body))
    if not whole:
        based = based.withColumn("_row", F.when(F.size("base") > 0, F.col("_row")).otherwise(F.col("_row").withField(text, F.lit(None).cast("string"))))
    based = written(based, "pii-base")
    some = based.where(F.size("base") > 0).select("_row", "base", F.xxhash64(F.col("_row").getField(doc_id)).alias("did"), F.xxhash64(body).alias("row_key"), body.alias("text"))
    flagged = disclosing_terms(rows.select(body.alias("text")), some.select("did", "row_key", "text", "base"), based.count(), generalise, remove)
    listed = lambda which: F.concat(F.lit(" "), F.array_join(F.collect_list(F.when(which, F.col("term"))), " "), F.lit(" "))
    lists = written(flagged.groupBy("did", "row_key").agg(listed(~F.col("removed")).alias("generalised"), listed(F.col("removed")).alias("gone")), "pii-terms")
    bare = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    terms = F.coalesce(F.when(F.col("generalised").isNotNull(), _term_spans(F.col("text"), F.col("generalised"), F.col("gone"))), F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    joined = some.join(lists, ["did", "row_key"], "left").select("_row", bare.alias("base"), F.array_sort(F.concat(bare, terms)).alias("spans"))
    return joined, based.where(F.size("base") == 0).select("_row")


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", generalise: float = 0.8, remove: float = 0.95) -> DataFrame:
    """One row per document: doc_id, base and spans (arrays of ``start, kind, end``, sorted).

    Kinds 0 to 3 are ``KINDS``; 4 and 5 are ``TERM_KINDS``, the words that the method generalises or
    removes. Null texts count as empty and have no spans. Offsets are code points, ends exclusive. Equal
    texts in several documents, and rows that repeat, count once for each row. Extra columns are ignored; an
    empty table gives an empty result. Runs jobs at once.
    """
    plain = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    some, none = _found(plain, "doc_id", "text", generalise, remove, whole=False)
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return some.select("_row.doc_id", "base", "spans").unionByName(none.select("_row.doc_id", empty.alias("base"), empty.alias("spans")))


def rendered(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in (*KINDS, *TERM_KINDS)])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _cut(blocks: Column, start: Column, end: Column) -> Column:
    """The code points from start to end of a text that lies in blocks of ``BLOCK``."""
    low, high = F.floor(start / BLOCK).cast("int"), F.floor((end - 1) / BLOCK).cast("int")

    def part(b: Column) -> Column:
        first = F.greatest(start - b * BLOCK, F.lit(0))
        return F.substring(F.get(blocks, b), first + 1, F.least(end - b * BLOCK, F.lit(BLOCK)) - first)

    return F.when(end > start, F.array_join(F.transform(F.sequence(low, high), part), "")).otherwise(F.lit(""))


def redacted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", generalise: float = 0.8, remove: float = 0.95) -> DataFrame:
    """``docs`` with each text sanitised: pattern spans become ``[EMAIL]`` and so on, generalised terms ``[TERM]``, removed ones nothing.

    Overlapping spans are merged under the tag of the one that begins first. Texts without spans, nulls
    among them, stay as they are; all columns pass through. Runs jobs at once.
    """
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS], F.lit("[TERM]"), F.lit(""))
    found, same = _found(docs, doc_id, text, generalise, remove, whole=True)
    body = F.col("_row").getField(text)
    # a span that begins before an earlier one has ended belongs to that one
    ends = F.transform("spans", lambda s: s["end"])
    larger = lambda x, y: F.greatest(x, y)
    reach = F.zip_with(_scan(ends, larger), ends, larger)
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("_reach"), i - 1))
    blocks = F.regexp_extract_all(body, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    parts = F.transform("spans", lambda s, i: F.when((i > 0) & (s["start"] < before(i)), F.lit("")).otherwise(F.concat(_cut(F.col("_blocks"), before(i), s["start"]), F.get(tags, s["kind"]))))
    tail = _cut(F.col("_blocks"), F.element_at("_reach", -1), F.length(body))
    some = found.select("_row", "spans", reach.alias("_reach"), blocks.alias("_blocks"))
    changed = some.select("_row", F.concat(F.array_join(parts, ""), tail).alias("_clean"))
    return changed.unionByName(same.select("_row", body.alias("_clean"))).select(*[F.col("_clean").alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in docs.columns])


def pii_digest(found: DataFrame) -> DataFrame:
    """The columns of the contract from :func:`find_pii`'s rows."""
    def of(k: int):
        return lambda s: s["kind"] == k

    counts = [F.size(F.filter("base", of(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(rendered(F.col("base")), 256).alias("base_sha256"), rendered(F.col("spans")).alias("spans"))
