"""Queries of ranked, literal and semantic search, chunks and budgets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as T
from ..operators import rank as R
from .base import sql_bm25, sql_lines, sql_tokens, table

QUERY = "licensed apache version of the worthless"
PART_QUERY = "red economy widget brand"
TALK_QUERY = "the nicht que is"
NAMES = ["token", "Licensed", "the", "idiot", "Apache"]


def _documents(spark, sf):
    return R.bm25(table(spark, sf, "documents"), "doc_id", {"body": (F.col("text"), 1.0)}, QUERY)


_DOC_SQL = sql_bm25("documents", "doc_id", {"body": ("text", 1.0)}, T.query_tokens(QUERY))


def bm25_topk_documents(spark, sf):
    return R.ranked(_documents(spark, sf).withColumn("score", R.rounded(F.col("score"))), 20, "score", "doc_id").select("doc_id", "score", "rank")


def _part_fields():
    return {"name": (F.col("p_name"), 5.0), "signature": (F.col("p_type"), 2.5), "docstring": (F.col("p_brand"), 1.5)}


def bm25f_multifield_part(spark, sf):
    scored = R.bm25(table(spark, sf, "part"), "p_partkey", _part_fields(), PART_QUERY)
    return R.top(scored.withColumn("score", R.rounded(F.col("score"))), 25, "score", "p_partkey")


def bm25_cutoff(spark, sf):
    scored = _documents(spark, sf).withColumn("score", R.rounded(F.col("score")))
    return R.gap_cutoff(scored, 50, "score", "doc_id", share=0.6).select("doc_id", "score", "rank")


def token_postings(spark, sf):
    return R.postings(table(spark, sf, "documents"), "doc_id", {"body": F.col("text")}).select("token", "doc_id", "tf")


def token_df_idf(spark, sf):
    return R.document_frequency(table(spark, sf, "documents"), F.col("text")).select("token", "df", R.rounded(F.col("idf")).alias("idf"))


def camel_tokenize(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.array_join(T.tokenize(F.col("url")), " ").alias("tokens"))


def _lines(spark, sf):
    doc = table(spark, sf, "documents")
    return doc.select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("pos", "line")).select("doc_id", (F.col("pos") + 1).alias("line_no"), "line")


def search_text_literal(spark, sf):
    return _lines(spark, sf).where(F.contains("line", F.lit("Licensed"))).orderBy("doc_id", "line_no").limit(200)


def search_text_regex_grouped(spark, sf):
    hits = _lines(spark, sf).where(F.col("line").rlike("[0-9]{4}[ -][0-9]{4}|[0-9]{16}"))
    grouped = hits.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("matches"),
        F.array_join(F.transform(F.array_sort(F.collect_list("line_no")), lambda x: x.cast("string")), ",").alias("line_numbers"),
        F.substring(F.min_by("line", "line_no"), 1, 300).alias("first_match"),
    )
    return grouped


def search_text_context(spark, sf):
    """Context is cut from the split text at the hits only, so that no window over all lines is needed."""
    doc = table(spark, sf, "documents").where(F.contains("text", F.lit("token = "))).withColumn("all", T.lines(F.col("text")))

    def around(line, pos):
        before = F.slice("all", F.greatest(pos - 1, F.lit(1)), F.least(pos, F.lit(2)))
        context = F.struct((pos + 1).alias("line_no"), line.alias("line"), F.array_join(before, "\n").alias("before"), F.array_join(F.slice("all", pos + 2, 2), "\n").alias("after"))
        return F.when(F.contains(line, F.lit("token = ")), context)

    return doc.select("doc_id", F.explode(F.filter(F.transform("all", around), lambda h: h.isNotNull())).alias("h")).select("doc_id", "h.*")


def find_references_batch(spark, sf):
    """Names are literals of the plan: each pattern is compiled once in a task, and only texts and lines that hold the name are matched."""
    doc = table(spark, sf, "documents")
    some = F.lit(False)
    for n in NAMES:
        some = some | F.contains("text", F.lit(n))
    lines = doc.where(some).select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("pos", "line"))
    named = F.array(*[F.when(F.contains("line", F.lit(n)) & P.word_in(F.col("line"), n), F.lit(n)) for n in NAMES])
    hits = lines.select("doc_id", (F.col("pos") + 1).alias("line_no"), F.explode(F.array_compact(named)).alias("name"))
    order = Window.partitionBy("name").orderBy("doc_id", "line_no")
    return hits.withColumn("n", F.row_number().over(order)).where("n <= 20").select("name", "n", "doc_id", "line_no")


def cosine_topk(spark, sf):
    vecs = table(spark, sf, "embeddings")
    query = vecs.where("vec_id = 0").select(F.lit(0).alias("query"), F.col("embedding").alias("qvec"))
    return R.nearest(vecs, "vec_id", "embedding", query, 10).select("vec_id", R.rounded(F.col("score")).alias("score"), "rank")


def semantic_knn_per_label(spark, sf):
    vecs = table(spark, sf, "embeddings")
    query = vecs.where("vec_id = 1").select(F.col("embedding").alias("qvec"))
    scored = vecs.crossJoin(F.broadcast(query)).select("label", "vec_id", R.rounded(R.cosine(F.col("embedding"), F.col("qvec"))).alias("score"))
    order = Window.partitionBy("label").orderBy(F.col("score").desc(), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where("rank <= 3")


def rrf_hybrid(spark, sf):
    lexical = R.ranked(_documents(spark, sf).withColumn("score", R.rounded(F.col("score"))), 50, "score", "doc_id")
    vecs = table(spark, sf, "embeddings")
    query = vecs.where("vec_id = 3").select(F.lit(0).alias("query"), F.col("embedding").alias("qvec"))
    semantic = R.nearest(vecs, "vec_id", "embedding", query, 50).select(F.col("vec_id").alias("doc_id"), "rank")
    fused = R.reciprocal_rank_fusion([lexical, semantic], "doc_id").withColumn("score", F.round("score", 8))
    return R.top(fused, 20, "score", "doc_id")


def rrf_multi_query(spark, sf):
    vecs = table(spark, sf, "embeddings")
    queries = vecs.where("vec_id < 5").select(F.col("vec_id").alias("query"), F.col("embedding").alias("qvec"))
    near = R.nearest(vecs, "vec_id", "embedding", queries, 30)
    fused = R.reciprocal_rank_fusion([near.select("vec_id", "rank")], "vec_id").withColumn("score", F.round("score", 8))
    return R.top(fused, 20, "score", "vec_id")


def conversation_turns(spark, sf):
    """Each assistant turn with the last user turn before it."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf, "conversations")
    user = F.when(F.col("role") == "user", F.struct("turn", "text"))
    paired = turns.withColumn("u", F.last(user, ignorenulls=True).over(order)).where("role = 'assistant' and u is not null")
    return paired.select("conv_id", "turn", F.col("u.turn").alias("user_turn"), F.length("u.text").cast("long").alias("user_chars"), F.length("text").cast("long").alias("assistant_chars"))


def conversation_bm25(spark, sf):
    turns = table(spark, sf, "conversations").withColumn("turn_key", F.col("conv_id") * 1000 + F.col("turn"))
    scored = R.bm25(turns, "turn_key", {"body": (F.col("text"), 1.0)}, TALK_QUERY)
    return R.top(scored.withColumn("score", R.rounded(F.col("score"))), 20, "score", "turn_key")


#: Patterns per category; the category with most matching patterns wins, the first of equals.
CATEGORIES = [("decision", ["(?i)we will", "(?i)license", "(?i)version"]), ("preference", ["(?i)token", "(?i)secret", "[0-9]{4}"]), ("problem", ["(?i)error", "(?i)idiot|stupid|worthless"])]


def memory_categories(spark, sf):
    doc = table(spark, sf, "documents")
    scores = [sum((F.coalesce(F.col("text").rlike(p), F.lit(False)).cast("int") for p in ps), F.lit(0)).alias(c) for c, ps in CATEGORIES]
    scored = doc.select("doc_id", *scores)
    best = F.greatest(*[F.col(c) for c, _ in CATEGORIES])
    name = F.lit("pattern")
    for c, _ in reversed(CATEGORIES):
        name = F.when((F.col(c) == best) & (best > 0), c).otherwise(name)
    return scored.select("doc_id", name.alias("category"), best.cast("long").alias("score"))


def chunk_fixed(spark, sf):
    doc = table(spark, sf, "documents")
    newlines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))

    def place(acc, start):
        """Lines are counted from chunk to chunk, not from the text's start each time."""
        piece = F.substring("text", start + 1, 1600)
        row = F.struct(start.cast("long").alias("start"), acc["line"].alias("start_line"), (acc["line"] + newlines(piece)).alias("end_line"), T.token_estimate(piece).alias("tokens"))
        return F.struct((acc["line"] + newlines(F.substring("text", start + 1, 1280))).cast("long").alias("line"), F.concat(acc["out"], F.array(row)).alias("out"))

    zero = F.struct(F.lit(1).cast("long").alias("line"), F.array().cast("array<struct<start:bigint,start_line:bigint,end_line:bigint,tokens:bigint>>").alias("out"))
    return doc.select("doc_id", F.explode(F.aggregate(T.chunk_starts(F.col("text")), zero, place, lambda acc: acc["out"])).alias("c")).select("doc_id", "c.*")


def _hit_ranges(spark, sf):
    return _lines(spark, sf).where(F.col("line").rlike("[0-9]{3}")).select("doc_id", F.col("line_no").alias("start"), (F.col("line_no") + 1).alias("end"))


def chunk_merge_adjacent(spark, sf):
    order = Window.partitionBy("doc_id").orderBy("start")
    past = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(past.isNull() | (F.col("start") > past + 5), 1).otherwise(0)
    islands = _hit_ranges(spark, sf).withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order))
    return islands.groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("pieces")).select("doc_id", "island", "start", "end", "pieces")


def token_budget_pack(spark, sf):
    scored = _documents(spark, sf).withColumn("score", R.rounded(F.col("score")))
    cost = table(spark, sf, "documents").select("doc_id", T.token_estimate(F.col("text"), 3.5).alias("cost"))
    priced = scored.join(cost, "doc_id").where("cost > 0")
    return R.within_budget(priced, 4000, "cost", F.col("score").desc(), F.col("doc_id")).select("doc_id", "score", "cost", "running")


def assemble_context_l2(spark, sf):
    """Per source: documents, characters and the best score, packed into a budget."""
    doc = table(spark, sf, "documents").select("doc_id", "source", F.length("text").alias("chars"))
    per = _documents(spark, sf).join(doc, "doc_id").groupBy("source").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("chars").alias("chars"), R.rounded(F.max("score")).alias("best"), F.min("doc_id").alias("first")
    )
    priced = per.withColumn("cost", F.ceil((F.length("source") + 40) / 3.5).cast("long"))
    return R.within_budget(priced, 200, "cost", F.col("best").desc(), F.col("source")).select("source", "docs", "chars", "best", "running")


def assemble_context_l3(spark, sf):
    doc = table(spark, sf, "documents")
    per = doc.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.count_distinct("source").alias("sources"), F.sum(F.length("text")).alias("chars"))
    priced = per.withColumn("cost", F.lit(20))
    return R.within_budget(priced, 70, "cost", F.col("docs").desc(), F.col("lang")).select("lang", "docs", "sources", "chars", F.col("running").alias("running"))


def tool_ranker(spark, sf):
    """Event types as tools: five signals, weighed."""
    usage = table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("uses"), F.avg("value").alias("v"))
    both = usage.crossJoin(F.broadcast(usage.agg(F.max("uses").alias("mu"), F.max("v").alias("mv"))))
    identity = (F.col("event_type") == "error").cast("double")
    framework = F.col("event_type").isin("view", "click").cast("double")
    score = R.tool_score(F.col("v") / F.col("mv"), identity, F.levenshtein("event_type", F.lit("error")) / 10.0, F.col("uses") / F.col("mu"), framework)
    return both.select("event_type", "uses", R.rounded(score).alias("score")).orderBy(F.col("score").desc(), "event_type").limit(10)


def range_join_hits(spark, sf):
    """The chunk that contains each hit line: hits and chunks meet on the document, then by lines."""
    hits = _lines(spark, sf).where(F.contains("line", F.lit("Licensed"))).select("doc_id", "line_no")
    chunk = chunk_fixed(spark, sf).withColumnRenamed("doc_id", "d")
    inside = hits.join(chunk, (F.col("doc_id") == F.col("d")) & F.col("line_no").between(F.col("start_line"), F.col("end_line")))
    return inside.groupBy("doc_id", "line_no").agg(F.min("start").alias("chunk_start"), F.count(F.lit(1)).alias("chunks"))


QUERIES = {f.__name__: f for f in [
    bm25_topk_documents, bm25f_multifield_part, bm25_cutoff, token_postings, token_df_idf, camel_tokenize, search_text_literal,
    search_text_regex_grouped, search_text_context, find_references_batch, cosine_topk, semantic_knn_per_label, rrf_hybrid, rrf_multi_query,
    conversation_turns, conversation_bm25, memory_categories, chunk_fixed, chunk_merge_adjacent, token_budget_pack, assemble_context_l2,
    assemble_context_l3, tool_ranker, range_join_hits,
]}

_COS = "coalesce(list_dot_product(a.embedding::double[], b.embedding::double[]) / nullif(sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])) * sqrt(list_dot_product(b.embedding::double[], b.embedding::double[])), 0), 0)"
_DOC_RANKED = f"WITH {_DOC_SQL}, s AS (SELECT k AS doc_id, round(score, 6) AS score FROM scored), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s)"
_LINES = f"SELECT doc_id, unnest(generate_series(1, len(l)))::int AS line_no, unnest(l) AS line FROM (SELECT doc_id, {sql_lines('text')} AS l FROM documents)"
_CHUNKS = """SELECT doc_id, start, length(p) - length(replace(p, chr(10), '')) + 1 AS start_line, length(p) - length(replace(p, chr(10), '')) + 1 + length(c) - length(replace(c, chr(10), '')) AS end_line, ceil(length(c) / 4.0)::bigint AS tokens
    FROM (SELECT doc_id, start, substr(text, 1, start) AS p, substr(text, start + 1, 1600) AS c FROM (SELECT doc_id, text, unnest(generate_series(0, length(text) - 1, 1280)) AS start FROM documents WHERE length(text) > 0))"""

SQL = {
    "bm25_topk_documents": f"{_DOC_RANKED} SELECT doc_id, score, rank FROM r WHERE rank <= 20",
    "bm25f_multifield_part": f"WITH {sql_bm25('part', 'p_partkey', {'name': ('p_name', 5.0), 'signature': ('p_type', 2.5), 'docstring': ('p_brand', 1.5)}, T.query_tokens(PART_QUERY))} SELECT k AS p_partkey, round(score, 6) AS score FROM scored ORDER BY 2 DESC, 1 LIMIT 25",
    "bm25_cutoff": f"{_DOC_RANKED} SELECT doc_id, score, rank FROM r WHERE rank <= 50 AND (rank <= 3 OR score >= 0.6 * (SELECT max(score) FROM r))",
    "token_postings": f"SELECT token, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({sql_tokens('text')}) AS token FROM documents) GROUP BY ALL",
    "token_df_idf": f"WITH t AS (SELECT unnest(list_distinct({sql_tokens('text')})) AS token FROM documents), c AS (SELECT token, count(*) AS df FROM t GROUP BY 1) SELECT token, df, round(ln(((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM c",
    "camel_tokenize": f"SELECT page_id, array_to_string({sql_tokens('url')}, ' ') AS tokens FROM pages",
    "search_text_literal": f"SELECT * FROM ({_LINES}) WHERE contains(line, 'Licensed') ORDER BY doc_id, line_no LIMIT 200",
    "search_text_regex_grouped": f"SELECT doc_id, count(*) AS matches, string_agg(line_no::varchar, ',' ORDER BY line_no) AS line_numbers, substr(arg_min(line, line_no), 1, 300) AS first_match FROM ({_LINES}) WHERE regexp_matches(line, '[0-9]{{4}}[ -][0-9]{{4}}|[0-9]{{16}}') GROUP BY doc_id",
    "search_text_context": f"""WITH l AS ({_LINES}) SELECT doc_id, line_no, line,
        coalesce((SELECT string_agg(b.line, chr(10) ORDER BY b.line_no) FROM l b WHERE b.doc_id = l.doc_id AND b.line_no BETWEEN l.line_no - 2 AND l.line_no - 1), '') AS before,
        coalesce((SELECT string_agg(b.line, chr(10) ORDER BY b.line_no) FROM l b WHERE b.doc_id = l.doc_id AND b.line_no BETWEEN l.line_no + 1 AND l.line_no + 2), '') AS after
        FROM l WHERE contains(line, 'token = ')""",
    "find_references_batch": f"""WITH l AS ({_LINES}), n(name) AS (VALUES {', '.join(f"('{x}')" for x in NAMES)}),
        h AS (SELECT name, doc_id, line_no, row_number() OVER (PARTITION BY name ORDER BY doc_id, line_no)::int AS n FROM l, n WHERE regexp_matches(line, '(^|[^A-Za-z0-9_])' || name || '([^A-Za-z0-9_]|$)'))
        SELECT name, n, doc_id, line_no FROM h WHERE n <= 20""",
    "cosine_topk": f"WITH s AS (SELECT a.vec_id, {_COS} AS c FROM embeddings a, embeddings b WHERE b.vec_id = 0) SELECT vec_id, round(c, 6) AS score, row_number() OVER (ORDER BY c DESC, vec_id)::int AS rank FROM s QUALIFY rank <= 10",
    "semantic_knn_per_label": f"WITH s AS (SELECT a.label, a.vec_id, round({_COS}, 6) AS score FROM embeddings a, embeddings b WHERE b.vec_id = 1) SELECT label, vec_id, score, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id)::int AS rank FROM s QUALIFY rank <= 3",
    "rrf_hybrid": f"""{_DOC_RANKED}, v AS (SELECT a.vec_id, {_COS} AS c FROM embeddings a, embeddings b WHERE b.vec_id = 3), vr AS (SELECT vec_id, row_number() OVER (ORDER BY c DESC, vec_id) AS rank FROM v),
        u AS (SELECT doc_id, rank FROM r WHERE rank <= 50 UNION ALL SELECT vec_id, rank FROM vr WHERE rank <= 50)
        SELECT doc_id, round(sum(1.0 / (60 + rank)::double), 8) AS score FROM u GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20""",
    "rrf_multi_query": f"""WITH v AS (SELECT b.vec_id AS q, a.vec_id, {_COS} AS c FROM embeddings a, embeddings b WHERE b.vec_id < 5), r AS (SELECT q, vec_id, row_number() OVER (PARTITION BY q ORDER BY c DESC, vec_id) AS rank FROM v)
        SELECT vec_id, round(sum(1.0 / (60 + rank)::double), 8) AS score FROM r WHERE rank <= 30 GROUP BY vec_id ORDER BY score DESC, vec_id LIMIT 20""",
    "conversation_turns": """WITH p AS (SELECT a.conv_id, a.turn, a.text, max(u.turn) AS user_turn FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.role = 'user' AND u.turn < a.turn WHERE a.role = 'assistant' GROUP BY ALL)
        SELECT p.conv_id, p.turn, user_turn, length(u.text) AS user_chars, length(p.text) AS assistant_chars FROM p JOIN conversations u ON u.conv_id = p.conv_id AND u.turn = user_turn""",
    "conversation_bm25": f"WITH {sql_bm25('(SELECT conv_id * 1000 + turn AS turn_key, text FROM conversations)', 'turn_key', {'body': ('text', 1.0)}, T.query_tokens(TALK_QUERY))} SELECT k AS turn_key, round(score, 6) AS score FROM scored ORDER BY 2 DESC, 1 LIMIT 20",
    "memory_categories": "WITH s AS (SELECT doc_id, "
    + ", ".join("(" + " + ".join(f"coalesce(regexp_matches(text, '{p}'), false)::int" for p in ps) + f") AS c_{c}" for c, ps in CATEGORIES)
    + " FROM documents), g AS (SELECT *, greatest(c_decision, c_preference, c_problem) AS b FROM s) SELECT doc_id, CASE WHEN b = 0 THEN 'pattern' WHEN c_decision = b THEN 'decision' WHEN c_preference = b THEN 'preference' ELSE 'problem' END AS category, b::bigint AS score FROM g",
    "chunk_fixed": _CHUNKS,
    "chunk_merge_adjacent": f"""WITH h AS (SELECT doc_id, line_no AS start, line_no + 1 AS "end" FROM ({_LINES}) WHERE regexp_matches(line, '[0-9]{{3}}')),
        f AS (SELECT *, CASE WHEN max("end") OVER (PARTITION BY doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 5 >= start THEN 0 ELSE 1 END AS fresh FROM h),
        i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY start)::bigint AS island FROM f)
        SELECT doc_id, island, min(start) AS start, max("end") AS "end", count(*) AS pieces FROM i GROUP BY doc_id, island""",
    "token_budget_pack": f"""{_DOC_RANKED}, p AS (SELECT doc_id, score, ceil(length(text) / 3.5)::bigint AS cost FROM r JOIN documents USING (doc_id)),
        c AS (SELECT *, sum(cost) OVER (ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING)::bigint AS running FROM p WHERE cost > 0) SELECT doc_id, score, cost, running FROM c WHERE running <= 4000""",
    "assemble_context_l2": f"""WITH {_DOC_SQL}, p AS (SELECT source, count(*) AS docs, sum(length(text))::bigint AS chars, round(max(score), 6) AS best FROM scored JOIN documents ON k = doc_id GROUP BY source),
        c AS (SELECT *, sum(ceil((length(source) + 40) / 3.5)) OVER (ORDER BY best DESC, source ROWS UNBOUNDED PRECEDING)::bigint AS running FROM p) SELECT source, docs, chars, best, running FROM c WHERE running <= 200""",
    "assemble_context_l3": "WITH p AS (SELECT lang, count(*) AS docs, count(DISTINCT source) AS sources, sum(length(text))::bigint AS chars FROM documents GROUP BY lang), c AS (SELECT *, (20 * row_number() OVER (ORDER BY docs DESC, lang))::bigint AS running FROM p) SELECT lang, docs, sources, chars, running FROM c WHERE running <= 70",
    "tool_ranker": """WITH u AS (SELECT event_type, count(*) AS uses, avg(value) AS v FROM events GROUP BY 1), m AS (SELECT max(uses) AS mu, max(v) AS mv FROM u)
        SELECT event_type, uses, round(v / mv + 2 * (event_type = 'error')::int + 0.8 * levenshtein(event_type, 'error') / 10.0 + 0.1 * uses / mu + 0.6 * (event_type IN ('view', 'click'))::int, 6) AS score FROM u, m ORDER BY score DESC, event_type LIMIT 10""",
    "range_join_hits": f"""WITH h AS (SELECT doc_id, line_no FROM ({_LINES}) WHERE contains(line, 'Licensed')), c AS ({_CHUNKS})
        SELECT h.doc_id, h.line_no, min(c.start) AS chunk_start, count(*) AS chunks FROM h JOIN c ON c.doc_id = h.doc_id AND h.line_no BETWEEN c.start_line AND c.end_line GROUP BY ALL""",
}
