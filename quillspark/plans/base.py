"""What the query modules share: table access, and SQL fragments for the independent engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_tokens(e: str) -> str:
    """The tokenizer, in SQL."""
    spaced = rf"regexp_replace(regexp_replace(coalesce({e}, ''), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')"
    return f"list_transform(list_filter(string_split_regex({spaced}, '[^a-zA-Z0-9]+'), lambda x: length(x) >= 2), lambda x: lower(x))"


def sql_lines(e: str) -> str:
    return f"string_split(coalesce({e}, ''), chr(10))"


def sql_bm25(source: str, key: str, fields: dict[str, tuple[str, float]], query_terms: list[str]) -> str:
    """CTEs ``q, d, scored(key, score)`` that rank the rows of a table."""
    from collections import Counter

    terms = Counter(query_terms)
    q = ", ".join(f"('{t}', {n})" for t, n in terms.items())
    union = " UNION ALL ".join(f"SELECT '{f}' AS field, {w} AS w, {key} AS k, {sql_tokens(e)} AS toks FROM {source}" for f, (e, w) in fields.items())
    return f"""
        q(term, mult) AS (VALUES {q}),
        d AS ({union}),
        st AS (SELECT field, count(*) AS n, avg(len(toks)) AS al FROM d GROUP BY field),
        tf AS (SELECT d.field, d.w, d.k, len(d.toks) AS dl, q.term, q.mult, len(list_filter(d.toks, lambda x: x = q.term)) AS tf FROM d, q),
        dfs AS (SELECT field, term, sum((tf > 0)::int) AS df FROM tf GROUP BY field, term),
        scored AS (
            SELECT k, sum(w * mult * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * CASE WHEN al > 0 THEN dl / al ELSE 1 END))) AS score
            FROM tf JOIN dfs USING (field, term) JOIN st USING (field) GROUP BY k HAVING sum(tf) > 0)"""
