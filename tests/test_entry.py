"""The entry module's contract."""

import __spark_entry__ as entry_module


def test_entry_and_names(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["doc_id", "score", "rank"] and df.count() > 0
    queries, sql = entry_module.queries(), entry_module.oracle_sql()
    assert set(sql) <= set(queries) and all(callable(q) for q in queries.values())
    if entry_module.llm_queries is not None:
        assert [sum(q.startswith(f"op{n}_") for q in queries) for n in range(1, 11)] == [1] * 10
