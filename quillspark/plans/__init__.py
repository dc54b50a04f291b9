"""Named queries over the test tables, with their SQL for an independent engine."""

from . import code, graphs, search, texts, usage

_MODULES = [search, usage, graphs, texts, code]
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
