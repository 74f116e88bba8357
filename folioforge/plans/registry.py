"""All named queries of the document operators, and the SQL that each must agree with."""

from . import layout_queries, page_queries, run_queries

QUERIES: dict = {}
ORACLES: dict = {}
for module in (page_queries, layout_queries, run_queries):
    for name, (query, sql) in module.ALL.items():
        QUERIES[name] = query
        if sql:
            ORACLES[name] = sql
