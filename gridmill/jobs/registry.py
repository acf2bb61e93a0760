"""All queries of the field and run operators, with their SQL."""

from __future__ import annotations

from gridmill.jobs import field_queries, run_queries, stream_queries

FLAGSHIP = "transfer_floor"
_ALL = {**field_queries.QUERIES, **run_queries.QUERIES, **stream_queries.QUERIES}


def queries() -> dict:
    return {name: f for name, (f, _) in _ALL.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
