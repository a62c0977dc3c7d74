"""All queries of the library by name, each with its SQL where SQL can say it."""

from __future__ import annotations

from . import content_queries, join_queries, numeric_queries, record_queries, source_queries, state_queries, structure_queries, text_queries

CATALOGUE = {**text_queries.QUERIES, **join_queries.QUERIES, **numeric_queries.QUERIES, **record_queries.QUERIES, **content_queries.QUERIES, **source_queries.QUERIES, **structure_queries.QUERIES, **state_queries.QUERIES}


def queries() -> dict:
    return {name: run for name, (run, _) in CATALOGUE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CATALOGUE.items() if sql}
