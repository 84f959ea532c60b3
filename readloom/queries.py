"""Registered queries of the library and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from readloom.plans import file_queries, overlap_queries, read_queries, report_queries, text_queries

_ALL = overlap_queries.QUERIES | read_queries.QUERIES | report_queries.QUERIES | file_queries.QUERIES | text_queries.QUERIES


def queries() -> dict[str, Callable]:
    return {k: q for k, (q, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _ALL.items() if sql}
