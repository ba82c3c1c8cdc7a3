"""The registered queries: each pairs a Spark callable with the SQL that states the same result on the driver tables."""

from __future__ import annotations

from codeweft.catalog import classes, extraction, graph, questions, resolution, search, stored, streams, suggestion, text

_MODULES = [search, text, graph, resolution, suggestion, extraction, questions, streams, stored, classes]


def all_queries() -> dict:
    return {name: run for module in _MODULES for name, (run, _) in module.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, (_, sql) in module.QUERIES.items() if sql}
