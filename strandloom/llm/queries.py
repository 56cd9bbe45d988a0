"""Queries of the training-data operators and their SQL, by name."""

from __future__ import annotations

from strandloom.llm import algorithm_queries, text_queries

MODULES = [algorithm_queries, text_queries]


def all_queries():
    return {name: fn for m in MODULES for name, (fn, _) in m.QUERIES.items()}


def all_sql():
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
