"""All queries of the core, by name, with their SQL where SQL can say them."""

from __future__ import annotations

from strandloom.plans import abundances, alignments, formats, records, sequences

MODULES = [records, sequences, alignments, abundances, formats]


def all_queries():
    return {name: fn for m in MODULES for name, (fn, _) in m.QUERIES.items()}


def all_sql():
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
