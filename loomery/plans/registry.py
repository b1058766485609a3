"""All queries outside the training-data subpackage, by name."""

from __future__ import annotations

from . import data_queries, facet_queries, filter_queries, library_queries, neighbour_queries, record_queries, report_queries, structure_queries

MODULES = (filter_queries, facet_queries, data_queries, library_queries, neighbour_queries, record_queries, report_queries, structure_queries)


def queries():
    return {name: q for m in MODULES for name, q in m.queries().items()}


def oracle_sql():
    return {name: sql for m in MODULES for name, sql in m.oracle_sql().items()}
