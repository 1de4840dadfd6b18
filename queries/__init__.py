"""Registered queries on the given tables, each with the SQL that must give the same rows."""

from . import documents, extraction, ingest, notices, stores, texts

MODULES = (notices, texts, ingest, stores, documents, extraction)


def all_queries():
    merged = {}
    for module in MODULES:
        for name, (query, sql) in module.QUERIES.items():
            assert name not in merged, name
            merged[name] = (query, sql)
    return merged
