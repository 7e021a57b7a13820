"""Named queries over the given tables, with SQL twins."""

from __future__ import annotations

from . import claims, documents, evidence, folds, graphs, policies, retrieval, rules, scores, texts, validation

MODULES = (retrieval, texts, documents, folds, graphs, scores, evidence, claims, policies, rules, validation)


def queries() -> dict:
    return {name: query for m in MODULES for name, (query, _) in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
