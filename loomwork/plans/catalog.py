"""All queries that aren't operators for training data, with their SQL."""

from __future__ import annotations

from loomwork.plans import datasets, evaluation, matching, services, stores, texts

_MODULES = [texts, matching, datasets, evaluation, stores, services]


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
