"""The queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomwork.llm import canonical, groups, leaks, neighbours, overlap, packing, pii, split, stuffing, topn

_MODULES = (overlap, groups, neighbours, canonical, pii, topn, split, packing, leaks, stuffing)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
