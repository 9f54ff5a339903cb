"""Keeping bodies of documents out of logs, in rows and in log records."""

from __future__ import annotations

import logging
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

#: Names of fields whose values are never logged, and what stands for them. Fixed values.
SENSITIVE = ("raw_text", "parsed_profile", "chunk_text", "text", "raw_text_body")
MASK = "[REDACTED]"


def _hidden(value: Column, kind: DataType, names: frozenset[str]) -> Column:
    if isinstance(kind, StructType):
        fields = [_masked(value[f.name], f.name, f.dataType, names).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, (StructType, ArrayType, MapType)):
        return F.transform(value, lambda x: _hidden(x, kind.elementType, names))
    if isinstance(kind, MapType):
        mask = lambda k, v: F.when(F.lower(k.cast("string")).isin(*names), F.lit(MASK)).otherwise(v.cast("string"))
        return F.transform_values(value, mask)
    return value


def _masked(value: Column, name: str, kind: DataType, names: frozenset[str]) -> Column:
    return F.when(value.isNotNull(), F.lit(MASK)) if name.lower() in names else _hidden(value, kind, names)


def redacted(df: DataFrame, names: tuple[str, ...] = SENSITIVE) -> DataFrame:
    """df with the values of the named fields masked, at any depth of structs, arrays and maps (whose other values become
    text); nulls stay null. The expression follows the schema, so nothing is collected and no function runs in Python."""
    known = frozenset(n.lower() for n in names)
    return df.select(*[_masked(F.col(f"`{f.name}`"), f.name, f.dataType, known).alias(f.name) for f in df.schema.fields])


def mask(value: Any, names: tuple[str, ...] = SENSITIVE) -> Any:
    """The same for plain Python values."""
    if isinstance(value, dict):
        return {k: MASK if k in names and v is not None else mask(v, names) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return type(value)([mask(v, names) for v in value])
    return value


class MaskingFilter(logging.Filter):
    """Masks the message and arguments of every record that passes."""

    def filter(self, record: logging.LogRecord) -> bool:
        record.msg, record.args = mask(record.msg), mask(record.args)
        return True
