"""Seams for models and extractors that live outside the engine: structured answers, and failures that are counted."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class StructuredModel(Protocol):
    """Anything that answers a prompt with JSON that follows a schema."""

    name: str

    def generate(self, prompt: str, schema: dict) -> dict: ...


def strict_schema(schema: dict) -> dict:
    """A JSON schema in the strict form that model services ask for: every object at any depth forbids other properties (unless
    it says something about them itself) and requires all of its own. The input stays as it is."""
    out = json.loads(json.dumps(schema))
    waiting = [out]
    while waiting:
        node = waiting.pop()
        if isinstance(node, list):
            waiting += node
        elif isinstance(node, dict):
            own = node.get("properties")
            if isinstance(own, dict) or node.get("type") == "object":
                node.setdefault("additionalProperties", False)
            if isinstance(own, dict):
                node["required"] = list(own)
            waiting += node.values()
    return out


def generate(df: DataFrame, key: str, prompt: str, model: Callable[[], StructuredModel], schema: dict) -> DataFrame:
    """(key, answer, error): the JSON answer to every prompt, or why there is none. model builds a client, once a task; a failing
    row stops no other."""
    strict = strict_schema(schema)
    return extract(df, key, prompt, lambda: (lambda made: lambda text: made.generate(text, strict))(model())).withColumnRenamed("result", "answer")


def extract(df: DataFrame, key: str, text: str, extractor: Callable[[], Callable[[str], dict]]) -> DataFrame:
    """(key, result, error): what an extractor makes of each text, as JSON, or its error. Null texts have the error 'no text'.
    No row is lost: failures() counts them."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = extractor()
        for pdf in batches:
            out = []
            for k, t in zip(pdf["k"], pdf["t"], strict=True):
                try:
                    out.append((k, json.dumps(call(t), ensure_ascii=False), None) if t is not None else (k, None, "no text"))
                except Exception as e:  # the row's error, whatever the extractor raises
                    out.append((k, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["k", "result", "error"])

    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return rows.mapInPandas(run, f"k {kind}, result string, error string").withColumnRenamed("k", key)


def failures(extracted: DataFrame) -> DataFrame:
    """(error, rows), the number of rows without a result by kind of error, and of those with one (error null)."""
    return extracted.groupBy(F.split_part("error", F.lit(":"), F.lit(1)).alias("error")).agg(F.count("*").alias("rows"))
