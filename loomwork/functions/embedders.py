"""Text embedders as DataFrame transforms; every distinct text is embedded once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from loomwork.session import fresh


class StubEmbedder:
    """The test formula [length % 7 + 1, 1, 0, 0], inside the JVM."""

    dimension = 4

    def transform(self, df: DataFrame, text: str, out: str) -> DataFrame:
        return df.withColumn(out, F.when(F.col(text).isNotNull(), F.array((F.length(text) % 7 + 1).cast("double"), F.lit(1.0), F.lit(0.0), F.lit(0.0))))


class HashingEmbedder:
    """Signed hashing of words into a fixed number of dimensions, at length 1; no model file is needed."""

    def __init__(self, dimension: int = 256):
        self.dimension = dimension

    def transform(self, df: DataFrame, text: str, out: str) -> DataFrame:
        n = self.dimension

        @F.pandas_udf(ArrayType(DoubleType()))
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                rows = []
                for t in s:
                    v = np.zeros(n)
                    for w in (t or "").lower().split():
                        h = xxhash.xxh3_64_intdigest(w)
                        v[h % n] += 1 if h >> 63 else -1
                    size = np.linalg.norm(v)
                    rows.append(None if t is None else (v / size if size else v).tolist())
                yield pd.Series(rows)

        return df.withColumn(out, run(F.col(text)))


class ModelEmbedder:
    """A model that is loaded once a worker: load() returns a function from a list of texts to a matrix."""

    def __init__(self, load: Callable[[], Callable[[list[str]], np.ndarray]], dimension: int):
        self.load, self.dimension = load, dimension

    def transform(self, df: DataFrame, text: str, out: str) -> DataFrame:
        load = self.load

        @F.pandas_udf(ArrayType(DoubleType()))
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for s in batches:
                yield pd.Series([list(map(float, v)) for v in model([t or "" for t in s])])

        return df.withColumn(out, run(F.col(text)))


def embed(df: DataFrame, text: str, out: str, embedder) -> DataFrame:
    """df with the vector of its text: distinct texts are embedded once and joined back; null texts get null."""
    if out in df.columns:
        raise ValueError(f"{out} is a column already")
    key = fresh(df.columns, "_text_hash")
    hashed = df.withColumn(key, F.xxhash64(text, F.length(text)))
    once = embedder.transform(hashed.where(F.col(text).isNotNull()).select(key, F.col(text).alias("_t")).dropDuplicates([key, "_t"]), "_t", "_v")
    same = (hashed[key] == once[key]) & (hashed[text] == once["_t"])
    return hashed.join(once, same, "left").select(*[hashed[c] for c in df.columns], once["_v"].alias(out))
