"""What several operators for training data share."""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A word is a run of letters and digits.
WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)


def records(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row for each key: rows with the same id count once (the smallest wins, so the choice is always the same).
    Rows with a null key are left out; other columns are dropped, so their names can't clash."""
    rows = df.dropna(subset=keys).select(*keys, F.struct(*values).alias("_v"))
    return rows.groupBy(*keys).agg(F.min("_v").alias("_v")).select(*keys, *[F.col(f"_v.{v}").alias(v) for v in values])


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class WordHashes(dict):
    """64-bit hashes of words, remembered; forgets everything at a million words so that memory stays bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h

    def array(self, tokens: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words, in order."""
    n = len(hashes) - k + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = (out ^ hashes[i : i + n]) * _MIX
            out ^= out >> np.uint64(29)
        out *= _MIX2
    return out ^ (out >> np.uint64(32))
