"""Problem 8: documents combined into containers of a fixed number of tokens with little space left over."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.session import materialize
from loomwork.tables import load

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CAPACITY = 2048
#: Items that are packed together by one task.
BLOCK = 8192
#: The search works on containers filled to less than this; what it leaves filled to less than REPACK is packed again,
#: together with what MERGE - 1 other blocks left.
UNDERFULL, REPACK, MERGE = 0.995, 0.95, 256
#: The published splitting pattern of the byte-level vocabulary. Fixed value.
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
    return tiktoken.Encoding("documents", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, item: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(item, tokens) of every text under a public tokenizer whose file all executors have at `vocabulary`. Null and
    empty texts have none and are left out."""
    kind = dict(docs.dtypes)[item]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(vocabulary).encode_ordinary
        for pdf in batches:
            n = [len(encode(t)) for t in pdf["t"]]
            yield pd.DataFrame({"item": pdf["item"], "tokens": np.array(n, np.int64)})

    rows = docs.select(F.col(item).alias("item"), F.col(text).alias("t")).where("item is not null and t is not null and t <> ''")
    return rows.mapInPandas(run, f"item {kind}, tokens long")


def next_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of every size, in the order they come: a bin is closed by the first item that doesn't fit. A cheap start that
    leaves much space; the local search does the packing."""
    where, b, used = np.empty(len(sizes), np.int64), 0, 0
    for i, s in enumerate(sizes.tolist()):
        used += s
        if used > capacity:
            b, used = b + 1, s
        where[i] = b
    return where


def improve(sizes: np.ndarray, where: np.ndarray, capacity: int, underfull: float = UNDERFULL) -> np.ndarray:
    """Local search that raises the sum of squared fills until bins become empty. A bin filled to less than `underfull`
    gives an item to a fuller bin with room, swaps one item for a smaller one of a fuller bin, or gives two for one,
    always the move that takes most out of it. Rounds over these bins, emptiest first, go on until none changes; no
    more bins than the sum of sizes needs means done."""
    where = where.copy()
    fill = np.bincount(where, sizes, minlength=int(where.max()) + 1).astype(np.int64)
    need, used, changed = -(-int(sizes.sum()) // capacity), int((fill > 0).sum()), True
    while changed and used > need:
        changed = False
        for a in np.argsort(fill, kind="stable"):
            if used <= need or fill[a] >= underfull * capacity:
                break
            while fill[a] > 0 and (move := _best_move(sizes, where, fill, int(a), capacity)):
                given, taken, b = move
                gain = int(sizes[given].sum() - sizes[taken].sum())
                where[given], where[taken] = b, a
                fill[b] += gain
                fill[a] -= gain
                changed = True
                used -= int(fill[a] == 0)
    return np.unique(where, return_inverse=True)[1]


def _best_move(sizes: np.ndarray, where: np.ndarray, fill: np.ndarray, a: int, capacity: int) -> tuple[list[int], list[int], int] | None:
    """(items given, items taken, the other bin) of the move that takes most out of bin a; None if there is none."""
    mine = np.flatnonzero(where == a)
    room = np.where((fill > 0) & (fill >= fill[a]), capacity - fill, -1)
    room[a] = -1
    others = room[where]  # what the bin of each item can still take, -1 where it may not
    best: tuple[int, tuple | None] = (0, None)
    for y in mine:
        s = int(sizes[y])
        if room.max() >= s > best[0]:
            best = (s, ([int(y)], [], int(np.where(room >= s, room, capacity + 1).argmin())))
    given = [[int(y)] for y in mine] + [[int(y), int(z)] for i, y in enumerate(mine) for z in mine[i + 1 :]]
    for g in given:
        delta = int(sizes[g].sum()) - sizes
        gain = np.where((others >= 0) & (delta <= others), delta, 0)
        x = int(gain.argmax())
        if gain[x] > best[0]:
            best = (int(gain[x]), (g, [x], int(where[x])))
    return best[1]


def pack(items: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, expected: int | None = None) -> DataFrame:
    """items(item, tokens) -> (item, part, first_token, tokens, container). No container holds more than capacity; an item is
    split only if it alone exceeds the capacity: into full containers and a remainder that is packed like an item.
    Items without tokens or id are left out, repeated items count once (the longest).

    Items are dealt to blocks of about `block` by hash. A block starts from next fit and is packed by local search, one task
    for one or more blocks; the number of tasks follows the cores, not the items. The few containers that a block leaves
    underfull are opened again and packed together with those of other blocks, until one block is left over.
    """
    kind = dict(items.dtypes)["item"]
    rows = items.where("item is not null and tokens > 0").groupBy("item").agg(F.max("tokens").alias("tokens"))
    blocks = max(1, -(-(expected if expected is not None else items.count()) // block))
    tasks = 8 * items.sparkSession.sparkContext.defaultParallelism

    def run_level(level: int, final: bool):
        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["item", "part"], kind="stable")
            size, ids, begin, first = (pdf[c].to_numpy() for c in ("tokens", "item", "part", "first_token"))
            whole, rest = size // capacity, size % capacity
            owner = np.repeat(np.arange(len(size)), whole)
            part = np.arange(len(owner)) - np.repeat(np.cumsum(whole) - whole, whole)
            small = np.flatnonzero(rest)
            n, where = len(owner), np.empty(0, np.int64)
            again = np.empty(0, bool)
            if len(small):
                where = improve(rest[small], next_fit(rest[small], capacity), capacity)
                again = (np.bincount(where, rest[small]) < REPACK * capacity)[where] & (not final)
            return pd.DataFrame(
                {
                    "item": np.concatenate((ids[owner], ids[small])),
                    "part": np.concatenate((begin[owner] + part, begin[small] + whole[small])),
                    "first_token": np.concatenate((first[owner] + part * capacity, first[small] + whole[small] * capacity)),
                    "tokens": np.concatenate((np.full(n, capacity), rest[small])),
                    "container": [f"{level}-{key[0]}-{c}" for c in np.concatenate((np.arange(n), n + where))],
                    "again": np.concatenate((np.zeros(n, bool), again)),
                }
            )

        return run

    out, level = None, 0
    rows = rows.withColumn("part", F.lit(0).cast("bigint")).withColumn("first_token", F.lit(0).cast("bigint"))
    while True:
        keyed = rows.withColumn("block", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(blocks)))
        # a stated number of partitions, or the adaptive planner would give the few bytes of all blocks to one task
        keyed = keyed.repartition(min(blocks, tasks), "block")
        schema = f"item {kind}, part long, first_token long, tokens long, container string, again boolean"
        packed = keyed.groupBy("block").applyInPandas(run_level(level, blocks == 1), schema)
        if blocks > 1:
            packed = materialize(packed)
        done = packed.where("not again").drop("again")
        out = done if out is None else out.unionByName(done)
        if blocks == 1:
            return out
        rows, blocks, level = packed.where("again").drop("again", "container"), -(-blocks // MERGE), level + 1


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    packed = pack(token_counts(docs, "doc_id", "text"), expected=docs.count())
    return packed.withColumnRenamed("item", "doc_id")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill of every container."""
    rows = p8_packed(spark, sf_dir).groupBy("container").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("tokens"))
    return rows.withColumn("unused", F.lit(CAPACITY).cast("long") - F.col("tokens"))


QUERIES = {"p8_packed": p8_packed, "p8_containers": p8_containers}
ORACLE: dict[str, str] = {}
