"""Problem 9: passages of evaluation items inside corpus documents, by greedy string tiling over shared seeds."""

from __future__ import annotations

import heapq
import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import WordHashes, records, shingle_hashes, words
from loomwork.session import materialize
from loomwork.tables import load

#: Words of a seed and the shortest match that is tiled.
SEED = 8
#: Share of an item's words that must lie under tiles for a document whose longest tile is shorter than a passage.
COVERAGE = 0.5
#: Parts into which the documents of a seed are dealt where seeds meet in a join.
SALTS = 16
#: Above this many seeds the items are not broadcast but joined.
MAX_BROADCAST_SEEDS = 2_000_000
_INLINE = re.compile(r"</?(?:b|i|u|em|strong|span|font|mark|small|sub|sup|a|code)(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"<!--.*?-->|</?[a-zA-Z][^<>]*>", re.S)
#: Soft hyphens, zero-width characters, direction marks, variation selectors and the byte order mark.
_HIDDEN = [(0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180E)]
_HIDDEN += [(0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x2064), (0x2066, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF)]
_INVISIBLE = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _HIDDEN) + "]")
#: UTF-8 bytes of a character that were read as Latin-1.
_BYTE = f"[{chr(0x80)}-{chr(0xBF)}]"
_BROKEN = re.compile(f"[{chr(0xC2)}-{chr(0xDF)}]{_BYTE}|[{chr(0xE0)}-{chr(0xEF)}]{_BYTE}{{2}}")


def _repair(found: re.Match) -> str:
    try:
        return found[0].encode("latin-1").decode("utf-8")
    except UnicodeError:
        return found[0]


def plain_words(text: str) -> list[str]:
    """Lower-cased words without markup, entities, invisible characters and UTF-8 read as Latin-1."""
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _BROKEN.sub(_repair, _INVISIBLE.sub("", text))
    return words(text)


def tiles(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (doc position, item position, length) of non-overlapping common runs of at least `least`
    words, longest first, earliest first among equals. Karp-Rabin fingerprints of `least` words find the runs; runs cut
    by a marked tile go back into the queue with what is left of them."""
    a, b = shingle_hashes(doc, least), shingle_hashes(item, least)
    if not len(a) or not len(b):
        return []
    order = np.argsort(b, kind="stable")
    low, high = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    n = high - low
    i = np.repeat(np.arange(len(a)), n)
    if not len(i):
        return []
    j = order[np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(len(i))]
    by = np.lexsort((i, i - j))
    i, j = i[by], j[by]
    new = np.concatenate(([True], (np.diff(i - j) != 0) | (np.diff(i) != 1)))
    at = np.flatnonzero(new)
    length = np.diff(np.concatenate((at, [len(i)]))) + least - 1
    queue = [(-int(n), int(x), int(y)) for n, x, y in zip(length, i[at], j[at], strict=True)]
    heapq.heapify(queue)
    in_doc, in_item, out = np.zeros(len(doc), bool), np.zeros(len(item), bool), []
    while queue:
        n, x, y = heapq.heappop(queue)
        n = -n
        taken = in_doc[x : x + n] | in_item[y : y + n]
        if not taken.any():
            in_doc[x : x + n] = in_item[y : y + n] = True
            out.append((x, y, n))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([1], taken.astype(np.int8), [1]))))
        for s, e in zip(edges[::2], edges[1::2], strict=True):
            if e - s >= least:
                heapq.heappush(queue, (-int(e - s), x + int(s), y + int(s)))
    return out


class _Items:
    """Word hashes of all items and their seeds in order."""

    def __init__(self, ids: list, texts: list[str]):
        seen = WordHashes()
        self.ids, self.hashes = ids, [seen.array(plain_words(t or "")) for t in texts]
        seeds = [shingle_hashes(h, SEED) for h in self.hashes]
        seeds = [np.unique(s) for s in seeds]
        owner = np.repeat(np.arange(len(ids)), [len(s) for s in seeds])
        joined = np.concatenate(seeds) if seeds else np.empty(0, np.uint64)
        order = np.argsort(joined, kind="stable")
        self.seeds, self.owner = joined[order], owner[order]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self.seeds >> np.uint64(42)] = True

    def candidates(self, doc: np.ndarray, least: int, coverage: float) -> np.ndarray:
        """Items whose seeds stand at as many positions of the document as any leak has, see _hits; one that repeats a seed
        counts once for each of the document's."""
        probe = shingle_hashes(doc, SEED)
        probe = probe[self.maybe[probe >> np.uint64(42)]]
        low = np.searchsorted(self.seeds, probe, "left")
        n = np.searchsorted(self.seeds, probe, "right") - low
        if not n.any():
            return np.empty(0, np.int64)
        owners = self.owner[np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
        hits = np.bincount(owners)
        found = np.flatnonzero(hits)
        return np.array([k for k in found if hits[k] >= _hits(len(self.hashes[k]), least, coverage)], np.int64)


def _hits(item_words: int, least: int, coverage: float) -> int:
    """The fewest positions of a document at which a leak has seeds of the item: a run of `least` words has
    least - SEED + 1, and words under tiles have one for SEED of them at least."""
    return min(least - SEED + 1, math.ceil(max(least, coverage * item_words) / SEED))


_PAIR_SCHEMA = "doc_id bigint, item_id bigint, longest int, covered int, item_words int"


def _measure(doc: np.ndarray, item: np.ndarray, least: int, coverage: float) -> tuple[int, int] | None:
    """(longest tile, words under tiles), None if neither makes a leak."""
    found = tiles(doc, item, SEED)
    if not found:
        return None
    longest, covered = max(t[2] for t in found), sum(t[2] for t in found)
    return (longest, covered) if longest >= least or covered >= max(least, coverage * len(item)) else None


def leaked_pairs(docs: DataFrame, items: DataFrame, least: int = 20, coverage: float = COVERAGE) -> DataFrame:
    """docs(doc_id, text), items(item_id, text) -> (doc_id, item_id, longest, covered, item_words) for each document
    and item with a common run of at least `least` words, or whose common runs of at least SEED words cover `coverage` of
    the item (and `least` words), in whatever order the document has them: passages that were cut up, reordered or edited
    here and there. covered counts the words of the item under all tiles. Null and empty texts leak nothing; ids that are
    repeated count once (the smallest text of an item); repeated rows of a document give one row.

    Every leak of either kind is found: seeds are looked up at every position of a document. Documents are read once. The
    items are broadcast while their seeds number at most MAX_BROADCAST_SEEDS, which is checked; beyond that, seeds meet in
    a join, where the documents of every seed are dealt to SALTS tasks, however many share it.
    """
    if least < SEED:
        raise ValueError(f"least must be at least {SEED}")
    spark = docs.sparkSession
    held = records(items.where(F.col("text").isNotNull()), ["item_id"], ["text"])
    docs = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    size = held.agg(F.sum(F.octet_length("text") / 2)).first()[0] or 0  # a word takes two bytes or more
    if size <= MAX_BROADCAST_SEEDS:
        rows = held.orderBy("item_id").collect()
        shared = spark.sparkContext.broadcast(_Items([r[0] for r in rows], [r[1] for r in rows]))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known, seen = shared.value, WordHashes()
            for pdf in batches:
                out = []
                for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                    tokens = plain_words(text)
                    if len(tokens) < least:
                        continue
                    doc = seen.array(tokens)
                    for k in known.candidates(doc, least, coverage):
                        got = _measure(doc, known.hashes[k], least, coverage)
                        if got:
                            out.append((doc_id, known.ids[k], *got, len(known.hashes[k])))
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "longest", "covered", "item_words"])

        return docs.mapInPandas(scan, _PAIR_SCHEMA).dropDuplicates(["doc_id", "item_id"])

    def seed_rows(name: str):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen = WordHashes()
            for pdf in batches:
                for key, text in zip(pdf[name], pdf["text"], strict=True):
                    tokens = plain_words(text)
                    got, n = np.unique(shingle_hashes(seen.array(tokens), SEED), return_counts=True)
                    hits = _hits(len(tokens), least, coverage)
                    yield pd.DataFrame({"seed": got.view(np.int64), name: key, "n": n, "hits": hits})

        return run

    left = docs.mapInPandas(seed_rows("doc_id"), "seed bigint, doc_id bigint, n bigint, hits bigint").drop("hits").distinct()
    right = held.mapInPandas(seed_rows("item_id"), "seed bigint, item_id bigint, n bigint, hits bigint").drop("n")
    left = left.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pairs = left.join(right, ["seed", "salt"]).groupBy("doc_id", "item_id").agg(F.sum("n").alias("n"), F.first("hits").alias("hits"))
    pairs = materialize(pairs.where(F.col("n") >= F.col("hits")).select("doc_id", "item_id"))
    both = pairs.join(docs.withColumnRenamed("text", "a"), "doc_id").join(held.withColumnRenamed("text", "b"), "item_id")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = WordHashes()
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                item = seen.array(plain_words(r.b))
                got = _measure(seen.array(plain_words(r.a)), item, least, coverage)
                if got:
                    out.append((r.doc_id, r.item_id, *got, len(item)))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "longest", "covered", "item_words"])

    return both.select("doc_id", "item_id", "a", "b").mapInPandas(verify, _PAIR_SCHEMA).dropDuplicates(["doc_id", "item_id"])


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_pairs(load(spark, sf_dir, "documents"), load(spark, sf_dir, "heldout_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).where(F.col("longest") >= 20).select("doc_id", "item_id")


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each leaked item the documents that hold a passage of it, those that hold it in shorter pieces only, those that
    cover at least half of it, and the longest run."""
    rows = _leaks(spark, sf_dir).groupBy("item_id").agg(
        F.count_if(F.col("longest") >= 20).alias("documents"),
        F.count_if(F.col("longest") < 20).alias("in_pieces"),
        F.count_if(F.col("covered") * 2 >= F.col("item_words")).alias("half_covered"),
        F.max("longest").cast("long").alias("longest_run"),
    )
    return rows.join(load(spark, sf_dir, "heldout_items").select("item_id", "dataset_split", "item_type").dropDuplicates(["item_id"]), "item_id")


_FOUND_SQL = r"""
with t as (select doc_id, any_value(text) x from documents group by doc_id),
c as (select doc_id, regexp_replace(regexp_replace(regexp_replace(x, '</?(b|i|u|em|strong|span|font|mark|small|sub|sup|a|code)(\s[^<>]*)?/?>', '', 'g'),
      '</?[a-zA-Z][^<>]*>', ' ', 'g'), '[\x{ad}\x{200b}-\x{200f}\x{2060}-\x{2064}\x{feff}]', '', 'g') x from t where x is not null),
w as (select doc_id, regexp_extract_all(lower(x), '[\p{L}\p{N}]+') w from c),
d as (select distinct doc_id, unnest([array_to_string(w[i:i+19], ' ') for i in range(1, len(w) - 18)]) g from w where len(w) >= 20),
v as (select item_id, regexp_extract_all(lower(any_value(text)), '[\p{L}\p{N}]+') w from heldout_items group by item_id),
i as (select distinct item_id, unnest([array_to_string(w[i:i+19], ' ') for i in range(1, len(w) - 18)]) g from v where len(w) >= 20)
select distinct doc_id, item_id from d join i using (g)
"""

QUERIES = {"p9_found": p9_found, "p9_items": p9_items}
ORACLE = {"p9_found": _FOUND_SQL}
