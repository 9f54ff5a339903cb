"""Problem 10: pages of keywords, tags, product tags or links, by pointwise mutual information of neighbouring words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.session import materialize
from loomwork.tables import load

#: A word or a pair of words is taken for no rarer than half of one in RARE (a pair: a twentieth) when PMI is smoothed.
RARE = 1 << 21
#: Counts of words and pairs that are broadcast: all of them, or, where there are more, those of at least one in HELD / 2 of
#: all words or pairs, of which there are no more than that. The others meet their pages in joins.
HELD = 1 << 22
#: A collocation is repeated excessively if a page has it REPEATS times and EXCESS times as often as the rest of the corpus
#: lets expect; one that makes up DOMINANT of a page's pairs needs to come but DOMINANT_REPEATS times.
REPEATS, EXCESS, DOMINANT_REPEATS, DOMINANT = 6, 8.0, 3, 0.04
#: Limits between classes of PMI, and of PMI with the joint frequency squared, which doesn't favour rare pairs. The shares of
#: a page's pairs in each class tell how its neighbours hang together: sentences have few in the low classes and many in the
#: middle ones, word salad has many in the low ones, lists of set phrases have low and very high ones and little between.
PMI_LIMITS, PMI2_LIMITS = (-3.0, -1.0, 0.0, 3.0, 6.0), (-11.0, -8.0, -5.0, -2.0)
_CLASSES = [*[f"pmi_{k}" for k in range(len(PMI_LIMITS) + 1)], *[f"pmi2_{k}" for k in range(len(PMI2_LIMITS))]]
_PAIR_FEATURES = ["mean_pmi", "square_pmi", "dominant_share", "repeated_share", *_CLASSES]
FEATURES = ["mean_pmi", "spread_pmi", *_PAIR_FEATURES[2:]]
#: What must never count for sentences: repetition and pairs of low PMI; a high mean PMI must not count against them.
_NOT_NEGATIVE = {"dominant_share", "repeated_share", "pmi_0", "pmi_1", "pmi_2", "pmi2_0", "pmi2_1"}
#: A page is found if the weighted sum of FEATURES plus BIAS is above 0; see fit().
WEIGHTS = (0.000, 2.620, 35.401, 20.556, 0.000, 6.528, 68.779, 10.190, 29.782, 21.055, 21.968, 21.757, -14.284, -24.568)
BIAS = -37.406
#: Below this mean PMI nothing on a page hangs together: it is word salad, whatever the other features say.
SALAD = -2.5
#: A link counts as so many words that are all the same, whatever its address; the words of its text come on top.
LINK_WORDS = 3
_LINK = chr(0xE000)
_LINKS = " ".join([_LINK] * LINK_WORDS)
_ANCHOR = re.compile(r"<a\s[^>]*>(.*?)</a>|!?\[([^\]\n]*)\]\([^)\s]*\)", re.I | re.S)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_URL = r"(?:\bhttps?:)?//[^\s<>]+|\bwww\.[^\s<>]+"


def _markup(text: str) -> str:
    return _TAG.sub(" ", _ANCHOR.sub(lambda m: f" {_LINKS} {m[1] or m[2] or ''} ", text))


class Tokens:
    """All words of a batch of texts as arrays: the document and the hash of each. All numbers are one word."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts, "")
        texts = pc.replace_substring_regex(texts, f"[{_LINK}{chr(0xAD)}]", "")
        marked = pc.or_(pc.match_substring(texts, "<"), pc.match_substring(texts, "](")).to_numpy(zero_copy_only=False)
        if marked.any():
            at = np.flatnonzero(marked)
            changed = pa.array([_markup(t) for t in texts.take(pa.array(at)).to_pylist()], pa.string())
            texts = pc.replace_with_mask(texts, pa.array(marked), changed)
        texts = pc.replace_substring_regex(pc.utf8_lower(texts), _URL, f" {_LINKS} ")
        lists = pc.split_pattern_regex(texts, rf"[^\p{{L}}\p{{N}}{_LINK}]+")
        doc = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
        coded = lists.flatten().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        names = coded.dictionary.to_pylist()
        hashes = np.array([xxhash.xxh3_64_intdigest("0" if w.isdigit() else w) if w else 0 for w in names], np.uint64)
        word = np.array([bool(w) for w in names], bool)[code] if len(names) else np.empty(0, bool)
        self.n = len(texts)
        self.doc, self.hash = doc[word], hashes[code[word]] if len(names) else np.empty(0, np.uint64)
        self.pair = np.flatnonzero(self.doc[1:] == self.doc[:-1]) if len(self.doc) else np.empty(0, np.int64)

    def pair_hash(self) -> np.ndarray:
        with np.errstate(over="ignore"):
            a, b = self.hash[self.pair], self.hash[self.pair + 1]
            return (a * np.uint64(0x9E3779B97F4A7C15) ^ (b + (a << np.uint64(7)))) * np.uint64(0xC2B2AE3D27D4EB4F)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        t = Tokens(batch.column(0))
        for kind, values in ((1, t.hash), (2, t.pair_hash())):
            keys, n = np.unique(values, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["kind", "key", "n"])


class _Counts:
    """Sorted keys with counts; a key that isn't there counts 0."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        keys = keys.view(np.uint64)
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order]

    def of(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        return np.where(self.keys[at] == keys, self.counts[at], 0) if len(self.keys) else np.zeros(len(keys), np.int64)


def _own(doc: np.ndarray, code: np.ndarray, kinds: int) -> np.ndarray:
    """How often each position's key (a number below kinds) occurs in its own document."""
    _, back, n = np.unique(doc * max(1, kinds) + code, return_inverse=True, return_counts=True)
    return n[back]


def _measures(pairs, left, right, own, size, n_pairs: int, floor_w: float, floor_p: float, lib) -> list:
    """Values of _PAIR_FEATURES for single pairs. pairs, left, right: counts in the other pages; own: the pair's count in its
    page; size: pairs of its page. lib is numpy or Spark's functions: both paths share the arithmetic."""
    pmi = lib.log((pairs + floor_p) * n_pairs / ((left + floor_w) * (right + floor_w)))
    pmi2 = pmi + lib.log((pairs + floor_p) / n_pairs)
    excess = own > EXCESS * (pairs + 0.5) / n_pairs * size
    dominant = (own >= DOMINANT_REPEATS) & (own >= DOMINANT * size) & excess
    between = lambda x, limits: [(x >= a) & (x < b) for a, b in zip((-1e9, *limits), limits, strict=False)]
    return [pmi, pmi * pmi, dominant, (own >= REPEATS) & excess, *between(pmi, (*PMI_LIMITS, 1e9)), *between(pmi2, PMI2_LIMITS)]


class _Pages:
    """The words and pairs of a batch of pages beside their counts, as far as these are held."""

    def __init__(self, texts: pa.Array, held: list[_Counts]):
        self.t = t = Tokens(texts)
        self.doc = t.doc[t.pair]
        self.words, self.size = np.bincount(t.doc, minlength=t.n), np.bincount(self.doc, minlength=t.n)
        w, wc = np.unique(t.hash, return_inverse=True)
        p, self.code = np.unique(t.pair_hash(), return_inverse=True)
        self.pair, self.pairs = p[self.code], len(p)
        self.own, self.own_word = _own(self.doc, self.code, len(p)), _own(t.doc, wc, len(w))
        self.n_pair, self.n_word = held[1].of(p)[self.code], held[0].of(w)[wc]

    def known(self) -> np.ndarray:
        """Whether all three counts of a position are held; every word and pair of a page is in the whole table."""
        return (self.n_pair > 0) & (self.n_word[self.t.pair] > 0) & (self.n_word[self.t.pair + 1] > 0)

    def sums(self, n_pairs: int, floor_w: float, floor_p: float, at: np.ndarray | None = None) -> list[np.ndarray]:
        """Sums of _PAIR_FEATURES over the pairs of each page, or over those of the positions at."""
        rest_p, rest_w = np.maximum(self.n_pair - self.own, 0), np.maximum(self.n_word - self.own_word, 0)
        pick = slice(None) if at is None else at
        left, doc = self.t.pair[pick], self.doc[pick]
        got = _measures(rest_p[pick], rest_w[left], rest_w[left + 1], self.own[pick], self.size[doc], n_pairs, floor_w, floor_p, np)
        return [np.bincount(doc, x, self.t.n) for x in got]


def page_scores(docs: DataFrame, by_join: bool = False) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, words, *FEATURES, score).

    A first pass over all texts counts words and pairs of neighbouring words; counts are summed in each task before the
    shuffle. Each page's pairs are then measured against the counts of all other pages (its own are taken off): mean and
    spread of PMI, the shares of excessively repeated collocations, and the shares of pairs in each class of PMI. Every
    count takes part, however rare. They are broadcast while they number at most HELD, which is checked; beyond that the
    common ones are, and what a page has of rarer words and pairs meets the count table in joins, see _scores_with_rest.
    With by_join=True nothing is broadcast; the scores are the same. Null and empty texts and those of one word have scores
    of 0; rows with null ids are left out, repeated rows give repeated scores.
    """
    spark = docs.sparkSession
    texts = docs.select("text").where("text is not null and doc_id is not null")
    counts = materialize(texts.mapInArrow(_count, "kind int, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    totals = {r[0]: (r[1], r[2]) for r in counts.groupBy("kind").agg(F.sum("n"), F.count("*")).collect()}
    n_words, n_pairs = totals.get(1, (0, 0))[0], max(1, totals.get(2, (0, 0))[0])
    floor_w, floor_p = max(1.0, n_words / RARE / 2), max(0.1, n_pairs / RARE / 20)
    whole = not by_join and sum(keys for _, keys in totals.values()) <= HELD
    common = counts
    if not whole:
        common = counts.where(~F.lit(by_join) & (F.col("n") >= F.when(F.col("kind") == 1, n_words).otherwise(n_pairs) / (HELD // 2)))
    held = common.toPandas()
    tables = [_Counts(part["key"].to_numpy(np.int64), part["n"].to_numpy(np.int64)) for k in (1, 2) for part in [held[held["kind"] == k]]]
    shared = spark.sparkContext.broadcast(tables)
    if not whole:
        return _scores_with_rest(docs, counts, shared, n_pairs, floor_w, floor_p)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = _Pages(batch.column(1), shared.value)
            feats = [x / np.maximum(pages.size, 1) for x in pages.sums(n_pairs, floor_w, floor_p)]
            feats[1] = np.sqrt(np.maximum(feats[1] - feats[0] ** 2, 0))
            total = np.where(pages.size > 0, sum(wt * f for wt, f in zip(WEIGHTS, feats, strict=True)) + BIAS, 0.0)
            cols = [batch.column(0), pa.array(pages.words.astype(np.int64)), *[pa.array(x.astype(np.float64)) for x in (*feats, total)]]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "words", *FEATURES, "score"])

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, words bigint, " + ", ".join(f"{f} double" for f in FEATURES) + ", score double"
    return docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(score, schema)


def _scores_with_rest(docs: DataFrame, counts: DataFrame, shared: Broadcast, n_pairs: int, floor_w: float, floor_p: float) -> DataFrame:
    """page_scores where some counts are not held: a row for each page with the sums over the pairs all of whose counts are,
    and a row for each other (page, pair), which joins the count table. A count that is held doesn't join: its row goes to
    the place of its pair, so no common word gathers rows."""
    kind = dict(docs.dtypes)["doc_id"]
    names = ["size", "pair", "own", "left", "right", "own_left", "own_right", "n_pair", "n_left", "n_right"]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = _Pages(batch.column(1), shared.value)
            t, known = pages.t, pages.known()
            sums = pages.sums(n_pairs, floor_w, floor_p, np.flatnonzero(known))
            lists = pa.ListArray.from_arrays(np.arange(t.n + 1, dtype=np.int32) * len(sums), np.stack(sums, 1).ravel().astype(np.float64))
            none = pa.nulls(t.n, pa.int64())
            cols = [batch.column(0), batch.column(2), pa.array(pages.words.astype(np.int64)), lists, pa.array(pages.size.astype(np.int64)), *[none] * 9]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "page", "words", "sums", *names])
            other = np.flatnonzero(~known)
            _, first = np.unique(pages.doc[other] * max(1, pages.pairs) + pages.code[other], return_index=True)
            at = other[first]
            left, doc = t.pair[at], pages.doc[at]
            values = [pages.size[doc], pages.pair[at].view(np.int64), pages.own[at], t.hash[left].view(np.int64), t.hash[left + 1].view(np.int64)]
            values += [pages.own_word[left], pages.own_word[left + 1], pages.n_pair[at], pages.n_word[left], pages.n_word[left + 1]]
            none, to = pa.nulls(len(at), pa.int64()), pa.array(doc)
            cols = [batch.column(0).take(to), batch.column(2).take(to), none, pa.nulls(len(at), lists.type), *[pa.array(x.astype(np.int64)) for x in values]]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "page", "words", "sums", *names])

    schema = f"doc_id {kind}, page bigint, words bigint, sums array<double>, " + ", ".join(f"{x} bigint" for x in names)
    table = materialize(docs.select("doc_id", "text", F.xxhash64("text")).where("doc_id is not null").mapInArrow(spread, schema))
    base, rows = table.where("pair is null").select("doc_id", "page", "words", "sums", "size"), table.where("pair is not null").drop("words", "sums")
    c = F.col
    for key, k in (("pair", 2), ("left", 1), ("right", 1)):
        other = counts.where(c("kind") == k).select(c("key").alias("_key"), c("n").alias("_n"))
        rows = rows.withColumn("_at", F.when(c(f"n_{key}") > 0, c("pair")).otherwise(c(key))).join(other, c("_at") == c("_key"), "left")
        n = F.when(c(f"n_{key}") > 0, c(f"n_{key}")).otherwise(c("_n"))
        rows = rows.withColumn(f"rest_{key}", F.greatest(n - c("own" if key == "pair" else f"own_{key}"), F.lit(0)).cast("double")).drop("_key", "_n", "_at")
    got = _measures(c("rest_pair"), c("rest_left"), c("rest_right"), c("own"), c("size"), n_pairs, floor_w, floor_p, F)
    more = rows.groupBy("doc_id", "page").agg(F.array(*[F.sum(m.cast("double") * c("own")) for m in got]).alias("more"))
    # a page that is repeated sent its rows as often
    more = more.join(base.groupBy("doc_id", "page").agg(F.count("*").alias("copies")), ["doc_id", "page"])
    value = lambda k: (c("sums")[k] + F.coalesce(c("more")[k] / c("copies"), F.lit(0.0))) / F.greatest(c("size"), F.lit(1))
    per = base.join(more, ["doc_id", "page"], "left").select("doc_id", "words", "size", *[value(k).alias(f) for k, f in enumerate(_PAIR_FEATURES)])
    per = per.withColumn("spread_pmi", F.sqrt(F.greatest(c("square_pmi") - c("mean_pmi") * c("mean_pmi"), F.lit(0.0))))
    total = sum((F.lit(float(w)) * c(f) for w, f in zip(WEIGHTS, FEATURES, strict=True)), F.lit(float(BIAS)))
    return per.select("doc_id", "words", *FEATURES, F.when(c("size") > 0, total).otherwise(0.0).alias("score"))


def fit(features: np.ndarray, found: np.ndarray, rounds: int = 4000, ridge: float = 0.1) -> tuple[np.ndarray, float]:
    """(weights, bias) of a logistic model over rows of FEATURES, by accelerated projected gradients on standardised
    columns. WEIGHTS and BIAS come from it, over one bounded sample: the at most 10,000 pages of the sf0.1 tables, labelled
    by whether more than half of a page's words lie outside sentences."""
    mean, scale = features.mean(axis=0), features.std(axis=0) + 1e-9
    z = np.c_[(features - mean) / scale, np.ones(len(features))]
    low = np.array([0.0 if f in _NOT_NEGATIVE else -np.inf for f in FEATURES] + [-np.inf])
    high = np.array([0.0 if f == "mean_pmi" else np.inf for f in FEATURES] + [np.inf])
    keep = np.append(np.full(len(scale), ridge), 0.0)
    step = 1 / (np.linalg.norm(z, 2) ** 2 / 4 + ridge)
    b = before = np.zeros(z.shape[1])
    for k in range(rounds):
        ahead = b + k / (k + 3) * (b - before)
        slope = z.T @ (1 / (1 + np.exp(-np.clip(z @ ahead, -30, 30))) - found) + keep * ahead
        before, b = b, np.clip(ahead - step * slope, low, high)
    return b[:-1] / scale, float(b[-1] - (b[:-1] * mean / scale).sum())


def is_keyword_page() -> Column:
    return (F.col("words") > 1) & ((F.col("score") > 0) | (F.col("mean_pmi") < SALAD))


def keyword_pages(docs: DataFrame) -> DataFrame:
    """Rows of page_scores of the pages whose neighbouring words hang together as those of keywords, tags or links do."""
    return page_scores(docs).where(is_keyword_page())


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword_pages(load(spark, sf_dir, "documents")).select("doc_id").distinct()


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every page."""
    return page_scores(load(spark, sf_dir, "documents"))


QUERIES = {"p10_found": p10_found, "p10_scores": p10_scores}
ORACLE: dict[str, str] = {}
