"""Forests, boosted trees and pairwise rankers of the whole stated size, fitted by few Spark jobs.

Spark's own trees cost a job for each level of each round. Here a task holds all rows as bins of a byte a feature and fits
whole trees; the trees of a forest are dealt to several tasks. Splits, gains and steps are those of Spark's regressors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.session import materialize

#: Bins of a feature, as in Spark.
BINS = 32
#: Tasks to which the trees of a forest are dealt.
TASKS = 12
#: Levels of a group up to which its pairs are listed; beyond that they form matrices of SLAB rows, in tasks of BLOCK rows.
LISTED, SLAB, BLOCK = 64, 128, 1024


def thresholds(values: np.ndarray) -> np.ndarray:
    """At most BINS - 1 midpoints between neighbouring values: all of them or those nearest to equal counts."""
    value, n = np.unique(values, return_counts=True)
    middle = (value[1:] + value[:-1]) / 2
    if len(middle) < BINS:
        return middle
    count = np.cumsum(n)
    twice, out, last = count[1:] + count[:-1], [], -1
    for k in range(1, BINS):
        at = max(int(np.searchsorted(twice, 2 * k * len(values) / BINS, "right")), last + 1)
        if at < len(middle):
            out.append(middle[at])
            last = at
    return np.array(out)


class Rows:
    """Binned features and pairs of features of all rows."""

    def __init__(self, columns: Iterator[np.ndarray], splits: list[np.ndarray] | None = None):
        self.splits, bins = splits or [], []
        for k, values in enumerate(columns):
            if splits is None:
                self.splits.append(thresholds(values))
            bins.append(np.searchsorted(self.splits[k], values, "left").astype(np.uint8))
        self.bins = bins
        self.flat = np.stack(bins, 1).ravel()
        self.n, self.features = len(bins[0]), len(bins)

    def pairs(self) -> list[np.ndarray]:
        """BINS * bin + next bin for every two features; the last may stand alone."""
        both = [*self.bins, np.zeros(self.n, np.uint8)] if self.features % 2 else self.bins
        return [a.astype(np.int16) * BINS + b for a, b in zip(both[::2], both[1::2], strict=True)]

    def take(self, at: np.ndarray) -> Rows:
        out = object.__new__(Rows)
        out.splits, out.bins, out.n, out.features = self.splits, [b[at] for b in self.bins], len(at), self.features
        out.flat = np.stack(out.bins, 1).ravel()
        return out

    def leaves(self, feature: np.ndarray, limit: np.ndarray, depth: int) -> np.ndarray:
        """The leaf of each row in a tree whose nodes lie level by level."""
        node, at = np.zeros(self.n, np.int64), np.arange(self.n) * self.features
        for level in range(depth):
            heap = node + ((1 << level) - 1)
            node = 2 * node + (self.flat[at + feature[heap]] > limit[heap])
        return node


def grow(rows: Rows, pairs: list[np.ndarray], y: np.ndarray, w: np.ndarray | None, depth: int, subset: int, rng: np.random.Generator | None):
    """(feature, limit, value of each leaf, leaf of each row) of a regression tree by variance. `subset` features, drawn anew,
    are tried at each node. A node that is not split sends all rows left."""
    n, nf = rows.n, rows.features
    wy = y if w is None else w * y
    feature, limit = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, 255, np.uint8)
    node, at, is_open = np.zeros(n, np.int64), np.arange(n) * nf, np.ones(1, bool)
    base, place, cell, over = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.uint8), np.empty(n, np.uint8)  # memory is touched once
    for level in range(depth):
        m = 1 << level
        count, total = np.empty((m, nf, BINS)), np.empty((m, nf, BINS))
        wide = m <= 32
        cells = BINS * BINS if wide else BINS
        np.multiply(node, cells, out=base)
        for k, key in enumerate(pairs if wide else rows.bins):
            np.add(base, key, out=place)
            for weights, into in ((w, count), (wy, total)):
                sums = np.bincount(place, weights, m * cells)
                if wide:
                    sums = sums.reshape(m, BINS, BINS)
                    into[:, 2 * k] = sums.sum(2)
                    if 2 * k + 1 < nf:
                        into[:, 2 * k + 1] = sums.sum(1)
                else:
                    into[:, k] = sums.reshape(m, BINS)
        nl, sl = np.cumsum(count, 2)[:, :, :-1], np.cumsum(total, 2)[:, :, :-1]
        na, sa = count[:, 0].sum(1)[:, None, None], total[:, 0].sum(1)[:, None, None]
        nr, sr = na - nl, sa - sl
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where((nl > 0) & (nr > 0), sl * sl / nl + sr * sr / nr - sa * sa / na, -1.0)
        if subset < nf:
            tried = np.argsort(rng.random((m, nf)), 1) < subset
            gain[~tried] = -1.0
        best = gain.reshape(m, -1).argmax(1)
        most = gain.reshape(m, -1)[np.arange(m), best]
        is_open = is_open & (most > 1e-12 * np.maximum(na[:, 0, 0], 1))
        f, t = np.where(is_open, best // (BINS - 1), 0), np.where(is_open, best % (BINS - 1), 255)
        feature[m - 1 : 2 * m - 1], limit[m - 1 : 2 * m - 1] = f, t
        np.take(f, node, out=place, mode="clip")
        np.add(place, at, out=place)
        np.take(rows.flat, place, out=cell, mode="clip")
        np.take(t.astype(np.uint8), node, out=over, mode="clip")
        np.multiply(node, 2, out=node)
        np.add(node, cell > over, out=node)
        is_open = np.repeat(is_open, 2)
    sums, counts = np.bincount(node, wy, 1 << depth), np.bincount(node, w, 1 << depth)
    return feature, limit, sums / np.where(counts > 0, counts, 1), node


def fit_forest(rows: Rows, y: np.ndarray, trees: list[int], depth: int, subset: int, seed: int = 42) -> list[tuple]:
    """Trees over Poisson samples of the rows; a tree is the same whatever task fits it."""
    out = []
    for k in trees:
        rng = np.random.default_rng([seed, k])
        w = rng.poisson(1.0, rows.n).astype(np.float64)
        at = np.flatnonzero(w)
        part = rows.take(at)
        out.append(grow(part, part.pairs(), y[at], w[at], depth, subset, rng)[:3])
    return out


def fit_boosted(rows: Rows, y: np.ndarray, rounds: int, depth: int, step: float) -> list[tuple]:
    """Trees on the slope of the squared error; the first counts whole, the others by step, as in Spark."""
    pairs, now, out = rows.pairs(), np.zeros(rows.n), []
    for k in range(rounds):
        feature, limit, value, leaf = grow(rows, pairs, 2 * (y - now) if k else y, None, depth, rows.features, None)
        value = value * step if k else value
        now += value[leaf]
        out.append((feature, limit, value))
    return out


def predict_trees(rows: Rows, trees: list[tuple]) -> np.ndarray:
    """The sum of the trees' leaves for each row."""
    out = np.zeros(rows.n)
    for feature, limit, value in trees:
        out += value[rows.leaves(feature, limit, len(value).bit_length() - 1)]
    return out


def fit_trees(train: DataFrame, features: list[str], forest: tuple[int, int], boosted: tuple[int, int, float]) -> tuple[list, list, list]:
    """(splits, trees of the forest, trees of boosting) over train(id, *features, score). forest: trees and depth; boosted:
    rounds, depth and step. Rows are written once and read by every task, in an order that only their values decide."""
    table = materialize(train.select(*[F.col(f).cast("double") for f in features], F.col("score").cast("double"), F.xxhash64("id", *features, "score").alias("_key")))
    path, spark = table._loomwork_path, train.sparkSession  # noqa: SLF001
    (trees, deep), (rounds, depth, step), subset = forest, boosted, -(-len(features) // 3)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for job in (int(x) for pdf in batches for x in pdf["id"]):
            system, where = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
            data = ds.dataset(where, filesystem=system, format="parquet")
            column = lambda name: data.to_table([name], use_threads=False)[name].to_numpy()
            order = np.argsort(column("_key"), kind="stable")
            y, rows = column("score")[order], Rows(column(f)[order] for f in features)
            mine = list(range(job - 1, trees, TASKS))
            got = fit_forest(rows, y, mine, deep, subset) if job else fit_boosted(rows, y, rounds, depth, step)
            out = [(job, k, *(np.asarray(x, t).tobytes() for x, t in zip(tree, ("<i8", "u1", "<f8"), strict=True))) for k, tree in zip(mine if job else range(rounds), got, strict=True)]
            if not job:
                out += [(-1, k, x.astype("<f8").tobytes(), b"", b"") for k, x in enumerate(rows.splits)]
            yield pd.DataFrame(out, columns=["job", "k", "feature", "limit", "value"])

    jobs = spark.range(0, TASKS + 1, 1, TASKS + 1)
    found = sorted(jobs.mapInPandas(run, "job int, k int, feature binary, limit binary, value binary").collect(), key=lambda r: r["k"])
    tree = lambda r: (np.frombuffer(r["feature"], "<i8"), np.frombuffer(r["limit"], "u1"), np.frombuffer(r["value"], "<f8"))
    splits = [np.frombuffer(r["feature"], "<f8") for r in found if r["job"] < 0]
    return splits, [tree(r) for r in found if r["job"] > 0], [tree(r) for r in found if r["job"] == 0]


def _sums(x: np.ndarray, n: np.ndarray, beta: np.ndarray, first: int, last: int) -> tuple[float, np.ndarray, np.ndarray]:
    """(loss, slope, curvature) of all pairs of one group whose higher level is first to last; x, n: levels, highest first."""
    s, loss, slope, curve = x @ beta, 0.0, np.zeros(len(beta)), np.zeros((len(beta), len(beta)))
    for a in range(first, last, SLAB):
        b = min(a + SLAB, last)
        high, low = x[a:b], x[a + 1 :]
        margin = s[a:b, None] - s[None, a + 1 :]
        w = n[a:b, None] * n[None, a + 1 :]
        w[:, : b - a] *= np.triu(np.ones((b - a, min(b - a, w.shape[1]))))
        wrong = np.exp(-np.logaddexp(0, margin))
        loss += float((w * np.logaddexp(0, -margin)).sum())
        w *= wrong
        slope -= w.sum(1) @ high - w.sum(0) @ low
        w *= 1 - wrong
        cross = high.T @ w @ low
        curve += (high.T * w.sum(1)) @ high + (low.T * w.sum(0)) @ low - cross - cross.T
    return loss, slope, curve


def _listed(x: np.ndarray, n: np.ndarray, sizes: np.ndarray, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The same over all pairs of many small groups, whose levels follow one another."""
    ends = np.repeat(np.cumsum(sizes), sizes)
    at = np.arange(len(x))
    after = ends - at - 1
    i = np.repeat(at, after)
    j = np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after) + i + 1
    d, w = x[i] - x[j], n[i] * n[j]
    margin = d @ beta
    wrong = np.exp(-np.logaddexp(0, margin))
    return float((w * np.logaddexp(0, -margin)).sum()), -((w * wrong) @ d), (d.T * (w * wrong * (1 - wrong))) @ d


def fit_ranker(rows: DataFrame, group: str, features: list[str], rounds: int = 100) -> np.ndarray:
    """Weights of the linear ranker that learning.pairwise_ranker fits, by Newton steps: a logistic regression on every two
    different scores of a group, see learning.score_pairs. No pair is written: each step sums over the pairs in the tasks
    that hold a group's levels; those of a large group are dealt to several."""
    levels = rows.groupBy(group, "score").agg(*[F.avg(f).alias(f) for f in features], F.count("*").cast("double").alias("_n"))
    packed = levels.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col("score").cast("double"), "_n", *features)), False).alias("v")).where(F.size("v") > 1)
    packed = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.size("v") - 1) / BLOCK).cast("int"))))
    table = materialize(packed.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, group, "block").select("v", "block"))
    k = len(features)

    def summed(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss, slope, curve = 0.0, np.zeros(k), np.zeros((k, k))
            for batch in batches:
                v, block = batch.column(0), batch.column(1).to_numpy()
                ends, flat = np.concatenate(([0], np.cumsum(np.diff(v.offsets.to_numpy())))), v.flatten()
                values = np.stack([flat.field(f).to_numpy(zero_copy_only=False) for f in range(1, k + 2)], 1)
                n, x, sizes = values[:, 0], values[:, 1:], np.diff(ends)
                small = np.flatnonzero(sizes <= LISTED)
                got = [_sums(x[ends[g] : ends[g + 1]], n[ends[g] : ends[g + 1]], beta, int(block[g]) * BLOCK, min(int(sizes[g]) - 1, (int(block[g]) + 1) * BLOCK)) for g in np.flatnonzero(sizes > LISTED)]
                for part in np.array_split(small, max(1, len(small) // 64)):
                    if len(part):
                        at = np.concatenate([np.arange(ends[g], ends[g + 1]) for g in part])
                        got.append(_listed(x[at], n[at], sizes[part], beta))
                for a, b, c in got:
                    loss, slope, curve = loss + a, slope + b, curve + c
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(([loss], slope, curve.ravel())).tolist()], pa.list_(pa.float64()))], ["s"])

        total = np.sum([np.array(r["s"]) for r in table.mapInArrow(run, "s array<double>").collect()] + [np.zeros(1 + k + k * k)], axis=0)
        return total[0], total[1 : k + 1], total[k + 1 :].reshape(k, k)

    beta = np.zeros(k)
    loss, slope, curve = summed(beta)
    weight = max(loss / np.log(2), 1e-300)
    for _ in range(rounds):
        step = -np.linalg.lstsq(curve, slope, rcond=1e-12)[0]
        if -(slope @ step) < 1e-10 * weight:
            break
        for _ in range(30):
            now = summed(beta + step)
            if now[0] <= loss:
                break
            step = step / 2
        else:
            break
        beta, (loss, slope, curve) = beta + step, now
    return beta
