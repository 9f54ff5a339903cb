"""Problem 3: the k most similar vectors for every vector, by randomly rotated one-bit codes with error bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.session import materialize
from loomwork.tables import load

#: Vectors of a space (model and dimension) on which its lists' centres are fitted on the driver, and vectors a centre at
#: least; every vector is indexed.
SAMPLE, PER_CENTRE = 4096, 16
#: A space of n vectors gets about sqrt(n) / ROOT lists. What SAMPLE can't fit is fitted by tasks, in a second level inside
#: the lists of the first, up to MAX_LISTS lists a space (25 MB of centres at 384 numbers).
ROOT, MAX_LISTS = 5, 16_384
#: Spaces whose lists are fitted, the largest ones; any other is one list.
MAX_SPACES = 64
#: A vector is entered into its nearest list and up to SPREAD - 1 more whose similarity is within NEAR of the nearest.
SPREAD, NEAR = 3, 0.06
#: Rows of a list that meet in one task; larger lists are cut into blocks.
BLOCK = 16384
#: Width of the error bound in standard errors of the estimate.
EPSILON = 3.0


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix, the same on every worker."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed sign bits, <code, vector>, rotated vectors) of unit vectors."""
    turned = unit @ turn
    dim = unit.shape[1]
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.float32(np.sqrt(dim)), turned


def estimate(turned: np.ndarray, bits: np.ndarray, align: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of the inner products of rotated queries with coded vectors, and each vector's standard
    error. The codes are +-1/sqrt(dim); dividing by <code, vector> corrects the length lost in coding."""
    dim = turned.shape[1]
    signs = np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * np.float32(2 / np.sqrt(dim)) - np.float32(1 / np.sqrt(dim))
    error = np.sqrt(np.maximum(1 - align**2, 0)) / align / np.sqrt(max(1, dim - 1))
    return (turned @ signs.T) / align, error


def centres(unit: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from an evenly spread start."""
    rng = np.random.default_rng(11)
    mid = unit[rng.choice(len(unit), k, replace=False)].copy()
    for _ in range(rounds):
        near = (unit @ mid.T).argmax(axis=1)
        total = np.zeros_like(mid)
        np.add.at(total, near, unit)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        empty = size[:, 0] < 1e-6
        mid = np.where(size > 1e-6, total / np.maximum(size, 1e-6), mid)
        mid[empty] = unit[rng.choice(len(unit), int(empty.sum()))]
    return mid


def search_block(queries: np.ndarray, base: np.ndarray, same: bool, k: int, least: float, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, base, cosine) of each query's k best base vectors with a cosine of at least `least`. One-bit estimates
    come first; a pair is reranked exactly only if its upper bound reaches both `least` and the k-th best lower bound."""
    bits, align, _ = encode(base, turn)
    turned = queries @ turn
    out_q, out_b, out_c = [], [], []
    for at in range(0, len(queries), 512):
        got, error = estimate(turned[at : at + 512], bits, align)
        if same:
            rows = np.arange(len(got))
            got[rows, at + rows] = -9
        upper = got + EPSILON * error
        lower = got - EPSILON * error
        if lower.shape[1] > k:
            kth = np.partition(lower, -k, axis=1)[:, -k]
        else:
            kth = np.full(len(lower), -9.0)
        q, b = np.nonzero(upper >= np.maximum(kth, least)[:, None])
        keep = got[q, b] > -5
        q, b = q[keep], b[keep]
        for s in range(0, len(q), 65536):
            qs, bs = q[s : s + 65536] + at, b[s : s + 65536]
            exact = np.einsum("ij,ij->i", queries[qs], base[bs], dtype=np.float64)
            ok = exact >= least
            out_q.append(qs[ok])
            out_b.append(bs[ok])
            out_c.append(exact[ok])
    if not out_q:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    q, b, c = np.concatenate(out_q), np.concatenate(out_b), np.concatenate(out_c)
    order = np.lexsort((b, -c, q))
    q, b, c = q[order], b[order], c[order]
    first = np.searchsorted(q, q, "left")
    top = np.arange(len(q)) - first < k
    return q[top], b[top], c[top]


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows and matrix of the vectors that are neither null nor zero nor hold anything but finite numbers. All have the
    same dimension within a batch's group, see _prepare."""
    flat = np.asarray(column.flatten(), np.float32)
    x = flat.reshape(len(column), -1)
    size = np.linalg.norm(x.astype(np.float64), axis=1)
    ok = np.isfinite(size) & (size > 0)
    return ok, (x[ok] / size[ok, None]).astype(np.float32)


def _prepare(vectors: DataFrame) -> DataFrame:
    """Adds space (model and dimension; other spaces aren't comparable) and node: equal raw vectors of a space are one
    node, whatever their ids."""
    dim = F.size("embedding")
    rows = vectors.select("id", "model", "embedding").where("id is not null and model is not null and embedding is not null")
    rows = rows.where((dim > 0) & F.exists("embedding", lambda v: v != 0) & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v)))
    key = F.concat(F.hex(F.xxhash64("model", "embedding")), F.hex(F.xxhash64("embedding", F.lit(1), "model")))
    return rows.withColumn("space", F.concat_ws("|", dim.cast("string"), "model")).withColumn("node", key)


class Lists:
    """Centres of a space's lists. One level: mid. Two levels: under[k] holds the centres inside list k of mid, whose
    numbers begin at offset[k]. blocks: into how many blocks each list is cut."""

    def __init__(self, mid: np.ndarray, blocks: np.ndarray, under: list[np.ndarray] | None = None):
        self.mid, self.blocks, self.under = mid, blocks, under
        if under is not None:
            self.offset = np.concatenate(([0], np.cumsum([len(u) for u in under])[:-1]))

    def enter(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of the nearest list of every vector and of up to SPREAD - 1 more within NEAR of it."""
        like = unit @ self.mid.T
        top = np.argsort(-like, axis=1)[:, :SPREAD]
        if self.under is None:
            close = np.take_along_axis(like, top, 1)
        else:  # the best SPREAD of all centres inside the nearest SPREAD lists
            width = top.shape[1]
            close, names = np.full((len(unit), width * SPREAD), -9.0, np.float32), np.zeros((len(unit), width * SPREAD), np.int64)
            for k in np.unique(top):
                r, c = np.nonzero(top == k)
                inner = unit[r] @ self.under[k].T
                best = np.argsort(-inner, axis=1)[:, :SPREAD]
                at = c[:, None] * SPREAD + np.arange(best.shape[1])
                close[r[:, None], at] = np.take_along_axis(inner, best, 1)
                names[r[:, None], at] = self.offset[k] + best
            order = np.argsort(-close, axis=1)[:, :SPREAD]
            close, top = np.take_along_axis(close, order, 1), np.take_along_axis(names, order, 1)
        r, c = np.nonzero((close >= close[:, :1] - NEAR) & (close > -5))
        return r, top[r, c]


def _stack(column) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float32) for v in column])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _sampled(rows: DataFrame, fractions: dict[str, float], keep: int, by: list[str], seed: int) -> DataFrame:
    """A share of each space's rows, different vectors only, at most `keep` for each value of `by`."""
    part = Window.partitionBy(*by).orderBy(F.xxhash64("node", F.lit(seed)))
    some = rows.sampleBy("space", fractions, seed).dropDuplicates(["space", "node"])
    return some.withColumn("_n", F.row_number().over(part)).where(F.col("_n") <= keep).drop("_n")


def fit_lists(rows: DataFrame) -> dict[str, Lists]:
    """Lists of the spaces of rows(space, node, embedding)."""
    sizes = {r[0]: r[1] for r in rows.groupBy("space").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "space").limit(MAX_SPACES).collect()}
    some = _sampled(rows.select("space", "node", "embedding"), {s: min(1.0, 2 * SAMPLE / n) for s, n in sizes.items()}, SAMPLE, ["space"], 3)
    fitted: dict[str, Lists] = {}
    deeper: dict[str, int] = {}
    for space, group in some.select("space", "embedding").toPandas().groupby("space"):
        x = _stack(group["embedding"])
        wanted = int(min(MAX_LISTS, max(1, round(sizes[space] ** 0.5 / ROOT))))
        n = min(wanted, max(1, len(x) // PER_CENTRE))
        if wanted > 1.5 * n:
            # fewer and larger lists above, so that both levels have about as many centres to compare with
            n = min(n, max(1, round((wanted * SPREAD) ** 0.5)))
            deeper[space] = -(-wanted // n)
        mid = centres(x, n)
        share = np.bincount((x @ mid.T).argmax(axis=1), minlength=n) / len(x)
        fitted[space] = Lists(mid, _blocks(share * sizes[space]))
    if not deeper:
        return fitted
    plan, schema = rows.sparkSession.sparkContext.broadcast(fitted), "space string, list int, embedding array<float>, node string"

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for space, group in pdf.groupby("space"):
                near = (_stack(group["embedding"]) @ plan.value[space].mid.T).argmax(axis=1)
                yield pd.DataFrame({"space": space, "list": near.astype(np.int32), "embedding": group["embedding"].to_numpy(), "node": group["node"].to_numpy()})

    def fit_below(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = _stack(pdf["embedding"])
        n = min(deeper[key[0]], max(1, len(x) // PER_CENTRE))
        mid = centres(x, n)
        share = np.bincount((x @ mid.T).argmax(axis=1), minlength=n) / len(x)
        return pd.DataFrame({"space": key[0], "list": key[1], "centre": list(mid.astype(np.float32)), "share": share * len(x)})

    # this sample grows with the lists that are wanted, and is fitted by as many tasks as there are lists above
    each = 4 * PER_CENTRE
    fractions = {s: min(1.0, 2 * each * n * len(fitted[s].mid) / sizes[s]) for s, n in deeper.items()}
    some = rows.where(F.col("space").isin(*deeper)).select("space", "node", "embedding")
    some = some.sampleBy("space", fractions, 5).mapInPandas(nearest, schema).dropDuplicates(["space", "node"])
    part = Window.partitionBy("space", "list").orderBy(F.xxhash64("node", F.lit(5)))
    some = some.withColumn("_n", F.row_number().over(part)).where(F.col("_n") <= 4 * each * max(deeper.values())).drop("_n", "node")
    below = some.groupBy("space", "list").applyInPandas(fit_below, "space string, list int, centre array<float>, share double").toPandas()
    for space, group in below.groupby("space"):
        above, at = fitted[space], {k: g for k, g in group.groupby("list")}
        under = [np.stack([np.asarray(c, np.float32) for c in at[k]["centre"]]) if k in at else above.mid[k : k + 1] for k in range(len(above.mid))]
        share = np.concatenate([at[k]["share"].to_numpy() if k in at else np.ones(1) for k in range(len(under))])
        fitted[space] = Lists(above.mid, _blocks(share / share.sum() * sizes[space]), under)
    return fitted


def _blocks(rows_of: np.ndarray) -> np.ndarray:
    """Into how many blocks lists of about so many vectors are cut; vectors lie in 1.6 lists on average."""
    return np.ceil(rows_of * 1.6 / BLOCK).clip(1).astype(int)


class _Seen(dict):
    """Nodes that a task has entered, with whether they asked; forgets all at 250,000, so that memory stays bounded."""

    def new(self, nodes: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Rows that add something: the first of a node, and the first that asks."""
        out = []
        for k, (node, q) in enumerate(zip(nodes, asked, strict=True)):
            had = self.get(node)
            if had is None or (q and not had):
                if len(self) > 250_000:
                    self.clear()
                self[node] = bool(q)
                out.append(k)
        return np.array(out, np.int64)


def neighbours(vectors: DataFrame, k: int = 10, least: float = -1.0, is_query: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """vectors(id, model, embedding) -> (members, links).

    members(space, node, id): equal vectors share a node. links(node, other, cosine): for each node (with is_query: each
    node that has a query row) its k most similar other nodes of the same model and dimension with a cosine of at least
    `least`. Null, empty and all-zero vectors and those with nulls or NaN have no part; repeated rows count once.

    Lists are fitted on samples (fit_lists), every vector is entered. Their number grows with the root of a space's size, in
    two levels where it gets large. A vector leaves a task once, however many ids have it. The only table that moves holds
    16-bit components; in a list's task one-bit codes choose what is compared exactly. Lists that would be too large for a
    task are cut into blocks, all of which meet.
    """
    rows = _prepare(vectors)
    plan = vectors.sparkSession.sparkContext.broadcast(fit_lists(rows))
    flagged = rows.select("space", "node", "embedding", (is_query if is_query is not None else F.lit(True)).alias("q"))
    schema = pa.schema([("key", pa.string()), ("node", pa.string()), ("role", pa.int32()), ("scale", pa.float32()), ("vec", pa.binary())])

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = plan.value, _Seen()
        for batch in batches:
            fresh = seen.new(batch.column(1).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False))
            batch = batch.take(pa.array(fresh))
            spaces = batch.column(0).to_numpy(zero_copy_only=False)
            for space in pd.unique(spaces):
                part = batch.filter(pa.array(spaces == space))
                ok, unit = _vectors(part.column(2))
                if not len(unit):
                    continue
                nodes = part.column(1).to_numpy(zero_copy_only=False)[ok]
                asked = part.column(3).to_numpy(zero_copy_only=False)[ok]
                lists = known.get(space) or Lists(np.zeros((1, unit.shape[1]), np.float32), np.ones(1, int))
                r, lst = lists.enter(unit)
                scale = np.abs(unit).max(axis=1) / 32767
                whole = np.rint(unit / scale[:, None]).astype("<i2")
                # a vector asks in the blocks (mine, j) and is asked in (j, mine), j being any block of its list
                n = lists.blocks[lst]
                mine = np.array([int(x[:8], 16) for x in nodes], np.int64)[r] % n
                at = np.repeat(np.arange(len(r)), n)
                j = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                m, same = mine[at], mine[at] == j
                ask = asked[r[at]].astype(bool)
                both = (at[same], m[same], m[same], 2 + ask[same])
                asks = (at[~same & ask], m[~same & ask], j[~same & ask], np.ones(int((~same & ask).sum()), int))
                told = (at[~same], j[~same], m[~same], np.full(int((~same).sum()), 2))
                at, a, b, role = (np.concatenate(x) for x in zip(both, asks, told, strict=True))
                keys = [f"{space}|{x}|{y}|{z}" for x, y, z in zip(lst[at].tolist(), a.tolist(), b.tolist(), strict=True)]
                pick = pa.array(r[at])
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * whole.shape[1]), len(whole), [None, pa.py_buffer(np.ascontiguousarray(whole))])
                cols = [pa.array(keys, pa.string()), pa.array(nodes, pa.string()).take(pick), pa.array(role, pa.int32()), pa.array(scale, pa.float32()).take(pick), raw.take(pick).cast(pa.binary())]
                for begin in range(0, len(at), 20_000):
                    yield pa.RecordBatch.from_arrays([c.slice(begin, 20_000) for c in cols], schema=schema)

    entered = flagged.mapInArrow(enter, "key string, node string, role int, scale float, vec binary")

    def search(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        node = t.column("node").to_numpy(zero_copy_only=False)
        role = t.column("role").to_numpy(zero_copy_only=False)
        # a node comes more than once if rows repeat it: it asks if any of its rows does
        order = np.lexsort((-role, node))
        first = np.concatenate(([True], node[order][1:] != node[order][:-1])) if len(node) else np.empty(0, bool)
        pick = order[first]
        raw = np.frombuffer(b"".join(t.column("vec").take(pa.array(pick)).to_pylist()), "<i2").reshape(len(pick), -1)
        x = raw.astype(np.float32) * t.column("scale").to_numpy(zero_copy_only=False)[pick, None]
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        role, node = role[pick], node[pick]
        ask, base = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
        turn = rotation(x.shape[1])
        if len(ask) == 0 or len(base) == 0:
            q = b = np.empty(0, int)
            c = np.empty(0)
        elif len(ask) == len(base) and (ask == base).all():
            q, b, c = search_block(x[ask], x[base], True, k, least, turn)
        else:
            q, b, c = search_block(x[ask], x[base], False, k + 1, least, turn)
            other = ask[q] != base[b]
            q, b, c = q[other], b[other], c[other]
        return pa.table({"node": node[ask[q]].astype(object), "other": node[base[b]].astype(object), "cosine": c}, schema=pa.schema([("node", pa.string()), ("other", pa.string()), ("cosine", pa.float64())]))

    found = entered.groupBy("key").applyInArrow(search, "node string, other string, cosine double")
    found = found.groupBy("node", "other").agg(F.max("cosine").alias("cosine"))
    best = Window.partitionBy("node").orderBy(F.desc("cosine"), "other")
    links = found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r")
    return rows.select("space", "node", "id").distinct(), links


def similar_ids(members: DataFrame, links: DataFrame, k: int = 10, is_query: Column | None = None) -> DataFrame:
    """(id, other, cosine, rank): the k most similar ids of every id, by cosine and then id. Members of one node are
    each other's nearest. A node needs no more than the k + 1 smallest ids of any node, so however many copies a vector
    has, the work is k rows an id."""
    ranked = members.withColumn("_n", F.row_number().over(Window.partitionBy("node").orderBy("id"))).where(F.col("_n") <= k + 1)
    heads = materialize(ranked.select("node", "id"))
    own = heads.select("node", F.col("id").alias("other"), F.lit(1.0).alias("cosine"))
    theirs = links.join(heads.select(F.col("node").alias("other"), F.col("id").alias("_o")), "other").select("node", F.col("_o").alias("other"), "cosine")
    both = own.unionByName(theirs)
    order = Window.partitionBy("node").orderBy(F.desc("cosine"), "other")
    both = both.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1)
    asking = members.select("node", "id") if is_query is None else members.where(is_query).select("node", "id")
    pairs = both.join(asking, "node").where("id <> other")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "other"))
    return pairs.withColumn("rank", place).where(F.col("rank") <= k).select("id", "other", "cosine", "rank")


def embeddings(spark: SparkSession, sf_dir: str, skill_model: str = "minilm-384-a") -> DataFrame:
    """text_embeddings and skills together."""
    chunks = load(spark, sf_dir, "text_embeddings").select("id", F.col("embedding_model").alias("model"), "embedding")
    return chunks.unionByName(load(spark, sf_dir, "skills").select("id", F.lit(skill_model).alias("model"), "embedding"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, links = neighbours(embeddings(spark, sf_dir), 10, 0.8)
    pairs = similar_ids(members, links, 10).where("cosine >= 0.8")
    return pairs.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 most similar vectors for every row whose id hashes to a multiple of 20, among all rows."""
    asked = F.pmod(F.xxhash64("id"), F.lit(20)) == 0
    members, links = neighbours(embeddings(spark, sf_dir), 10, is_query=asked)
    return similar_ids(members, links, 10, asked).select("id", "other", F.round("cosine", 6).alias("cosine"), F.col("rank").cast("long").alias("rank"))


_FOUND_SQL = """
with v as (select id, embedding_model m, any_value(embedding) e from text_embeddings where embedding is not null group by id, embedding_model
           union all select id, 'minilm-384-a', any_value(embedding) from skills where embedding is not null group by id),
u as (select id, m, cast(e as double[384]) e, sqrt(list_sum(list_transform(e, lambda x: cast(x as double) * x))) n from v),
w as (select id, m, e, n from u where n > 0),
p as (select a.id, b.id other, array_inner_product(a.e, b.e) / (a.n * b.n) c from w a join w b on a.m = b.m and a.id <> b.id
      where array_inner_product(a.e, b.e) >= 0.7999999 * a.n * b.n),
r as (select *, row_number() over (partition by id order by c desc, other) k from p)
select distinct least(id, other) as id_a, greatest(id, other) as id_b from r where k <= 10 and c >= 0.8
"""

QUERIES = {"p3_found": p3_found, "p3_neighbours": p3_neighbours}
ORACLE = {"p3_found": _FOUND_SQL}
