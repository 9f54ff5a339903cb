"""Resolving skill names against a taxonomy: exact, then fuzzy with a veto between confusable names, then suggestions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions import similarity as S
from loomwork.functions import text as T
from loomwork.functions import vectors as V

FUZZY, MARGIN, BLOCK, SUGGEST, OCCUPATION_FLOOR = 0.80, 0.1, 0.75, 0.4, 0.5


def taxonomy_terms(skills: DataFrame, aliases: DataFrame) -> DataFrame:
    """(term, canonical, ord): normalised names and aliases of skills(id, name), aliases(skill_id, alias); where two
    skills share a term the first by name keeps it."""
    named = skills.select(F.col("id").alias("skill_id"), F.col("name").alias("canonical"))
    own = named.select(T.normalize_term("canonical").alias("term"), "canonical", F.lit(0).alias("k"))
    other = aliases.join(named, "skill_id").select(T.normalize_term("alias").alias("term"), "canonical", F.lit(1).alias("k"))
    rows = own.unionByName(other).where("term <> ''")
    return rows.groupBy("term").agg(F.min_by("canonical", F.struct("k", "canonical")).alias("canonical"))


def resolve_exact(values: DataFrame, terms: DataFrame, value: str = "raw_text") -> DataFrame:
    """Distinct values with their normal form and, where it is a term, the canonical name."""
    once = values.select(F.col(value).alias("raw_text")).where(F.col(value).isNotNull()).distinct().withColumn("norm", T.normalize_term("raw_text"))
    return once.join(terms, once["norm"] == terms["term"], "left").select("raw_text", "norm", "canonical")


def _numbered(c: str, size: int) -> Column:
    """Runs of `size` letters of a string, each with how often it came before, as one array."""
    text = F.col(c)
    runs = F.when(F.length(text) >= size, F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))
    return F.transform(runs, lambda g, i: F.concat(g, F.size(F.filter(F.slice(runs, F.lit(1), i), lambda h: h == g)).cast("string")))


def fuzzy_candidates(rest: DataFrame, terms: DataFrame, threshold: float, sequence: bool = True) -> DataFrame:
    """(raw_text, norm, term, canonical, score) of the pairs whose similarity reaches the threshold: the larger of token
    Jaccard and sequence ratio. Pairs come from shared tokens, or, for the sequence ratio, from shared 2-grams of the
    strings and lengths that allow it: as many as the threshold implies, see below."""
    left, right = rest.select("raw_text", "norm").distinct(), terms.select("term", "canonical")
    tokens = lambda c: F.explode(F.array_distinct(F.split(c, " ")))
    by_token = left.select("raw_text", "norm", tokens("norm").alias("g")).join(right.select("term", "canonical", tokens("term").alias("g")), "g")
    pairs = by_token.select("raw_text", "norm", "term", "canonical").distinct()
    jaccard = pairs.withColumn("score", S.token_jaccard("norm", "term"))
    if not sequence:
        return jaccard.where(F.col("score") >= threshold)
    # A ratio r means that m = r * (la + lb) / 2 letters lie in matching blocks. Between two blocks a letter is left out, so
    # there are at most la + lb - 2 m + 1 of them, and m less that many pairs of neighbouring letters are shared, repeats
    # counted. Where that is at least one, pairs come from shared 2-grams.
    by_gram = left.select("raw_text", "norm", F.explode(_numbered("norm", 2)).alias("g")).join(right.select("term", "canonical", F.explode(_numbered("term", 2)).alias("g")), "g")
    shared = by_gram.groupBy("raw_text", "norm", "term", "canonical").agg(F.count("*").alias("n"))
    total = F.length("norm") + F.length("term")
    matched = F.ceil(total * F.lit(threshold) / 2 - 1e-9)
    least = matched - (total - 2 * matched + 1)
    possible = S.length_bound(F.col("norm"), F.col("term")) >= threshold
    likely = shared.where(possible & (least >= 1) & (F.col("n") >= least)).drop("n")
    # Elsewhere (short strings, from 2/3 up) the m letters themselves decide: two strings share one of their rarest
    short = 1 << 30 if threshold <= 0.667 else int(np.ceil((1 / 3) / (threshold / 2 - 1 / 3) * (1 - threshold / 2))) + 1
    few = lambda df, c: df.where((F.length(c) > 0) & (F.length(c) <= short))
    often = few(right, "term").select(F.explode(_numbered("term", 1)).alias("g")).groupBy("g").agg(F.count("*").alias("df"))

    def rarest(df: DataFrame, c: str) -> DataFrame:
        rows = few(df, c).select(c).distinct().select(c, F.explode(_numbered(c, 1)).alias("g")).join(often, "g", "left")
        rows = rows.withColumn("k", F.row_number().over(Window.partitionBy(c).orderBy(F.coalesce("df", F.lit(0)), "g")))
        return rows.where(F.col("k") <= F.length(c) - F.ceil(F.length(c) * F.lit(threshold / (2 - threshold)) - 1e-9) + 1).select(c, "g")

    small = rarest(left, "norm").join(rarest(right, "term"), "g").select("norm", "term").distinct().where(possible & (least < 1))
    likely = likely.unionByName(small.join(left, "norm").join(right, "term").select("raw_text", "norm", "term", "canonical"))
    seq = likely.repartition("norm").withColumn("score", S.sequence_ratio(F.col("norm"), F.col("term")))
    both = seq.unionByName(jaccard).groupBy("raw_text", "norm", "term", "canonical").agg(F.max("score").alias("score"))
    return both.where(F.col("score") >= threshold)


def resolve_fuzzy(rest: DataFrame, terms: DataFrame, partners: DataFrame, sequence: bool = True, least: float = FUZZY) -> DataFrame:
    """(raw_text, canonical, score): best term at `least` or above, ties to the smaller name, unless a partner of the
    winner, partners(skill_a, skill_b), comes within MARGIN of it."""
    near = fuzzy_candidates(rest, terms, least - MARGIN - 1e-9, sequence)
    per = near.groupBy("raw_text", "canonical").agg(F.max("score").alias("score"))
    order = Window.partitionBy("raw_text").orderBy(F.desc("score"), "canonical")
    best = per.withColumn("k", F.row_number().over(order)).where((F.col("k") == 1) & (F.col("score") >= least - 1e-9)).drop("k")
    both = partners.select("skill_a", "skill_b").unionByName(partners.select(F.col("skill_b").alias("skill_a"), F.col("skill_a").alias("skill_b"))).distinct()
    rival = best.join(both, best["canonical"] == both["skill_a"]).select("raw_text", F.col("score").alias("won"), F.col("skill_b").alias("canonical")).join(per, ["raw_text", "canonical"])
    vetoed = rival.where(F.col("score") >= F.col("won") - MARGIN - 1e-9).select("raw_text")
    return best.join(vetoed, "raw_text", "left_anti")


def normalize_skills(values: DataFrame, terms: DataFrame, partners: DataFrame, value: str = "raw_text", sequence: bool = True) -> DataFrame:
    """(raw_text, matched, stage, canonical_name, confidence) of every distinct value; each costly stage sees only what
    the one before left over."""
    exact = resolve_exact(values, terms, value)
    rest = exact.where("canonical is null")
    fuzzy = resolve_fuzzy(rest, terms, partners, sequence).select("raw_text", F.col("canonical").alias("f"), "score")
    rows = exact.join(fuzzy, "raw_text", "left")
    return rows.select(
        "raw_text",
        (F.col("canonical").isNotNull() | F.col("f").isNotNull()).alias("matched"),
        F.when(F.col("canonical").isNotNull(), "exact").when(F.col("f").isNotNull(), "fuzzy").otherwise("unmatched").alias("stage"),
        F.coalesce("canonical", "f").alias("canonical_name"),
        F.when(F.col("canonical").isNotNull(), F.lit(1.0)).otherwise(F.round("score", 3)).alias("confidence"),
    )


def _best(queries: list, x: np.ndarray, names: list, matrix: np.ndarray, k: int, least: float) -> pd.DataFrame:
    """The k best of unit vectors `matrix` for each unit vector of x, at most a few megabytes of products at a time. Names
    are in order, so a stable sort settles ties; rounding keeps what only the arithmetic sets apart together."""
    out = []
    step = max(1, 4_000_000 // max(1, len(names)))
    for at in range(0, len(x), step):
        like = x[at : at + step] @ matrix.T
        top = np.argsort(-np.round(like, 12), axis=1, kind="stable")[:, :k]
        r, c = np.nonzero(np.take_along_axis(like, top, 1) >= least)
        pick = top[r, c]
        if len(pick):  # an empty frame has no text type
            out.append(pd.DataFrame({"query": [queries[at + i] for i in r], "item": [names[i] for i in pick], "similarity": like[r, pick]}))
    return pd.concat(out) if out else None


def _unit_rows(ids, vectors) -> dict[int, tuple[list, np.ndarray]]:
    """{dimension: (ids, matrix of unit vectors)} of the vectors that have a length, in the order of the ids."""
    by_size: dict[int, tuple[list, list]] = {}
    for name, v in sorted(zip(ids, vectors, strict=True), key=lambda r: r[0]):
        if v is not None and len(v):
            names, rows = by_size.setdefault(len(v), ([], []))
            names.append(name)
            rows.append(np.asarray(v, np.float64))
    out = {}
    for n, (names, rows) in by_size.items():
        x = np.stack(rows)
        length = np.linalg.norm(x, axis=1)
        ok = np.isfinite(length) & (length > 0)
        out[n] = ([name for name, good in zip(names, ok, strict=True) if good], x[ok] / length[ok, None])
    return out


def knn(queries: DataFrame, base: DataFrame, k: int, least: float, max_base: int = 20_000) -> DataFrame:
    """queries(query, vec), base(item, vec) -> (query, item, similarity, rank): exact cosine top k at `least` or more,
    ties to the smaller item. Vectors that are null, empty or zero take no part, and only equal dimensions meet.

    The base is a reference list. While it has at most max_base vectors, which is checked, it is broadcast as a matrix
    and each Arrow batch of queries is one matrix product; array functions would be interpreted element by element,
    some fifty times slower. A longer base is cut into blocks of about max_base vectors by hash, the queries into blocks
    likewise; each block of one meets each of the other in a task of its own, as a matrix product that lets out k rows a
    query, so memory is bounded, no pair is built and no key is hot.
    """
    kind, name = dict(queries.dtypes)["query"], dict(base.dtypes)["item"]
    schema = f"query {kind}, item {name}, similarity double"
    asked, listed = queries.where("vec is not null and query is not null").select("query", "vec"), base.where("vec is not null and item is not null").select("item", "vec")
    if listed.limit(max_base + 1).count() <= max_base:
        held = listed.toPandas()
        shared = queries.sparkSession.sparkContext.broadcast(_unit_rows(held["item"], held["vec"]))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for n, (ids, x) in _unit_rows(pdf["query"], pdf["vec"]).items():
                    if n in shared.value and (got := _best(ids, x, *shared.value[n], k, least)) is not None:
                        yield got

        scored = asked.mapInPandas(run, schema)
    else:
        parts = lambda df: max(1, -(-df.count() // max_base))
        nb, nq = parts(listed), parts(asked)
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        mine = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        left = asked.select("query", "vec", mine("query", nq).alias("bq"), every(nb).alias("bi"))
        right = listed.select("item", "vec", mine("item", nb).alias("bi"), every(nq).alias("bq"))

        def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            tables = _unit_rows(b["item"], b["vec"])
            got = [_best(ids, x, *tables[n], k, least) for n, (ids, x) in _unit_rows(a["query"], a["vec"]).items() if n in tables]
            got = [g for g in got if g is not None]
            return pd.concat(got) if got else pd.DataFrame({"query": a["query"].iloc[:0], "item": b["item"].iloc[:0], "similarity": pd.Series(dtype="float64")})

        scored = left.groupBy("bq", "bi").cogroup(right.groupBy("bq", "bi")).applyInPandas(meet, schema)
    order = Window.partitionBy("query").orderBy(F.desc(F.round("similarity", 12)), "item")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def infer_occupation(queries: DataFrame, occupations: DataFrame, least: float = OCCUPATION_FLOOR) -> DataFrame:
    """queries(query, vec), occupations(item, vec) -> (query, item, similarity): the nearest occupation, where it reaches the
    floor; a query below it gets no row instead of a guess."""
    return knn(queries, occupations, 1, least).drop("rank")


def drop_blocked(suggestions: DataFrame, terms: DataFrame, partners: DataFrame, sequence: bool = True, least: float = BLOCK) -> DataFrame:
    """suggestions(raw_text, canonical, ...) without those whose text resembles a partner of the suggested name by `least` or
    more: by tokens or, with sequence, by the sequence ratio. The ratio is worked out only where lengths allow it."""
    both = partners.select("skill_a", "skill_b").unionByName(partners.select(F.col("skill_b").alias("skill_a"), F.col("skill_a").alias("skill_b"))).distinct()
    rivals = suggestions.select("raw_text", "canonical").distinct().join(both, F.col("canonical") == F.col("skill_a"))
    rivals = rivals.join(terms.select("term", F.col("canonical").alias("owner")), F.col("skill_b") == F.col("owner")).withColumn("norm", T.normalize_term("raw_text"))
    blocked = rivals.where(S.token_jaccard("norm", "term") >= least).select("raw_text", "canonical")
    if sequence:
        likely = rivals.where(S.length_bound(F.col("norm"), F.col("term")) >= least)
        blocked = blocked.unionByName(likely.where(S.sequence_ratio(F.col("norm"), F.col("term")) >= least).select("raw_text", "canonical"))
    return suggestions.join(blocked.distinct(), ["raw_text", "canonical"], "left_anti")
