"""Ranking and classification metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.session import fresh, materialize


def ndcg(df: DataFrame, group: list[str], relevance: str, score: str, order: str | None = None, k: int = 5, weight: str | None = None) -> DataFrame:
    """(group, items, ndcg) of groups with at least two items: linear gain, discount 1/log2(rank + 1), tied scores share
    the mean gain of their places, 0 if the ideal gain is 0. `order` is not needed, since ties share. With weight a row
    stands for so many.

    Rows are first summed by distinct score, and for the ideal by distinct relevance; only those are put in order, so a
    group with a third of all rows is no larger a window than its number of different scores.
    """
    rows = df.where(F.col(relevance).isNotNull() & F.col(score).isNotNull()).select(*group, F.col(relevance).cast("double").alias("_rel"), F.col(score).cast("double").alias("_s"), (F.col(weight) if weight else F.lit(1)).alias("_w"))

    def gained(value: str, gain: Column) -> DataFrame:
        per = rows.groupBy(*group, value).agg(F.sum("_w").alias("_n"), (F.sum(F.col("_rel") * F.col("_w")) / F.sum("_w")).alias("_a"))
        ahead = F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        per = per.withColumn("_b", ahead)
        places = sum((F.when((F.col("_b") < r) & (F.col("_b") + F.col("_n") >= r), 1 / F.log2(F.lit(r + 1.0))).otherwise(0.0) for r in range(1, k + 1)), F.lit(0.0))
        return per.groupBy(*group).agg(F.sum(gain * places).alias("_g" + value), F.sum("_n").alias("items" + value))

    both = gained("_s", F.col("_a")).join(gained("_rel", F.col("_rel")), group).where("items_s >= 2")
    return both.select(*group, F.col("items_s").alias("items"), F.when(F.col("_g_rel") > 0, F.col("_g_s") / F.col("_g_rel")).otherwise(F.lit(0.0)).alias("ndcg"))


def mrr(df: DataFrame, group: list[str], relevance: str, score: str, order: str, relevant: float = 0.5) -> DataFrame:
    """(group, items, rr) of groups with at least two items: reciprocal rank of the first relevant one, else 0. The rank
    is one more than the rows ahead of the best relevant row, which are counted, not sorted."""
    rows = df.where(F.col(relevance).isNotNull() & F.col(score).isNotNull()).select(*group, F.col(relevance).alias("_rel"), F.col(score).alias("_s"), F.col(order).alias("_o"))
    hit = F.col("_rel") >= relevant
    top = rows.groupBy(*group).agg(F.count("*").alias("items"), F.max(F.when(hit, F.col("_s"))).alias("_m")).where("items >= 2")
    first = rows.where(hit).join(top, group).where("_s = _m").groupBy(*group).agg(F.min("_o").alias("_f"))
    best = top.join(first, group, "left")
    ahead = (F.col("_s") > F.col("_m")) | ((F.col("_s") == F.col("_m")) & (F.col("_o") < F.col("_f")))
    counted = rows.join(best, group).groupBy(*group).agg(F.first("items").alias("items"), F.first("_f").alias("_f"), F.count_if(ahead).alias("_n"))
    return counted.select(*group, "items", F.when(F.col("_f").isNull(), F.lit(0.0)).otherwise(F.lit(1.0) / (F.col("_n") + 1)).alias("rr"))


def confusion(df: DataFrame, group: list[str], relevance: str, score: str, threshold: float = 0.5, weight: str | None = None) -> DataFrame:
    """(group, n, precision, recall, f1); divisions by zero give 0."""
    hit, said = F.col(relevance) >= threshold, F.col(score) >= threshold
    many = lambda c: F.sum(F.when(c, F.col(weight) if weight else F.lit(1)).otherwise(F.lit(0)))
    per = df.where(F.col(relevance).isNotNull() & F.col(score).isNotNull()).groupBy(*group).agg(
        many(F.lit(True)).alias("n"), many(hit & said).alias("_tp"), many(~hit & said).alias("_fp"), many(hit & ~said).alias("_fn")
    )
    safe = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    tp, fp, fn = F.col("_tp"), F.col("_fp"), F.col("_fn")
    return per.select(*group, "n", safe(tp, tp + fp).alias("precision"), safe(tp, tp + fn).alias("recall"), safe(2 * tp, 2 * tp + fp + fn).alias("f1"))


def roc_auc(df: DataFrame, group: list[str], relevance: str, score: str, threshold: float = 0.5, weight: str | None = None) -> DataFrame:
    """(group, auc): by ranks, ties at their mean, null if a group has one class only. Distinct scores are counted
    before they are ranked, so a group's window holds scores instead of rows."""
    rows = df.where(F.col(relevance).isNotNull() & F.col(score).isNotNull())
    per = rows.groupBy(*group, F.col(score).alias("_s")).agg(*[F.sum(F.when(c, F.col(weight) if weight else F.lit(1)).otherwise(F.lit(0))).alias(x) for c, x in ((F.col(relevance) >= threshold, "_p"), (F.col(relevance) < threshold, "_n"))])
    below = Window.partitionBy(*group).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_b", F.coalesce(F.sum("_n").over(below), F.lit(0)))
    out = per.groupBy(*group).agg(F.sum("_p").alias("_p"), F.sum("_n").alias("_n"), F.sum(F.col("_p") * (F.col("_b") + F.col("_n") / F.lit(2.0))).alias("_w"))
    return out.select(*group, F.when((F.col("_p") > 0) & (F.col("_n") > 0), F.col("_w") / (F.col("_p") * F.col("_n"))).alias("auc"))


def min_max(df: DataFrame, score: str, group: list[str], to: str = "scaled") -> DataFrame:
    """df with the score scaled to 0..1 inside its group (without groups: over the whole table); 0.5 where all are equal. Two
    numbers a group are aggregated and joined back, so no group is one task's work; a group may be null."""
    keys = [fresh(df.columns, f"_key{i}") for i in range(len(group))]
    low, high = fresh(df.columns, "_low"), fresh(df.columns, "_high")
    ends = df.groupBy(*[F.col(g).alias(k) for g, k in zip(group, keys, strict=True)]).agg(F.min(score).alias(low), F.max(score).alias(high))
    if group:
        same = F.lit(True)
        for g, k in zip(group, keys, strict=True):
            same = same & df[g].eqNullSafe(ends[k])
        rows = df.join(ends, same, "left")
    else:
        rows = df.crossJoin(F.broadcast(ends))  # one row
    value = F.when(F.col(high) == F.col(low), F.lit(0.5)).otherwise((F.col(score) - F.col(low)) / (F.col(high) - F.col(low)))
    return rows.withColumn(to, value).drop(low, high, *keys)


def clip(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def grade(label: Column) -> Column:
    """Relevance grade 0..4 of a label, halves to even."""
    return F.least(F.greatest(F.bround(label * 4, 0), F.lit(0.0)), F.lit(4.0)).cast("int")


def metrics_by(df: DataFrame, by: list[str], query: str, relevance: str, score: str, order: str, relevant: float = 0.5) -> DataFrame:
    """All metrics for each model and label source, never blended. The rows are reduced once, to how often a query has a score
    and a relevance; what the metrics need is derived from that written table. The rows themselves are looked at once more,
    for those that tie with a query's best relevant one."""
    rows = df.where(F.col(relevance).isNotNull() & F.col(score).isNotNull())
    keys = [*by, query]
    cells = materialize(rows.groupBy(*keys, F.col(relevance).alias("_rel"), F.col(score).alias("_s")).agg(F.count("*").alias("_w"), F.min(order).alias("_o")))
    pooled = cells.groupBy(*by, "_rel", "_s").agg(F.sum("_w").alias("_w"))
    out = confusion(pooled, by, "_rel", "_s", relevant, weight="_w").join(roc_auc(pooled, by, "_rel", "_s", relevant, weight="_w"), by, "left")
    n = ndcg(cells, keys, "_rel", "_s", weight="_w").groupBy(*by).agg(F.avg("ndcg").alias("ndcg5"))
    hit = F.col("_rel") >= relevant
    top = F.max(F.when(hit, F.col("_s"))).over(Window.partitionBy(*keys))
    per = cells.withColumn("_m", top).groupBy(*keys).agg(
        F.sum("_w").alias("_items"),
        F.first("_m").alias("_m"),
        F.sum(F.when(F.col("_s") > F.col("_m"), F.col("_w"))).alias("_higher"),
        F.min(F.when(hit & (F.col("_s") == F.col("_m")), F.col("_o"))).alias("_f"),
    )
    best = per.where("_items >= 2")
    tied = rows.join(best.where("_f is not null"), keys).where((F.col(score) == F.col("_m")) & (F.col(order) < F.col("_f"))).groupBy(*keys).agg(F.count("*").alias("_tied"))
    rank = F.coalesce("_higher", F.lit(0)) + F.coalesce("_tied", F.lit(0)) + 1
    r = best.join(tied, keys, "left").select(*by, F.when(F.col("_f").isNull(), F.lit(0.0)).otherwise(F.lit(1.0) / rank).alias("rr"))
    return out.join(n, by, "left").join(r.groupBy(*by).agg(F.avg("rr").alias("mrr")), by, "left")
