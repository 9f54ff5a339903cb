"""Problem 6: the N best items of every group, however large the group is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.session import fresh
from loomwork.tables import load


def top_n_per_group(
    df: DataFrame, group: str, item: str, order: list[Column], n: int, salts: int = 8, rank: str = "rank"
) -> DataFrame:
    """Rows of the n best distinct items of every group, with their rank.

    order: sort columns, best first; item is appended as the last tie breaker, so equal scores always give the same
    rows. Two stages: each group is hashed by item into `salts` subgroups, where every item is reduced to its best row,
    ranked and cut to n, and the at most n * salts survivors of a group are ranked again. Rows move by group and item, so
    a hot group lies evenly over all tasks, whatever `salts` is; each task cuts its part of a subgroup to n before the
    subgroups come together.

    Rows with a null group or item are left out. Repeated rows of an item count once, whatever their order; the best of
    them stays. Null scores sort where `order` puts them. An empty table gives an empty result. All columns of
    the input stay; the rank gets a free name if `rank` is taken.
    """
    if n < 1 or salts < 1:
        raise ValueError("n and salts must be positive")
    rank = fresh(df.columns, rank)
    names = [*df.columns, rank]
    salt, first = fresh(names, "__salt"), fresh(names, "__first")
    keys = [*order, F.col(item).asc()]
    rows = df.where(F.col(group).isNotNull() & F.col(item).isNotNull())
    rows = rows.withColumn(salt, F.pmod(F.xxhash64(F.col(item)), F.lit(salts)))
    per_item = Window.partitionBy(group, salt, item).orderBy(*order)
    once = rows.withColumn(first, F.row_number().over(per_item)).where(F.col(first) == 1)
    subgroup = Window.partitionBy(group, salt).orderBy(*keys)
    survivors = once.withColumn(first, F.row_number().over(subgroup)).where(F.col(first) <= n)
    best = survivors.withColumn(rank, F.row_number().over(Window.partitionBy(group).orderBy(*keys)))
    return best.where(F.col(rank) <= n).drop(salt, first)


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, "matches").select("id", "resume_id", "rule_based_score", "created_at")
    return df.where(F.col("rule_based_score").isNotNull())


def _order() -> list[Column]:
    return [F.col("rule_based_score").desc_nulls_last(), F.col("created_at").desc_nulls_last()]


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = top_n_per_group(_matches(spark, sf_dir), "resume_id", "id", _order(), 5)
    return best.select("resume_id", F.col("id").alias("match_id"))


def p6_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows with rank, score and how far each lies below the group's best."""
    best = top_n_per_group(_matches(spark, sf_dir), "resume_id", "id", _order(), 5)
    top = F.max("rule_based_score").over(Window.partitionBy("resume_id"))
    return best.select(
        "resume_id",
        F.col("id").alias("match_id"),
        F.col("rank").cast("long").alias("rank"),
        F.col("rule_based_score").cast("double").alias("score"),
        F.round((top - F.col("rule_based_score")).cast("double"), 6).alias("below_best"),
    )


_RANKED_SQL = """
with rows as (select distinct resume_id, id, rule_based_score s, created_at from matches
              where resume_id is not null and rule_based_score is not null and id is not null),
once as (select * from rows
         qualify row_number() over (partition by resume_id, id order by s desc, created_at desc nulls last) = 1),
best as (select *, row_number() over (partition by resume_id order by s desc, created_at desc nulls last, id) r
         from once qualify r <= 5)
"""

QUERIES = {"p6_found": p6_found, "p6_ranked": p6_ranked}
ORACLE = {
    "p6_found": _RANKED_SQL + "select resume_id, id as match_id from best",
    "p6_ranked": _RANKED_SQL
    + """select resume_id, id as match_id, cast(r as bigint) as rank, cast(s as double) as score,
       round(cast(max(s) over (partition by resume_id) - s as double), 6) as below_best from best""",
}
