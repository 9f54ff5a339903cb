"""Labelled pairs: labels, samples, splits without leakage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators.features import rank_within

#: Labels of the pair files. Fixed values.
FIT_LABELS = {"No Fit": 0.0, "Potential Fit": 0.5, "Good Fit": 1.0}


def fit_label(c: str | Column) -> Column:
    """The number of a fit label; any other text is an error."""
    table = F.create_map(*[F.lit(x) for item in FIT_LABELS.items() for x in item])
    value = F.try_element_at(table, F.col(c) if isinstance(c, str) else c)
    return F.coalesce(value, F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(c, F.lit("null")))).cast("double"))


def tier_label(score: Column) -> Column:
    """Label of a score out of 100."""
    return F.when(score >= 70, F.lit(0.9)).when(score >= 40, F.lit(0.5)).otherwise(F.lit(0.1))


def pair_label(a: Column, b: Column) -> Column:
    """Label of two occupation groups, null if one is unknown."""
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(a == b, F.lit(0.8)).otherwise(F.lit(0.2))


def first_wins(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value): the value of the first row of each key."""
    return df.groupBy(key).agg(F.min_by(value, order).alias(value))


def hash_order(*cols: str, seed: int = 42) -> Column:
    """A seeded shuffle that any engine can repeat."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def sample_per_group(df: DataFrame, groups: list[str], item: str, n: int, seed: int = 42) -> DataFrame:
    """At most n rows of each group in shuffled order (n is the sample that is asked for)."""
    order = Window.partitionBy(*groups).orderBy(hash_order(*groups, item, seed=seed), item)
    return df.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= n).drop("_k")


def _start(c: str, among: Column, seed: int) -> Column:
    """A seeded number below `among` for each value."""
    return F.pmod(F.conv(F.substring(hash_order(c, seed=seed), 1, 8), 16, 10).cast("bigint"), among)


def generate_pairs(left: DataFrame, right: DataFrame, positives: int = 2, negatives: int = 2, seed: int = 42) -> DataFrame:
    """left(ref, grp), right(ref, grp) -> (left_ref, right_ref, label): for each left ref up to `positives` right refs of its own
    group, labelled as pair_label does, and up to `negatives` of other known groups. Refs without a group have no pairs; each
    side holds a ref once.

    No pair is built that isn't kept: right refs get places, in shuffled order inside their group and group by group, and each
    left ref takes the places behind a seeded start of its own: of its group's places, or of all others, going round. A place
    is one row, so the joins are even however large a group is.
    """
    known = right.where("ref is not null and grp is not null").select("ref", "grp").distinct().withColumn("_h", hash_order("ref", seed=seed))
    placed = rank_within(known, "grp", "_h", "ref").select("grp", F.col("ref").alias("right_ref"), (F.col("rank") - 1).alias("_i"))
    sizes = known.groupBy("grp").agg(F.count("*").alias("_m"))
    before = Window.orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)  # over groups, not rows
    sizes = sizes.select("grp", "_m", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_a"), F.sum("_m").over(Window.partitionBy(F.lit(1))).alias("_all"))
    places = placed.join(sizes, "grp").select("right_ref", (F.col("_a") + F.col("_i")).alias("_place"))
    total = sizes.agg(F.max("_all").alias("_total"))
    asked = left.where("ref is not null and grp is not null").select(F.col("ref").alias("left_ref"), "grp").distinct()
    asked = asked.join(sizes.drop("_all"), "grp", "left").fillna(0, ["_m", "_a"]).crossJoin(F.broadcast(total))  # one row

    def take(n: int, among: Column, salt: int, place: Callable[[Column], Column], a: Column, b: Column) -> DataFrame:
        rows = asked.where(among > 0).withColumn("_k", F.explode(F.sequence(F.lit(0), F.least(F.lit(n), among).cast("int") - 1)))
        at = F.pmod(_start("left_ref", among, seed + salt) + F.col("_k"), among)
        return rows.select("left_ref", place(at).alias("_place"), pair_label(a, b).alias("label")).join(places, "_place").select("left_ref", "right_ref", "label")

    a, m, same, other = F.col("_a"), F.col("_m"), F.lit(0), F.lit(1)
    out = take(positives, m, 1, lambda at: a + at, same, same) if positives else None
    if negatives:
        more = take(negatives, F.col("_total") - m, 2, lambda at: F.when(at < a, at).otherwise(at + m), same, other)
        out = more if out is None else out.unionByName(more)
    return out


def grouped_split(rows: DataFrame, group: str, train: float = 0.7, val: float = 0.15, seed: int = 42, cells: int = 4096) -> DataFrame:
    """(group, n, split): whole groups in shuffled order go to train until it has int(train * total) rows, then to val
    until int(val * total), the rest to test. The running count is a prefix sum over hash cells first and inside each
    cell then, so no task orders all groups."""
    per = rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n")).withColumn("_h", hash_order(group, seed=seed))
    per = per.withColumn("_cell", (F.conv(F.substring("_h", 1, 8), 16, 10).cast("bigint") * cells / 4294967296).cast("int"))
    by_cell = per.groupBy("_cell").agg(F.sum("n").alias("_m"))
    before = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)  # over at most `cells` rows
    by_cell = by_cell.select("_cell", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_before"), F.sum("_m").over(Window.partitionBy(F.lit(1))).alias("_total"))
    inside = Window.partitionBy("_cell").orderBy("_h", group).rowsBetween(Window.unboundedPreceding, -1)
    at = per.withColumn("_in", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(by_cell), "_cell").withColumn("_p", F.col("_before") + F.col("_in"))
    goal = F.floor(F.col("_total") * F.lit(float(train)))
    turn = at.agg(F.min(F.when(F.col("_p") >= goal, F.col("_p"))).alias("_t"))
    out = at.crossJoin(F.broadcast(turn))  # one row
    first = F.coalesce("_t", "_total")
    split = F.when(F.col("_p") < goal, "train").when(F.col("_p") - first < F.floor(F.col("_total") * F.lit(float(val))), "val").otherwise("test")
    return out.select(group, "n", split.alias("split"))


def leaked(rows: DataFrame, ref: str, split: str = "split") -> DataFrame:
    """(ref, splits): refs that occur in more than one split."""
    return rows.where(F.col(ref).isNotNull() & F.col(split).isNotNull()).groupBy(ref).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def assert_no_leak(rows: DataFrame, ref: str, split: str = "split") -> DataFrame:
    """The rows, or an error when they are read if a ref occurs in more than one split."""
    n = leaked(rows, ref, split).agg(F.count("*").alias("_leaks"))
    ok = F.when(F.col("_leaks") > 0, F.raise_error(F.concat(F.col("_leaks").cast("string"), F.lit(f" values of {ref} in more than one split"))).cast("boolean")).otherwise(F.lit(True))
    return rows.crossJoin(F.broadcast(n)).where(ok).drop("_leaks")


def join_profiles(labels: DataFrame, candidates: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, skipped): labels whose both profiles exist, and those that lack one."""
    both = labels.join(candidates, "resume_id", "left_semi").join(jobs, "job_id", "left_semi")
    return both, labels.join(both.select("id"), "id", "left_anti")
