"""Features of a (candidate, job) pair, the weighted score, ranks and the skill breakdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions import text as T
from loomwork.functions import vectors as V
from loomwork.functions.dates import parse_resume_date, span_years
from loomwork.session import fresh, materialize

NEUTRAL = 0.7
#: Rows of a group that a window may put in order in one task.
WINDOW_ROWS = 1_000_000
FEATURES = [
    "required_skill_coverage",
    "preferred_skill_coverage",
    "semantic_experience_similarity",
    "project_relevance_similarity",
    "education_match",
    "years_experience_match",
    "domain_similarity",
    "responsibility_similarity",
    "seniority_match",
    "skill_importance_weighted_score",
]
#: Weights of the rule score. Fixed values.
WEIGHTS = {
    "required_skill_coverage": 0.35,
    "semantic_experience_similarity": 0.20,
    "project_relevance_similarity": 0.15,
    "preferred_skill_coverage": 0.10,
    "education_match": 0.10,
    "seniority_and_experience": 0.10,
}


def coverage(pairs: DataFrame, have: DataFrame, want: DataFrame) -> DataFrame:
    """pairs(cand, job), have(cand, skill), want(job, skill, level, w) -> the pairs with required, preferred and pooled
    coverage (required mentions count twice in the pool); NEUTRAL where a job asks for nothing."""
    req, pref = F.col("level") == "required", F.col("level") == "preferred"
    part = lambda c, name: F.coalesce(F.sum(F.when(c, F.col("w"))), F.lit(0)).cast("double").alias(name)
    total = want.groupBy("job").agg(part(req, "tr"), part(pref, "tp"))
    hit = pairs.join(want, "job").join(have, ["cand", "skill"], "left_semi").groupBy("cand", "job").agg(part(req, "mr"), part(pref, "mp"))
    rows = pairs.join(total, "job", "left").join(hit, ["cand", "job"], "left").fillna(0.0, ["tr", "tp", "mr", "mp"])
    ratio = lambda m, t: F.when(t == 0, F.lit(NEUTRAL)).otherwise(m / t)
    mr, mp, tr, tp = (F.col(c) for c in ("mr", "mp", "tr", "tp"))
    return rows.select(
        "cand",
        "job",
        ratio(mr, tr).alias("required_skill_coverage"),
        ratio(mp, tp).alias("preferred_skill_coverage"),
        ratio(2 * mr + mp, 2 * tr + tp).alias("skill_importance_weighted_score"),
    )


def skill_breakdown(pairs: DataFrame, have: DataFrame, want: DataFrame) -> DataFrame:
    """Sorted arrays of matched and missing skills at both levels for every pair."""
    named = want.groupBy("job").agg(F.collect_set(F.when(F.col("level") == "required", F.col("skill"))).alias("r"), F.collect_set(F.when(F.col("level") == "preferred", F.col("skill"))).alias("p"))
    own = have.groupBy("cand").agg(F.collect_set("skill").alias("h"))
    rows = pairs.join(named, "job", "left").join(own, "cand", "left")
    some = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    r, p, h = some("r"), some("p"), some("h")
    return rows.select(
        "cand",
        "job",
        F.array_sort(F.array_intersect(r, h)).alias("matched_required"),
        F.array_sort(F.array_except(r, h)).alias("missing_required"),
        F.array_sort(F.array_intersect(p, h)).alias("matched_preferred"),
        F.array_sort(F.array_except(p, h)).alias("missing_preferred"),
    )


def max_pool_mean(pairs: DataFrame, asked: DataFrame, told: DataFrame, vec: str = "vec") -> DataFrame:
    """pairs(cand, job), asked(job, text, vec), told(cand, text, vec): for each asked text the best cosine among the
    told ones, averaged; 0 where a side has none. The cosine of two distinct vectors is computed once a pair of rows;
    both sides are normalised before the join, so the inner step is one dot product."""
    a = asked.select("job", F.monotonically_increasing_id().alias("q"), V.unit(vec).alias("a"))
    t = told.select("cand", V.unit(vec).alias("t")).distinct()
    best = pairs.join(a, "job").join(t, "cand").groupBy("cand", "job", "q").agg(F.max(F.coalesce(V.dot("a", "t"), F.lit(0.0))).alias("m"))
    mean = best.groupBy("cand", "job").agg(F.avg("m").alias("similarity"))
    return pairs.join(mean, ["cand", "job"], "left").fillna(0.0, ["similarity"])


def document_similarity(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """pairs(cand, job), left(cand, vec), right(job, vec): cosine, 0 where a side is absent."""
    a, b = left.select("cand", V.unit("vec").alias("a")), right.select("job", V.unit("vec").alias("b"))
    rows = pairs.join(a, "cand", "left").join(b, "job", "left")
    return rows.select("cand", "job", F.coalesce(V.dot("a", "b"), F.lit(0.0)).alias("similarity"))


def asked_degree(requirements: DataFrame) -> DataFrame:
    """(doc, degree): of the first required line that names one, else the first preferred line."""
    rows = requirements.withColumn("r", T.degree_rank("text")).where("r is not null")
    return rows.groupBy("doc").agg(F.min_by("r", F.struct(F.when(F.col("level") == "required", 0).otherwise(1), "idx")).alias("asked_degree"))


def asked_years(requirements: DataFrame) -> DataFrame:
    """(doc, years): of the first required line that states a number, else the first preferred line."""
    rows = requirements.withColumn("y", T.required_years("text")).where("y is not null")
    return rows.groupBy("doc").agg(F.min_by("y", F.struct(F.when(F.col("level") == "required", 0).otherwise(1), "idx")).alias("asked_years"))


def experience_years(entries: DataFrame, as_of: str) -> DataFrame:
    """(doc, years) from entries(doc, start_date, end_date)."""
    return entries.groupBy("doc").agg(span_years(parse_resume_date("start_date", as_of), parse_resume_date("end_date", as_of)).alias("years"))


def education_match(asked: Column, has: Column) -> Column:
    return F.when(asked.isNull(), F.lit(NEUTRAL)).when(has.isNull() | (has < asked), F.lit(0.3)).otherwise(F.lit(1.0))


def years_match(asked: Column, has: Column) -> Column:
    return F.when(asked.isNull() | (asked == 0), F.lit(NEUTRAL)).otherwise(F.least(F.coalesce(has, F.lit(0.0)) / asked, F.lit(1.5)))


def seniority_match(candidate: Column, job: Column) -> Column:
    a, b = T.seniority_rank(candidate), T.seniority_rank(job)
    return F.when(a.isNull() | b.isNull(), F.lit(NEUTRAL)).otherwise(1 - F.abs(a - b) / F.lit(3.0))


def rule_score(weights: dict[str, float] | None = None, prefix: str = "") -> Column:
    """The weighted score, at most about 1; seniority and years share one weight."""
    w = WEIGHTS | (weights or {})
    f = lambda name: F.col(prefix + name)
    out = sum((F.lit(float(v)) * f(k) for k, v in w.items() if k != "seniority_and_experience"), F.lit(0.0))
    return out + F.lit(float(w["seniority_and_experience"])) * (f("seniority_match") + f("years_experience_match")) / 2


def rank_within(df: DataFrame, group: str, score: str, tie: str) -> DataFrame:
    """df with the rank of every row in its group, best score first, nulls last, ties to the smaller `tie`; rows without a
    group are a group of their own.

    The groups are counted first. While the largest has at most WINDOW_ROWS rows, a window numbers them. Else rows are
    range-partitioned by group, score and tie, so a hot group spreads over many tasks; each part is numbered by itself and
    starts where the parts before it end. Only (group, part) counts are put in order across parts. Both give the same ranks.
    """
    largest = df.groupBy(group).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0
    if largest <= WINDOW_ROWS:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), tie)).cast("bigint"))
    part, ahead, other = fresh(df.columns, "_part"), fresh(df.columns, "_ahead"), fresh(df.columns, "_other")
    ranged = materialize(df.repartitionByRange(F.col(group), F.desc(score), F.col(tie)).withColumn(part, F.spark_partition_id()))
    before = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(group, part).agg(F.count("*").alias(ahead)).withColumn(ahead, F.coalesce(F.sum(ahead).over(before), F.lit(0)))
    sizes = sizes.select(F.col(group).alias(other), F.col(part).alias(other + "_part"), ahead)
    here = F.row_number().over(Window.partitionBy(group, part).orderBy(F.desc(score), tie))
    at = ranged.join(sizes, ranged[group].eqNullSafe(sizes[other]) & (ranged[part] == sizes[other + "_part"]))
    return at.withColumn("rank", here + F.col(ahead)).drop(part, ahead, other, other + "_part")
