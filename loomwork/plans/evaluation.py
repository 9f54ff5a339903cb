"""Queries that evaluate rankings: scores of stored matches against labelled pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.operators import metrics as M
from loomwork.operators.store import flatten_metrics, source_metrics
from loomwork.plans.datasets import _LABELS, labels
from loomwork.tables import load

QUERIES, ORACLE = {}, {}


def _add(name: str, sql: str | None = None):
    def wrap(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return wrap


#: Relevance of a match: what its features say about skills; score: what the rules gave.
_X = """x as (select distinct id i, resume_id q, scoring_model_version src, feature_vector.required_skill_coverage rel,
    cast(rule_based_score as double) / 100 sc from matches
    where resume_id is not null and rule_based_score is not null and feature_vector.required_skill_coverage is not null)"""


def ranked(spark, d) -> DataFrame:
    m = load(spark, d, "matches").where("resume_id is not null and rule_based_score is not null and feature_vector.required_skill_coverage is not null")
    return m.select(
        F.col("id").alias("i"), F.col("resume_id").alias("q"), F.col("scoring_model_version").alias("src"), F.col("feature_vector.required_skill_coverage").alias("rel"), (F.col("rule_based_score").cast("double") / 100).alias("sc")
    ).distinct()


def _ndcg_sql(by: str) -> str:
    return f"""r as (select {by}, rel, sc, row_number() over (partition by {by} order by sc desc, i) rk, row_number() over (partition by {by}
    order by rel desc, i) ik, count(*) over (partition by {by}) n from x),
    t as (select {by}, sc, avg(rel) * sum(case when rk <= 5 then 1 / log2(rk + 1) else 0 end) g from r where n >= 2 group by {by}, sc),
    dd as (select {by}, sum(g) dcg from t group by {by}),
    ii as (select {by}, any_value(n) n, sum(case when ik <= 5 then rel / log2(ik + 1) else 0 end) idcg from r where n >= 2 group by {by}),
    nd as (select {by}, n, case when idcg > 0 then dcg / idcg else 0 end v from dd join ii using ({by}))"""


def _mrr_sql(by: str) -> str:
    return f"""k as (select {by}, rel, row_number() over (partition by {by} order by sc desc, i) rk, count(*) over (partition by {by}) n from x),
    mr as (select {by}, any_value(n) n, coalesce(cast(1 as double) / min(case when rel >= 0.5 then rk end), 0) v from k where n >= 2 group by {by})"""


@_add("metric_ndcg5", f"with {_X}, {_ndcg_sql('q')} select q as resume_id, n as items, round(v, 6) as ndcg from nd")
def metric_ndcg5(spark, d):
    return M.ndcg(ranked(spark, d), ["q"], "rel", "sc", "i").select(F.col("q").alias("resume_id"), "items", F.round("ndcg", 6).alias("ndcg"))


@_add("metric_mrr", f"with {_X}, {_mrr_sql('q')} select q as resume_id, n as items, round(v, 6) as rr from mr")
def metric_mrr(spark, d):
    return M.mrr(ranked(spark, d), ["q"], "rel", "sc", "i").select(F.col("q").alias("resume_id"), "items", F.round("rr", 6).alias("rr"))


_CONF = """cf as (select src, count(*) n, count(*) filter (rel >= 0.5 and sc >= 0.5) tp, count(*) filter (rel < 0.5 and sc >= 0.5) fp,
    count(*) filter (rel >= 0.5 and sc < 0.5) fn from x group by src),
pr as (select src, n, case when tp + fp = 0 then 0 else tp / cast(tp + fp as double) end p,
    case when tp + fn = 0 then 0 else tp / cast(tp + fn as double) end r,
    case when 2 * tp + fp + fn = 0 then 0 else 2 * tp / cast(2 * tp + fp + fn as double) end f from cf)"""
_AUC = """rk as (select src, rel >= 0.5 as pos, rank() over (partition by src order by sc) + (count(*) over (partition by src,
    sc) - 1) / cast(2 as double) r from x),
au as (select src,
    case when count(*) filter (pos) > 0 and count(*) filter (not pos) > 0 then (sum(r) filter (pos) - count(*) filter (pos) * (count(*) filter (pos) + 1) / cast(2 as double)) / (cast(count(*) filter (pos) as double) * count(*) filter (not pos)) end v
    from rk group by src)"""


@_add("metric_prf", f"with {_X}, {_CONF} select src, n, round(p, 6) as precision, round(r, 6) as recall, round(f, 6) as f1 from pr")
def metric_prf(spark, d):
    rows = M.confusion(ranked(spark, d), ["src"], "rel", "sc")
    return rows.select("src", "n", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@_add("metric_auc", f"with {_X}, {_AUC} select src, round(v, 6) as auc from au")
def metric_auc(spark, d):
    return M.roc_auc(ranked(spark, d), ["src"], "rel", "sc").select("src", F.round("auc", 6).alias("auc"))


@_add("metric_by_source", f"""with {_X}, {_CONF}, {_AUC}, {_ndcg_sql('src, q')}, {_mrr_sql('src, q')} select pr.src, pr.n, round(p, 6) as precision,
    round(r, 6) as recall, round(f, 6) as f1, round(au.v, 6) as auc,
    round((select avg(v) from nd where nd.src = pr.src), 6) as ndcg5, round((select avg(v) from mr where mr.src = pr.src), 6) as mrr from pr left
    join au on au.src = pr.src""")
def metric_by_source(spark, d):
    rows = M.metrics_by(ranked(spark, d), ["src"], "q", "rel", "sc", "i")
    return rows.select("src", "n", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "auc", "ndcg5", "mrr")])


@_add("sink_metric_flatten", f"with {_X}, {_CONF} select src, unnest(['precision', 'recall', 'f1']) as metric, round(unnest([p, r, f]), 6) as value from pr")
def sink_metric_flatten(spark, d):
    rows = M.confusion(ranked(spark, d), ["src"], "rel", "sc")
    return flatten_metrics(rows, ["src"], ["precision", "recall", "f1"]).withColumn("value", F.round("value", 6))


@_add("sink_experiment_metrics", f"""with {_X}, {_CONF} select src || '__' || unnest(['precision', 'recall', 'f1']) as metric, round(unnest([p, r,
    f]), 6) as value from pr where src is not null""")
def sink_experiment_metrics(spark, d):
    """Metrics of a run under the names an experiment log keeps."""
    rows = M.confusion(ranked(spark, d).where("src is not null"), ["src"], "rel", "sc")
    return source_metrics(rows, "src", ["precision", "recall", "f1"]).withColumn("value", F.round("value", 6))


@_add("math_minmax", f"""with {_X} select i,
    round(case when max(sc) over (partition by q) = min(sc) over (partition by q) then 0.5 else (sc - min(sc) over (partition by q)) / (max(sc) over (partition by q) - min(sc) over (partition by q)) end,
    6) as scaled from x""")
def math_minmax(spark, d):
    return M.min_max(ranked(spark, d), "sc", ["q"]).select("i", F.round(M.clip(F.col("scaled")), 6).alias("scaled"))


@_add("math_grade", f"with {_LABELS} select id, cast(least(greatest(round_even(label * 4, 0), 0), 4) as int) as grade from lb where label is not null")
def math_grade(spark, d):
    return labels(spark, d).where("label is not null").select("id", M.grade(F.col("label")).alias("grade"))


@_add("agg_rollup_scores", """select coalesce(scoring_model_version, '') as version, coalesce(cast(grouping(scoring_model_version) as int),
    0) as all_versions, count(*) as n, round(avg(cast(rule_based_score as double)) + 1e-9, 6) as mean from matches
    group by rollup(scoring_model_version)""")
def agg_rollup_scores(spark, d):
    m = load(spark, d, "matches").rollup("scoring_model_version").agg(F.grouping("scoring_model_version").cast("int").alias("all_versions"), F.count("*").alias("n"), F.round(F.avg(F.col("rule_based_score").cast("double")) + 1e-9, 6).alias("mean"))
    return m.select(F.coalesce("scoring_model_version", F.lit("")).alias("version"), "all_versions", "n", "mean")


def _features(spark, d) -> DataFrame:
    from loomwork.operators.features import FEATURES

    m = load(spark, d, "matches").where("resume_id is not null and rule_based_score is not null").select("id", "resume_id", *[F.col(f"feature_vector.{f}").alias(f) for f in FEATURES], (F.col("rule_based_score").cast("double") / 100).alias("score")).dropna().distinct()
    return m.withColumn("split", F.when(F.pmod(F.xxhash64("resume_id"), F.lit(10)) < 7, "train").otherwise("test"))


@_add("ml_predictions")
def ml_predictions(spark, d):
    """Held-out quality of the learners, per model; fitted on seven tenths of the candidates."""
    from loomwork.operators import learning as L

    rows = _features(spark, d)
    predicted = L.compare(rows.where("split = 'train'"), rows.where("split = 'test'"), "score")
    return M.confusion(predicted, ["model"], "label", "prediction").join(M.roc_auc(predicted, ["model"], "label", "prediction"), "model")
