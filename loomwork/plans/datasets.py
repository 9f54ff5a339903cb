"""Queries that build labelled sets: labels, samples, components, splits, leakage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.operators import datasets as B
from loomwork.operators.graph import components
from loomwork.tables import load

QUERIES, ORACLE = {}, {}


def _add(name: str, sql: str | None = None):
    def wrap(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return wrap


_SPLIT = "nullif(lower(trim(dataset_split)), '')"
_LABELS = f"""lb as (select id, any_value(resume_id) resume_id, any_value(job_id) job_id, any_value(external_resume_ref) r,
    any_value(external_job_ref) j, cast(any_value(label) as double) as label, any_value(label_source) label_source, any_value({_SPLIT}) s
    from training_labels group by id)"""


def labels(spark, d) -> DataFrame:
    """Label rows once each: id, resume_id, job_id, r, j, label, label_source, s (the cleaned split)."""
    t = load(spark, d, "training_labels")
    split = F.lower(F.trim("dataset_split"))
    return t.select("id", "resume_id", "job_id", F.col("external_resume_ref").alias("r"), F.col("external_job_ref").alias("j"), F.col("label").cast("double").alias("label"), "label_source", F.when(split != "", split).alias("s")).dropDuplicates(["id"])


@_add("src_label_map", f"""with {_LABELS}, n as (select id,
    case label when 0 then 'No Fit' when 0.5 then 'Potential Fit' when 1 then 'Good Fit' end as name from lb) select id, name,
    cast(case name when 'No Fit' then 0 when 'Potential Fit' then 0.5 else 1 end as double) as value from n where name is not null""")
def src_label_map(spark, d):
    name = F.when(F.col("label") == 0, "No Fit").when(F.col("label") == 0.5, "Potential Fit").when(F.col("label") == 1, "Good Fit")
    return labels(spark, d).select("id", name.alias("name")).where("name is not null").select("id", "name", B.fit_label("name").alias("value"))


@_add("prj_tier_label", """select id,
    cast(case when rule_based_score >= 70 then 0.9 when rule_based_score >= 40 then 0.5 else 0.1 end as double) as tier from matches
    where rule_based_score is not null group by all""")
def prj_tier_label(spark, d):
    return load(spark, d, "matches").where("rule_based_score is not null").select("id", B.tier_label(F.col("rule_based_score").cast("double")).alias("tier")).distinct()


@_add("prj_pair_label", """select a.id,
    cast(case when a.seniority is null or b.seniority is null then null when a.seniority = b.seniority then 0.8 else 0.2 end as double) as label
    from (select id, company, parsed_profile.seniority from jobs) a(id, company, seniority) join (select company, min(parsed_profile.seniority)
    from jobs group by company) b(company, seniority) using (company)""")
def prj_pair_label(spark, d):
    """A job's level against the first level of its company: equal, different or unknown."""
    j = load(spark, d, "jobs").select("id", "company", F.col("parsed_profile.seniority").alias("a"))
    b = j.groupBy("company").agg(F.min("a").alias("b"))
    return j.join(b, "company").select("id", B.pair_label(F.col("a"), F.col("b")).alias("label"))


@_add("agg_first_wins", "select lower(company) as company, arg_min(source, id) as source from jobs where company is not null and source is not null group by lower(company)")
def agg_first_wins(spark, d):
    j = load(spark, d, "jobs").where("company is not null and source is not null").select(F.lower("company").alias("company"), "source", "id")
    return B.first_wins(j, "company", "source", "id")


@_add("agg_distinct_text", "select substr(sha256(raw_text), 1, 16) as ref, count(*) as copies, min(id) as first_id from resumes where raw_text is not null group by 1")
def agg_distinct_text(spark, d):
    from loomwork.functions.text import text_id

    r = load(spark, d, "resumes").where("raw_text is not null").select(text_id("raw_text").alias("ref"), "id")
    return r.groupBy("ref").agg(F.count("*").alias("copies"), F.min("id").alias("first_id"))


@_add("set_union_all", """select 'label' as kind, label_source as source, cast(label as double) as value from training_labels
    union all select 'match', scoring_model_version, cast(rule_based_score as double) from matches union all select 'match_ml', scoring_model_version,
    cast(ml_score as double) from matches where ml_score is not null""")
def set_union_all(spark, d):
    m = load(spark, d, "matches")
    part = lambda df, k, s, v: df.select(F.lit(k).alias("kind"), F.col(s).alias("source"), F.col(v).cast("double").alias("value"))
    return (
        part(load(spark, d, "training_labels"), "label", "label_source", "label")
        .unionByName(part(m, "match", "scoring_model_version", "rule_based_score"))
        .unionByName(part(m.where("ml_score is not null"), "match_ml", "scoring_model_version", "ml_score"))
    )


@_add("set_union_distinct", """select resume_id, job_id from training_labels where resume_id is not null and job_id is not null
    union select resume_id, job_id from matches where resume_id is not null""")
def set_union_distinct(spark, d):
    a = load(spark, d, "training_labels").where("resume_id is not null and job_id is not null").select("resume_id", "job_id")
    return a.union(load(spark, d, "matches").where("resume_id is not null").select("resume_id", "job_id")).distinct()


@_add("join_label_profiles", f"""with {_LABELS} select case when r.id is not null and j.id is not null then 'kept' else 'skipped' end as outcome,
    count(*) as n from lb left join resumes r on r.id = lb.resume_id left join jobs j on j.id = lb.job_id group by 1""")
def join_label_profiles(spark, d):
    kept, skipped = B.join_profiles(labels(spark, d), load(spark, d, "resumes").select(F.col("id").alias("resume_id")), load(spark, d, "jobs").select(F.col("id").alias("job_id")))
    return kept.select(F.lit("kept").alias("outcome")).unionByName(skipped.select(F.lit("skipped").alias("outcome"))).groupBy("outcome").agg(F.count("*").alias("n"))


_HASH = "md5('42|' || resume_id || '|' || kind || '|' || job_id)"


@_add("sample_per_group", f"""with p as (select distinct m.resume_id, m.job_id,
    case when m.rule_based_score >= 50 then 'positive' else 'negative' end kind from matches m
    where resume_id is not null and rule_based_score is not null)
    select resume_id, kind, job_id from p qualify row_number() over (partition by resume_id, kind order by {_HASH}, job_id) <= 2""")
def sample_per_group(spark, d):
    """At most two positive and two negative jobs a candidate (a sample is what is asked for)."""
    kind = F.when(F.col("rule_based_score") >= 50, "positive").otherwise("negative")
    p = load(spark, d, "matches").where("resume_id is not null and rule_based_score is not null").select("resume_id", "job_id", kind.alias("kind")).distinct()
    return B.sample_per_group(p, ["resume_id", "kind"], "job_id", 2).select("resume_id", "kind", "job_id")


@_add("limit_pairs", """select resume_id, job_id from (select distinct resume_id, job_id from matches where resume_id is not null)
    order by md5('42|' || resume_id || '|' || job_id), resume_id, job_id limit 500""")
def limit_pairs(spark, d):
    """The first 500 pairs of a seeded shuffle (the size of the sample is a parameter of the operator)."""
    p = load(spark, d, "matches").where("resume_id is not null").select("resume_id", "job_id").distinct()
    return p.orderBy(B.hash_order("resume_id", "job_id"), "resume_id", "job_id").limit(500)


_PAIR_START = lambda seed, among: f"(cast('0x' || substr(md5('{seed}|' || l.ref), 1, 8) as bigint) % {among})"


@_add("pair_generation", f"""with l as (select id ref, file_type grp from resumes where file_type is not null),
    r as (select distinct id ref, case source when 'uploaded' then 'pdf' else 'docx' end grp from jobs where source is not null),
    g as (select grp, count(*) m from r group by grp), gg as (select grp, m,
    coalesce(sum(m) over (order by grp rows between unbounded preceding and 1 preceding), 0) a, sum(m) over () n from g),
    p as (select r.ref, a + row_number() over (partition by r.grp order by md5('42|' || r.ref) desc, r.ref) - 1 place from r
    join gg on gg.grp = r.grp),
    q as (select distinct l.ref, coalesce(gg.m, 0) m, coalesce(gg.a, 0) a, (select sum(m) from g) n from l left join gg on gg.grp = l.grp),
    k as (select unnest(range(2)) k),
    pos as (select l.ref, l.a + ({_PAIR_START(43, 'l.m')} + k) % l.m place, cast(0.8 as double) label from q l, k where k < l.m),
    oth as (select l.ref, l.a, l.m, ({_PAIR_START(44, '(l.n - l.m)')} + k) % (l.n - l.m) v from q l, k where k < l.n - l.m),
    neg as (select ref, case when v < a then v else v + m end place, cast(0.2 as double) label from oth)
    select u.ref as left_ref, p.ref as right_ref, u.label from (select * from pos union all select * from neg) u join p on p.place = u.place""")
def pair_generation(spark, d):
    """Two jobs of each resume's own group and two of others, labelled; groups stand in for occupations."""
    left = load(spark, d, "resumes").select(F.col("id").alias("ref"), F.col("file_type").alias("grp"))
    right = load(spark, d, "jobs").where("source is not null").select(F.col("id").alias("ref"), F.when(F.col("source") == "uploaded", "pdf").otherwise("docx").alias("grp"))
    return B.generate_pairs(left, right)


_GRAPH = """with recursive e as (select distinct resume_id a, job_id b from training_labels where resume_id is not null and job_id is not null),
n as (select distinct x.a, y.a c from e x join e y on x.b = y.b), w(a, c) as (select a, c from n union select w.a, n.c from w join n on n.a = w.c),
cc as (select a node, min(c) component from w group by a)"""


@_add("graph_components", f"{_GRAPH} select node, component from cc")
def graph_components(spark, d):
    e = load(spark, d, "training_labels").select("resume_id", "job_id")
    return components(e, "resume_id", "job_id")


def _split_sql(src: str) -> str:
    return f"""g as (select k, count(*) n from {src} where k is not null group by k), p as (select k, n,
    coalesce(sum(n) over (order by md5('42|' || k), k rows between unbounded preceding and 1 preceding), 0) px, sum(n) over () tot from g),
    t as (select coalesce(min(case when px >= floor(tot * cast(0.7 as double)) then px end), max(tot)) tt from p)
    select k, n,
    case when px < floor(tot * cast(0.7 as double)) then 'train' when px - tt < floor(tot * cast(0.15 as double)) then 'val' else 'test' end as split
    from p, t"""


@_add("split_group_resume", f"with {_LABELS}, x as (select resume_id k from lb), {_split_sql('x')}")
def split_group_resume(spark, d):
    return B.grouped_split(labels(spark, d).select(F.col("resume_id").alias("k")), "k")


@_add("split_group_both", f"{_GRAPH}, {_LABELS}, x as (select component k from lb join cc on cc.node = lb.resume_id), {_split_sql('x')}")
def split_group_both(spark, d):
    e = load(spark, d, "training_labels").select("resume_id", "job_id")
    c = components(e, "resume_id", "job_id")
    rows = labels(spark, d).join(c, F.col("resume_id") == F.col("node")).select(F.col("component").alias("k"))
    return B.grouped_split(rows, "k")


@_add("agg_split_counts", f"with {_LABELS} select coalesce(s, 'none') as split, label_source, count(*) as n from lb group by all")
def agg_split_counts(spark, d):
    return labels(spark, d).groupBy(F.coalesce("s", F.lit("none")).alias("split"), "label_source").agg(F.count("*").alias("n"))


@_add("agg_leakage", f"""with {_LABELS} select 'resume' as axis, resume_id as ref, count(distinct s) as splits from lb
    where resume_id is not null and s is not null group by resume_id having count(distinct s) > 1 union all select 'job', job_id, count(distinct s)
    from lb where job_id is not null and s is not null group by job_id having count(distinct s) > 1""")
def agg_leakage(spark, d):
    part = lambda axis, c: B.leaked(labels(spark, d), c, "s").select(F.lit(axis).alias("axis"), F.col(c).alias("ref"), "splits")
    return part("resume", "resume_id").unionByName(part("job", "job_id"))


@_add("sort_group_sizes", f"with {_LABELS} select resume_id, count(*) as size from lb where resume_id is not null group by resume_id")
def sort_group_sizes(spark, d):
    """Group sizes for a ranker; rows of a group lie together and sorted, so counting needs no further shuffle."""
    rows = labels(spark, d).where("resume_id is not null").repartition("resume_id").sortWithinPartitions("resume_id", "id")
    return rows.groupBy("resume_id").agg(F.count("*").alias("size"))


@_add("win_dedupe", f"with {_LABELS} select id from lb qualify row_number() over (partition by r, j, label_source order by id) = 1")
def win_dedupe(spark, d):
    from loomwork.operators.store import dedupe

    return dedupe(labels(spark, d), ["r", "j", "label_source"], "id").select("id")
