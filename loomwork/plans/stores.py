"""Queries over stored tables: inserts, replacements, deletions, evidence checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.functions import text as T
from loomwork.operators import evidence as E
from loomwork.operators import store as R
from loomwork.tables import load

QUERIES, ORACLE = {}, {}


def _add(name: str, sql: str | None = None):
    def wrap(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return wrap


@_add("sink_insert_absent", """select min(id) as id, resume_id, job_id from matches m where scoring_model_version <> 'weights-v1' and resume_id is not null
    and not exists (select 1 from matches e where e.scoring_model_version = 'weights-v1' and e.resume_id = m.resume_id and e.job_id = m.job_id) group by resume_id, job_id""")
def sink_insert_absent(spark, d):
    """Later scorings of pairs that the first version has not scored."""
    m = load(spark, d, "matches").where("resume_id is not null").select("id", "resume_id", "job_id", "scoring_model_version")
    old, new = m.where("scoring_model_version = 'weights-v1'"), m.where("scoring_model_version <> 'weights-v1'")
    return R.insert_absent(old, new, ["resume_id", "job_id"], "id").select("id", "resume_id", "job_id")


@_add("sink_resolve_fk", """select n.result_id, s.id as skill_id, n.canonical_name from (select distinct result_id, canonical_name
    from normalization_results) n join skills s using (canonical_name)""")
def sink_resolve_fk(spark, d):
    rows = load(spark, d, "normalization_results").select("result_id", "canonical_name").distinct()
    names = load(spark, d, "skills").select("id", F.col("canonical_name").alias("name"))
    return R.resolve_fk(rows, names, "canonical_name", "skill_id")


_NEW = """nw as (select 'job_responsibility' entity_type, id entity_id, unnest(range(len(a))) chunk_index, unnest(a) chunk_text from (select id,
    parsed_profile.responsibilities a from jobs where len(parsed_profile.responsibilities) > 0))"""


@_add("sink_replace", f"""with {_NEW} select entity_type, entity_id, cast(chunk_index as bigint) as chunk_index, chunk_text from nw union all
    select entity_type, entity_id, cast(chunk_index as bigint), chunk_text from (select distinct id, entity_type, entity_id, chunk_index, chunk_text
    from text_embeddings) t where not exists (select 1 from nw where nw.entity_type = t.entity_type and nw.entity_id = t.entity_id)""")
def sink_replace(spark, d):
    """Chunks of every job written anew from its profile, the others kept."""
    old = load(spark, d, "text_embeddings").select("id", "entity_type", "entity_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "chunk_text").distinct().drop("id")
    jobs = load(spark, d, "jobs").where(F.size("parsed_profile.responsibilities") > 0)
    new = jobs.select(F.lit("job_responsibility").alias("entity_type"), F.col("id").alias("entity_id"), F.posexplode("parsed_profile.responsibilities").alias("chunk_index", "chunk_text"))
    return R.replace(old, new.withColumn("chunk_index", F.col("chunk_index").cast("bigint")), ["entity_type", "entity_id"])


_GONE = "gone as (select id from resumes where raw_text is null or trim(raw_text) = '')"


def _gone(spark, d):
    return load(spark, d, "resumes").where("raw_text is null or trim(raw_text) = ''").select("id")


@_add("sink_cascade_delete", f"""with {_GONE} select 'parent' as tbl, count(*) as n from resumes where id not in (select id from gone)
    union all select 'matches', count(*) from matches m where not exists (select 1 from gone where gone.id = m.resume_id)
    union all select 'chunks', count(*) from text_embeddings t where not exists (select 1 from gone where gone.id = t.entity_id)""")
def sink_cascade_delete(spark, d):
    """Resumes without text go, and what hangs on them."""
    children = {"matches": (load(spark, d, "matches"), "resume_id"), "chunks": (load(spark, d, "text_embeddings"), "entity_id")}
    left = R.delete_cascade(load(spark, d, "resumes"), _gone(spark, d), "id", children)
    out = None
    for name, df in left.items():
        n = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("tbl"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@_add("sink_nullify_fk", f"""with {_GONE} select distinct t.id, case when gone.id is null then t.resume_id end as resume_id from training_labels t
    left join gone on gone.id = t.resume_id""")
def sink_nullify_fk(spark, d):
    rows = load(spark, d, "training_labels").select("id", "resume_id").distinct()
    return R.nullify(rows, "resume_id", _gone(spark, d), "id").select("id", "resume_id")


@_add("src_upsert_counts", "select label_source, count(*) - count(distinct id) as again, count(distinct id) as inserted from training_labels group by label_source")
def src_upsert_counts(spark, d):
    """Rows an upsert by id would insert and meet again."""
    rows = load(spark, d, "training_labels")
    return rows.groupBy("label_source").agg((F.count("*") - F.count_distinct("id")).alias("again"), F.count_distinct("id").alias("inserted"))


# --- evidence: stored responsibilities as what claims cite -------------------------------------------------------------

#: For each responsibility a faithful claim, one with a changed number, one that cites past the end, and an inference.
_CLAIMS = """rs as (select id doc, i, t from (select id, unnest(range(len(parsed_profile.responsibilities))) i,
    unnest(parsed_profile.responsibilities) t from jobs)),
cl as (select doc, 'faithful-' || i claim_id, t txt, 'responsibilities[' || i || ']' as ref, false inf from rs union all select doc, 'changed-' || i,
    t || ' 4711', 'responsibilities[' || i || ']', false from rs
    union all select doc, 'beyond-' || i, t, 'responsibilities[' || (i + 1000) || ']', false from rs union all select doc, 'inferred-' || i,
    t || ' 4711', null, true from rs),
ck as (select c.*, r.t res,
    case when inf then null when ref is null then 'no reference' when r.t is null then 'does not resolve' when len(list_filter(regexp_extract_all(txt,
    '\\d+(?:\\.\\d+)?'), lambda x: not list_contains(regexp_extract_all(r.t, '\\d+(?:\\.\\d+)?'), x))) > 0 then 'fabricated number' end why
    from cl c left join rs r on r.doc = c.doc and c.ref = 'responsibilities[' || r.i || ']')"""


def _paths(spark, d):
    r = load(spark, d, "jobs").select(F.col("id").alias("doc"), F.posexplode("parsed_profile.responsibilities").alias("idx", "text"))
    return E.path_table({"responsibilities[#]": r}), r


def _claims(spark, d):
    _, r = _paths(spark, d)
    ref = lambda i: F.concat(F.lit("responsibilities["), i.cast("string"), F.lit("]"))
    part = lambda kind, text, at, inf: r.select("doc", F.concat(F.lit(kind + "-"), F.col("idx").cast("string")).alias("claim_id"), text.alias("text"), at.alias("ref"), F.lit(inf).alias("is_inference"))
    more = F.concat(F.col("text"), F.lit(" 4711"))
    return (
        part("faithful", F.col("text"), ref(F.col("idx")), False)
        .unionByName(part("changed", more, ref(F.col("idx")), False))
        .unionByName(part("beyond", F.col("text"), ref(F.col("idx") + 1000), False))
        .unionByName(part("inferred", more, F.lit(None).cast("string"), True))
    )


@_add("ev_validate_claims", f"with {_CLAIMS} select doc, claim_id, why is null as kept, why as drop_reason from ck")
def ev_validate_claims(spark, d):
    return E.validate(_claims(spark, d), _paths(spark, d)[0]).select("doc", "claim_id", "kept", "drop_reason")


@_add("ev_check_passed", f"with {_CLAIMS} select doc, count(*) as claims, count(*) filter (why is null) as kept, bool_and(why is null) as passed from ck group by doc")
def ev_check_passed(spark, d):
    return E.check_passed(E.validate(_claims(spark, d), _paths(spark, d)[0]))


@_add("ev_attach_text", f"with {_CLAIMS} select doc, claim_id, res as evidence from ck where why is null and not inf")
def ev_attach_text(spark, d):
    return E.validate(_claims(spark, d), _paths(spark, d)[0]).where("kept and not is_inference").select("doc", "claim_id", F.col("resolved").alias("evidence"))


#: For each responsibility a faithful suggestion, one with a number it lacks, and one that is based on nothing.
_RECS = _CLAIMS + """, rc as (select doc, 'faithful-' || i rec_id, t txt, 'responsibilities[' || i || ']' as ref, t res from rs
    union all select doc, 'changed-' || i, t || ' 4711', 'responsibilities[' || i || ']', t from rs union all select doc, 'baseless-' || i, t, null,
    null from rs),
rk as (select doc, rec_id, case when ref is null then 'no reference' when len(list_filter(regexp_extract_all(txt, '\\d+(?:\\.\\d+)?'),
    lambda x: not list_contains(regexp_extract_all(res, '\\d+(?:\\.\\d+)?'), x))) > 0 then 'fabricated number' end why from rc)"""


def _recs(spark, d):
    _, r = _paths(spark, d)
    ref = F.concat(F.lit("responsibilities["), F.col("idx").cast("string"), F.lit("]"))
    part = lambda kind, text, at: r.select("doc", F.concat(F.lit(kind + "-"), F.col("idx").cast("string")).alias("rec_id"), text.alias("suggestion"), at.alias("based_on"))
    faithful, changed = part("faithful", F.col("text"), ref), part("changed", F.concat(F.col("text"), F.lit(" 4711")), ref)
    return faithful.unionByName(changed).unionByName(part("baseless", F.col("text"), F.lit(None).cast("string")))


@_add("ev_validate_recommendations", f"with {_RECS} select doc, rec_id, why is null as kept, why as drop_reason from rk")
def ev_validate_recommendations(spark, d):
    return E.validate_recommendations(_recs(spark, d), _paths(spark, d)[0]).select("doc", "rec_id", "kept", "drop_reason")


_GAPS = """ls as (select id doc, unnest(parsed_profile.skills) skill from resumes), said as (select distinct doc, skill from ls union select doc,
    canonical_name from (select distinct doc from ls), (select canonical_name from skills order by 1 limit 3)),
gap as (select distinct canonical_name skill from skills where category = (select min(category) from skills))"""


def _said_and_gaps(spark, d):
    """What a document says is missing (its own skills and the first three names) and what is (names of one category)."""
    listed = load(spark, d, "resumes").select(F.col("id").alias("doc"), F.explode("parsed_profile.skills").alias("skill"))
    names = load(spark, d, "skills").select("canonical_name", "category")
    first = names.agg(F.slice(F.array_sort(F.collect_list("canonical_name")), 1, 3).alias("n"))  # the fixed skill table
    more = listed.select("doc").distinct().crossJoin(F.broadcast(first)).select("doc", F.explode("n").alias("skill"))
    said = listed.unionByName(more).distinct()
    least = names.agg(F.min("category").alias("category"))
    gaps = names.join(least, "category").select(F.col("canonical_name").alias("skill")).distinct()
    return said, said.join(gaps, "skill", "left_semi").select("doc", "skill")


@_add("ev_missing_skills", f"with {_GAPS} select doc, skill, skill in (select skill from gap) as kept from said")
def ev_missing_skills(spark, d):
    return E.validate_missing(*_said_and_gaps(spark, d)).select("doc", "skill", "kept")


@_add("ev_explanation_passed", f"""with {_RECS}, b as (select doc, why is null k from ck union all select doc, why is null from rk) select doc,
    count(*) as statements, count(*) filter (k) as kept, bool_and(k) as passed from b group by doc""")
def ev_explanation_passed(spark, d):
    paths = _paths(spark, d)[0]
    return E.explanation_passed(E.validate(_claims(spark, d), paths), E.validate_recommendations(_recs(spark, d), paths))


@_add("prj_evidence_payload", """with r as (select id doc, unnest(range(len(parsed_profile.responsibilities))) i,
    unnest(parsed_profile.responsibilities) t from jobs),
    l as (select id doc, 0 p, 0 i, '[title] "' || parsed_profile.title || '"' x from jobs union all select id, 1, 0,
    '[about] "' || parsed_profile.about || '"' from jobs union all select doc, 2, i, '[responsibilities[' || i || ']] "' || t || '"' from r)
    select doc, string_agg(x, chr(10) order by p, i) as payload from l where x is not null group by doc""")
def prj_evidence_payload(spark, d):
    """Every line of a job that may be cited, tagged with its reference."""
    return E.payload(json_resolve_ref(spark, d), ["title", "about", "responsibilities[#]"])


@_add("prj_prompt", """with q as (select id, list_sort(list_transform(parsed_profile.skills, lambda x: lower(x))) s from resumes)
    select id as doc, 'Skills: ' || coalesce(array_to_string(s, ', '), '') || chr(10) || 'Count: ' || coalesce(cast(len(s) as varchar), '') as prompt from q""")
def prj_prompt(spark, d):
    """A template filled from columns; the wording is a parameter."""
    skills = F.array_sort(F.transform("parsed_profile.skills", F.lower))
    rows = load(spark, d, "resumes").select(F.col("id").alias("doc"), skills.alias("s"))
    return rows.select("doc", E.fill("Skills: {skills}\nCount: {n}", {"skills": F.array_join("s", ", "), "n": F.when(F.col("s").isNotNull(), F.size("s"))}).alias("prompt"))


@_add("json_resolve_ref", """with r as (select id doc, unnest(range(len(parsed_profile.responsibilities))) i,
    unnest(parsed_profile.responsibilities) t from jobs) select doc, 'responsibilities[' || i || ']' as ref, t as \"text\" from r union all select id,
    'title', parsed_profile.title from jobs where parsed_profile.title is not null union all select id, 'about', parsed_profile.about from jobs
    where parsed_profile.about is not null""")
def json_resolve_ref(spark, d):
    _, r = _paths(spark, d)
    j = load(spark, d, "jobs")
    one = lambda f: j.select(F.col("id").alias("doc"), F.col(f"parsed_profile.{f}").alias("text"))
    return E.path_table({"responsibilities[#]": r, "title": one("title"), "about": one("about")})


@_add("txt_json_props", "select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k from events")
def txt_json_props(spark, d):
    return load(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@_add("evt_tumbling", "select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def evt_tumbling(spark, d):
    from loomwork.streaming.windows import tumbling

    return tumbling(load(spark, d, "events"), "1 hour").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@_add("evt_sessions", """with g as (select user_id, ts, value, case when ts - lag(ts) over (partition by user_id order by ts,
    event_id) < interval '30 minutes' then 0 else 1 end b, event_id from events),
    s as (select user_id, ts, sum(b) over (partition by user_id order by ts, event_id) k from g) select user_id, min(ts) as start, count(*) as n
    from s group by user_id, k""")
def evt_sessions(spark, d):
    from loomwork.streaming.windows import sessions

    return sessions(load(spark, d, "events"), "30 minutes").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@_add("src_numbers", "select id, len(list_distinct(regexp_extract_all(raw_text, '\\d+(?:\\.\\d+)?'))) as n from resumes where raw_text is not null")
def src_numbers(spark, d):
    return load(spark, d, "resumes").where("raw_text is not null").select("id", F.size(T.numbers("raw_text")).cast("bigint").alias("n"))
