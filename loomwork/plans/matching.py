"""Queries over skills, features, scores and ranks."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions import text as T
from loomwork.functions import vectors as V
from loomwork.functions.similarity import token_jaccard
from loomwork.operators import documents as D
from loomwork.operators import features as X
from loomwork.operators import skills as K
from loomwork.plans import sql as S
from loomwork.plans.texts import AS_OF, job_segments, resume_segments
from loomwork.tables import load

QUERIES, ORACLE = {}, {}


def _add(name: str, sql: str | None = None):
    def wrap(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return wrap


# --- skills -----------------------------------------------------------------------------------------------------------


def terms(spark, d) -> DataFrame:
    a = load(spark, d, "skill_aliases").select("skill_id", "alias")
    return K.taxonomy_terms(load(spark, d, "skills").select("id", F.col("canonical_name").alias("name")), a)


def partners(spark, d) -> DataFrame:
    """Confusable names: skills of which one contains the other and a blank (Name, Name Native)."""
    s = load(spark, d, "skills").select("canonical_name")
    head = s.select(F.col("canonical_name").alias("skill_b"), F.regexp_extract("canonical_name", r"^(\S+) ", 1).alias("skill_a")).where("skill_a <> ''")
    return head.join(s, F.col("skill_a") == F.col("canonical_name"), "left_semi").select("skill_a", "skill_b")


_TERMS = f"""tm_u as (select {S.norm_term('canonical_name')} term, canonical_name c, 0 k from skills union all select {S.norm_term('a.alias')},
    s.canonical_name, 1 from skill_aliases a join skills s on s.id = a.skill_id),
tm as (select term, arg_min(c, {{'k': k, 'c': c}}) canonical from tm_u where term <> '' group by term)"""
_PARTNERS = """pt as (select regexp_extract(canonical_name, '^(\\S+) ', 1) skill_a, canonical_name skill_b from skills
    where regexp_extract(canonical_name, '^(\\S+) ', 1) in (select canonical_name from skills)), pb as (select * from pt union select skill_b, skill_a
    from pt)"""
_TOK = lambda c: f"list_distinct(list_filter(regexp_split_to_array({c}, '\\s+'), lambda x: x <> ''))"
_JAC = lambda a, b: f"""case when len({_TOK(a)}) = 0 or len({_TOK(b)}) = 0 then 0 else len(list_intersect({_TOK(a)},
    {_TOK(b)})) / cast(len(list_distinct(list_concat({_TOK(a)}, {_TOK(b)}))) as double) end"""  # noqa: E731
_VALUES = f"vals as (select distinct raw_text, {S.norm_term('raw_text')} norm from normalization_results where raw_text is not null)"
_FUZZY = f"""nr as (select v.raw_text, t.canonical, max({_JAC('v.norm', 't.term')}) score from (select v.* from vals v left
    join tm on tm.term = v.norm where tm.term is null) v, tm t group by v.raw_text, t.canonical having max({_JAC('v.norm', 't.term')}) >= 0.3 - 1e-9),
bs as (select * from nr where score >= 0.4 - 1e-9 qualify row_number() over (partition by raw_text order by score desc, canonical) = 1)"""


@_add("join_exact_term", f"with {_TERMS}, {_VALUES} select raw_text, norm, canonical from vals left join tm on term = norm")
def join_exact_term(spark, d):
    return K.resolve_exact(load(spark, d, "normalization_results"), terms(spark, d))


@_add("join_jaccard", f"with {_TERMS}, {_VALUES}, {_FUZZY} select raw_text, canonical, round(score, 6) as score from nr")
def join_jaccard(spark, d):
    """The token half of the similarity alone, which SQL can repeat, from 0.3: stored values hold one or two tokens."""
    rest = K.resolve_exact(load(spark, d, "normalization_results"), terms(spark, d)).where("canonical is null")
    near = K.fuzzy_candidates(rest, terms(spark, d), 0.3 - 1e-9, sequence=False)
    return near.groupBy("raw_text", "canonical").agg(F.round(F.max("score"), 6).alias("score"))


@_add("anti_competitive", f"""with {_TERMS}, {_VALUES}, {_PARTNERS}, {_FUZZY} select raw_text, canonical, round(score, 6) as score from bs
    where not exists (select 1 from pb join nr on nr.canonical = pb.skill_b
    where pb.skill_a = bs.canonical and nr.raw_text = bs.raw_text and nr.score >= bs.score - 0.1 - 1e-9)""")
def anti_competitive(spark, d):
    """Winners from 0.4 by token similarity, without those a confusable partner comes close to."""
    rest = K.resolve_exact(load(spark, d, "normalization_results"), terms(spark, d)).where("canonical is null")
    return K.resolve_fuzzy(rest, terms(spark, d), partners(spark, d), sequence=False, least=0.4).withColumn("score", F.round("score", 6))


@_add("join_fuzzy_term")
def join_fuzzy_term(spark, d):
    """The whole cascade with the sequence ratio, which SQL lacks."""
    return K.normalize_skills(load(spark, d, "normalization_results"), terms(spark, d), partners(spark, d))


_CHUNK_VECS = """(select id, any_value(cast(embedding as double[384])) e from text_embeddings
    where embedding is not null and embedding_model = 'minilm-384-a' group by id)"""
_SKILL_VECS = "(select canonical_name item, cast(embedding as double[384]) e from skills where embedding is not null)"
_KNN = f"""q as (select id, e, sqrt(array_inner_product(e, e)) n from {_CHUNK_VECS}),
b as (select item, e, sqrt(array_inner_product(e, e)) n from {_SKILL_VECS}),
s as (select q.id, b.item, array_inner_product(q.e, b.e) / (q.n * b.n) v from q, b where q.n > 0 and b.n > 0)"""


def _queries_and_base(spark, d):
    q = load(spark, d, "text_embeddings").where("embedding is not null and embedding_model = 'minilm-384-a'")  # the model of the skills
    q = q.dropDuplicates(["id"]).select(F.col("id").alias("query"), F.col("embedding").alias("vec"))
    return q, load(spark, d, "skills").where("embedding is not null").select(F.col("canonical_name").alias("item"), F.col("embedding").alias("vec"))


@_add("knn_topk", f"""with {_KNN} select id as query, item, round(v, 6) as similarity, cast(row_number() over (partition by id order by v desc,
    item) as bigint) as rank from s qualify row_number() over (partition by id order by v desc, item) <= 3""")
def knn_topk(spark, d):
    q, b = _queries_and_base(spark, d)
    return K.knn(q, b, 3, -1.0).select("query", "item", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("bigint").alias("rank"))


@_add("knn_argmax_floor", f"""with {_KNN} select id as query, item, round(v, 6) as similarity from s where v >= 0.5
    qualify row_number() over (partition by id order by v desc, item) = 1""")
def knn_argmax_floor(spark, d):
    """One nearest name, none below the floor of the occupation inference."""
    q, b = _queries_and_base(spark, d)
    return K.infer_occupation(q, b).select("query", "item", F.round("similarity", 6).alias("similarity"))


@_add("anti_blocklist", f"""with {_TERMS}, {_PARTNERS}, g as (select distinct raw_text, canonical_name c from normalization_results
    where raw_text is not null and canonical_name is not null)
    select raw_text, c as canonical from g where not exists (select 1 from pb join tm on tm.canonical = pb.skill_b
    where pb.skill_a = g.c and {_JAC(S.norm_term('g.raw_text'), 'tm.term')} >= 0.75)""")
def anti_blocklist(spark, d):
    stored = load(spark, d, "normalization_results").where("raw_text is not null and canonical_name is not null").select("raw_text", F.col("canonical_name").alias("canonical")).distinct()
    return K.drop_blocked(stored, terms(spark, d), partners(spark, d), sequence=False)


@_add("anti_blocklist_sequence")
def anti_blocklist_sequence(spark, d):
    """The same with the sequence ratio, which SQL lacks."""
    stored = load(spark, d, "normalization_results").where("raw_text is not null and canonical_name is not null").select("raw_text", F.col("canonical_name").alias("canonical")).distinct()
    return K.drop_blocked(stored, terms(spark, d), partners(spark, d))


@_add("join_taxonomy_browse", """select canonical_name, category, count(alias) as aliases, coalesce(string_agg(trim(alias), '|' order by trim(alias)),
    '') as names from skills s left join skill_aliases a on a.skill_id = s.id group by canonical_name, category""")
def join_taxonomy_browse(spark, d):
    a = load(spark, d, "skill_aliases").select("skill_id", F.trim("alias").alias("alias"))
    rows = load(spark, d, "skills").join(a, F.col("id") == F.col("skill_id"), "left").groupBy("canonical_name", "category")
    return rows.agg(F.count("alias").alias("aliases"), F.array_join(F.array_sort(F.collect_list("alias")), "|").alias("names"))


@_add("lookup_pk", """select m.id, r.original_filename, j.title from (select distinct id, resume_id, job_id from matches) m
    join resumes r on r.id = m.resume_id join jobs j on j.id = m.job_id""")
def lookup_pk(spark, d):
    m = load(spark, d, "matches").select("id", "resume_id", "job_id").distinct()
    r = load(spark, d, "resumes").select(F.col("id").alias("resume_id"), "original_filename")
    j = load(spark, d, "jobs").select(F.col("id").alias("job_id"), "title")
    return m.join(r, "resume_id").join(j, "job_id").select("id", "original_filename", "title")


@_add("vec_cosine", """with t as (select id, entity_type, entity_id, chunk_index, embedding_model m, any_value(cast(embedding as double[384])) e from text_embeddings
    where embedding is not null group by all), u as (select *, sqrt(array_inner_product(e, e)) n from t)
    select a.id, b.id as next_id, round(array_inner_product(a.e, b.e) / (a.n * b.n), 6) as cosine from u a join u b on a.entity_type = b.entity_type
    and a.entity_id = b.entity_id and a.chunk_index + 1 = b.chunk_index and a.m = b.m where a.n > 0 and b.n > 0""")
def vec_cosine(spark, d):
    """Cosine of neighbouring chunks of one resume or job, where one model made both."""
    rows = load(spark, d, "text_embeddings").where("embedding is not null").dropDuplicates(["id"])
    rows = rows.select("id", "entity_type", "entity_id", "chunk_index", F.col("embedding_model").alias("m"), "embedding").where(V.norm("embedding") > 0)
    other = rows.select(F.col("id").alias("next_id"), "entity_type", "entity_id", (F.col("chunk_index") - 1).alias("chunk_index"), "m", F.col("embedding").alias("b"))
    both = rows.join(other, ["entity_type", "entity_id", "chunk_index", "m"])
    return both.select("id", "next_id", F.round(V.cosine("embedding", "b"), 6).alias("cosine"))


# --- features ---------------------------------------------------------------------------------------------------------


def pairs(spark, d) -> DataFrame:
    """The labelled pairs whose texts are stored."""
    return load(spark, d, "training_labels").where("resume_id is not null and job_id is not null").select(F.col("resume_id").alias("cand"), F.col("job_id").alias("job")).distinct()


def candidate_skills(spark, d) -> DataFrame:
    listed = load(spark, d, "resumes").select(F.col("id").alias("cand"), F.explode("parsed_profile.skills").alias("s"))
    return listed.join(terms(spark, d), T.normalize_term("s") == F.col("term")).select("cand", F.col("canonical").alias("skill")).distinct()


def job_skills(spark, d) -> DataFrame:
    """(job, skill, level, w): mentions of listed names in requirement lines."""
    names = load(spark, d, "skills").select(F.col("canonical_name").alias("name"))
    hits = D.scan_names(D.requirements(job_segments(spark, d)), names, ["doc", "idx", "level"])
    return hits.groupBy(F.col("doc").alias("job"), F.col("name").alias("skill"), "level").agg(F.count("*").alias("w"))


_PAIRS = "prs as (select distinct resume_id cand, job_id job from training_labels where resume_id is not null and job_id is not null)"
_HAVE = f"hv as (select distinct r.id cand, tm.canonical skill from (select id, unnest(parsed_profile.skills) s from resumes) r join tm on tm.term = {S.norm_term('r.s')})"
_WANT = f"""wg as (select doc, idx, level, unnest({S.ngrams(chr(34) + 'text' + chr(34))}) g from req), wt as (select doc job, canonical_name skill,
    level, count(distinct idx) w from wg join skills on g = lower(canonical_name) group by doc, canonical_name, level)"""
_COVER = f"""{S.job_sections()}, {S.requirements()}, {_TERMS}, {_PAIRS}, {_HAVE}, {_WANT},
tot as (select job, cast(sum(case level when 'required' then w else 0 end) as double) tr,
    cast(sum(case level when 'preferred' then w else 0 end) as double) tp from wt group by job),
hit as (select p.cand, p.job, cast(sum(case level when 'required' then w else 0 end) as double) mr,
    cast(sum(case level when 'preferred' then w else 0 end) as double) mp from prs p join wt on wt.job = p.job
    join hv on hv.cand = p.cand and hv.skill = wt.skill group by p.cand, p.job),
cov as (select p.cand, p.job, case when coalesce(tr, 0) = 0 then cast(0.7 as double) else coalesce(mr, 0) / tr end f1, case when coalesce(tp,
    0) = 0 then cast(0.7 as double) else coalesce(mp, 0) / tp end f2,
    case when 2 * coalesce(tr, 0) + coalesce(tp, 0) = 0 then cast(0.7 as double) else (2 * coalesce(mr, 0) + coalesce(mp, 0)) / (2 * tr + tp) end f10
    from prs p left join tot on tot.job = p.job left join hit on hit.cand = p.cand and hit.job = p.job)"""


@_add("feat_required_coverage", f"with {_COVER} select cand, job, round(f1, 6) as required_skill_coverage from cov")
def feat_required_coverage(spark, d):
    return X.coverage(pairs(spark, d), candidate_skills(spark, d), job_skills(spark, d)).select("cand", "job", F.round("required_skill_coverage", 6).alias("required_skill_coverage"))


@_add("feat_preferred_coverage", f"with {_COVER} select cand, job, round(f2, 6) as preferred_skill_coverage from cov")
def feat_preferred_coverage(spark, d):
    return X.coverage(pairs(spark, d), candidate_skills(spark, d), job_skills(spark, d)).select("cand", "job", F.round("preferred_skill_coverage", 6).alias("preferred_skill_coverage"))


@_add("feat_importance", f"with {_COVER} select cand, job, round(f10, 6) as importance from cov")
def feat_importance(spark, d):
    return X.coverage(pairs(spark, d), candidate_skills(spark, d), job_skills(spark, d)).select("cand", "job", F.round("skill_importance_weighted_score", 6).alias("importance"))


_BREAK = f"""select p.cand, p.job, coalesce(string_agg(distinct w.skill, '|' order by w.skill) filter (w.level = 'required' and h.skill is not null), '') as matched_required,
    coalesce(string_agg(distinct w.skill, '|' order by w.skill) filter (w.level = 'required' and h.skill is null), '') as missing_required,
    coalesce(string_agg(distinct w.skill, '|' order by w.skill) filter (w.level = 'preferred' and h.skill is not null), '') as matched_preferred,
    coalesce(string_agg(distinct w.skill, '|' order by w.skill) filter (w.level = 'preferred' and h.skill is null), '') as missing_preferred
    from prs p left join wt w on w.job = p.job left join hv h on h.cand = p.cand and h.skill = w.skill group by p.cand, p.job"""


@_add("feat_breakdown", f"with {_COVER} {_BREAK}")
def feat_breakdown(spark, d):
    rows = X.skill_breakdown(pairs(spark, d), candidate_skills(spark, d), job_skills(spark, d))
    return rows.select("cand", "job", *[F.array_join(c, "|").alias(c) for c in rows.columns[2:]])


@_add("agg_count_by", f"with {_COVER} select job, skill, level, w from wt")
def agg_count_by(spark, d):
    return job_skills(spark, d)


def stub(c) -> F.Column:
    """The test embedder: [length % 7 + 1, 1, 0, 0]."""
    return F.array((F.length(c) % 7 + 1).cast("double"), F.lit(1.0), F.lit(0.0), F.lit(0.0))


_STUB_COS = lambda a, b: f"({a} * {b} + 1) / (sqrt({a} * {a} + 1) * sqrt({b} * {b} + 1))"
_AX = lambda c: f"cast(length({c}) % 7 + 1 as double)"


def _pool_sql(section: str) -> str:
    return f"""with {S.resume_sections()}, {S.entries(section)}, {_PAIRS}, t as (select distinct doc, {_AX('b')} x from (select doc, unnest(bullets) b from ent)),
    a as (select id job, i, {_AX('r')} x from (select id, unnest(range(len(parsed_profile.responsibilities))) i, unnest(parsed_profile.responsibilities) r from jobs)),
    m as (select p.cand, p.job, a.i, max({_STUB_COS('a.x', 't.x')}) m from prs p join a on a.job = p.job join t on t.doc = p.cand group by p.cand, p.job, a.i)
    select p.cand, p.job, round(coalesce(avg(m), 0), 6) as similarity from prs p left join m on m.cand = p.cand and m.job = p.job group by p.cand, p.job"""


def _pool(spark, d, section: str) -> DataFrame:
    told = D.entries(resume_segments(spark, d), section).where("bullet is not null").select(F.col("doc").alias("cand"), stub("bullet").alias("vec"))
    asked = load(spark, d, "jobs").select(F.col("id").alias("job"), F.explode("parsed_profile.responsibilities").alias("r")).select("job", stub("r").alias("vec"))
    return X.max_pool_mean(pairs(spark, d), asked, told).withColumn("similarity", F.round("similarity", 6))


@_add("feat_semantic_experience", _pool_sql("experience"))
def feat_semantic_experience(spark, d):
    return _pool(spark, d, "experience")


@_add("feat_project_relevance", _pool_sql("projects"))
def feat_project_relevance(spark, d):
    return _pool(spark, d, "projects")


@_add("feat_domain", f"""with {_PAIRS} select p.cand, p.job, round(coalesce({_STUB_COS(_AX('s'), _AX('a'))}, 0), 6) as similarity from prs p
    left join (select id, parsed_profile.summary s from resumes where trim(coalesce(parsed_profile.summary, '')) <> '') r on r.id = p.cand left
    join (select id, parsed_profile.about a from jobs where trim(coalesce(parsed_profile.about, '')) <> '') j on j.id = p.job""")
def feat_domain(spark, d):
    left = load(spark, d, "resumes").where(F.trim("parsed_profile.summary") != "").select(F.col("id").alias("cand"), stub("parsed_profile.summary").alias("vec"))
    right = load(spark, d, "jobs").where(F.trim("parsed_profile.about") != "").select(F.col("id").alias("job"), stub("parsed_profile.about").alias("vec"))
    return X.document_similarity(pairs(spark, d), left, right).withColumn("similarity", F.round("similarity", 6))


@_add("feat_responsibility", f"""with {S.resume_sections()}, {S.entries('experience')}, {_PAIRS}, t as (select doc, string_agg(b, ' ' order by e,
    k) b from (select doc, entry_no e, unnest(range(len(bullets))) k, unnest(bullets) b from ent) group by doc)
    select p.cand, p.job, round(coalesce({_STUB_COS(_AX('t.b'), _AX('j.r'))}, 0), 6) as similarity from prs p left join t on t.doc = p.cand
    left join (select id, array_to_string(parsed_profile.responsibilities, ' ') r from jobs
    where len(parsed_profile.responsibilities) > 0) j on j.id = p.job""")
def feat_responsibility(spark, d):
    e = D.entries(resume_segments(spark, d), "experience").where("bullet is not null")
    told = e.groupBy(F.col("doc").alias("cand")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("entry_no", "bullet_no", "bullet"))), lambda s: s["bullet"]), " ").alias("b"))
    right = load(spark, d, "jobs").where(F.size("parsed_profile.responsibilities") > 0).select(F.col("id").alias("job"), stub(F.array_join("parsed_profile.responsibilities", " ")).alias("vec"))
    return X.document_similarity(pairs(spark, d), told.select("cand", stub("b").alias("vec")), right).withColumn("similarity", F.round("similarity", 6))



@_add("feat_doc_cosine", f"""with {_PAIRS}, v as (select distinct entity_id, entity_type, chunk_index, cast(embedding as double[]) e
    from text_embeddings where embedding is not null and embedding_model = 'minilm-384-a'),
    u as (select entity_id, entity_type, unnest(range(384)) i, unnest(e) x from v), m as (select entity_id, entity_type, i, avg(x) x from u
    group by all),
    n as (select entity_id, entity_type, sqrt(sum(x * x)) n from m group by all having sum(x * x) > 0),
    s as (select p.cand, p.job, sum(a.x * b.x) s from prs p join m a on a.entity_id = p.cand and a.entity_type = 'resume_experience'
    join m b on b.entity_id = p.job and b.entity_type = 'job_responsibility' and a.i = b.i group by p.cand, p.job)
    select s.cand, s.job, round(s / (na.n * nb.n), 6) as similarity from s join n na on na.entity_id = s.cand and na.entity_type = 'resume_experience'
    join n nb on nb.entity_id = s.job and nb.entity_type = 'job_responsibility'""")
def feat_doc_cosine(spark, d):
    """Whole documents: the mean of a document's chunk vectors, compared by cosine."""
    v = load(spark, d, "text_embeddings").where("embedding is not null and embedding_model = 'minilm-384-a'").select("entity_id", "entity_type", "chunk_index", "embedding").distinct()
    # the mean of vectors as one partially aggregated value, not one of each of their numbers
    doc = v.groupBy("entity_id", "entity_type").agg(Summarizer.mean(array_to_vector("embedding")).alias("m"))
    doc = doc.select("entity_id", "entity_type", vector_to_array("m").alias("vec"))
    side = lambda kind, c: doc.where(F.col("entity_type") == kind).select(F.col("entity_id").alias(c), V.unit("vec").alias(c + "_v"))
    rows = pairs(spark, d).join(side("resume_experience", "cand"), "cand").join(side("job_responsibility", "job"), "job")
    return rows.where("cand_v is not null and job_v is not null").select("cand", "job", F.round(V.dot("cand_v", "job_v"), 6).alias("similarity"))


_ASKED = lambda expr, c: f"""(select doc, arg_min(v, (case level when 'required' then 0 else 1 end) * 1000000 + idx) {c} from (select doc, level, idx,
    {expr} v from req) where v is not null group by doc)"""  # noqa: E731
_YEARS = f"try_cast(nullif(regexp_extract(\"text\", '{T.YEARS_ASKED}', 1), '') as int)"


@_add("feat_education", f"""with {S.resume_sections()}, {S.job_sections('js')}, {S.requirements('js')}, {_PAIRS},
    a as {_ASKED(S.degree(chr(34) + 'text' + chr(34)), 'asked')},
    h as (select doc, max({S.degree("nullif(regexp_extract(plain, '" + S.q(T.DEGREE) + "', 1), '')")}) has from (select doc,
    {S.strip("regexp_replace(" + S.strip("regexp_replace(" + chr(34) + "text" + chr(34) + ", '^(.*?)" + T.YEAR + "', '\\1')") + ", ',+$', '')")} plain
    from seg where section_type = 'education' and not is_header) group by doc)
    select p.cand, p.job,
    cast(case when asked is null then cast(0.7 as double) when has is null or has < asked then cast(0.3 as double) else cast(1 as double) end as double) as education_match
    from prs p left join a on a.doc = p.job left join h on h.doc = p.cand""")
def feat_education(spark, d):
    asked = X.asked_degree(D.requirements(job_segments(spark, d))).withColumnRenamed("doc", "job")
    has = D.education(resume_segments(spark, d)).groupBy(F.col("doc").alias("cand")).agg(F.max(T.degree_rank("degree")).alias("has"))
    rows = pairs(spark, d).join(asked, "job", "left").join(has, "cand", "left")
    return rows.select("cand", "job", X.education_match(F.col("asked_degree"), F.col("has")).alias("education_match"))


@_add("feat_years", f"""with {S.resume_sections()}, {S.entries('experience')}, {S.experience()}, {S.job_sections('js')}, {S.requirements('js')},
    {_PAIRS}, a as {_ASKED(_YEARS, 'asked')},
    h as (select doc, coalesce(greatest(date_diff('day', min({S.resume_date('start_date', AS_OF)}),
    max({S.resume_date('end_date', AS_OF)})) / cast(365.25 as double), 0), 0) has from expr group by doc)
    select p.cand, p.job, round(case when asked is null or asked = 0 then cast(0.7 as double) else least(coalesce(has, 0) / asked,
    cast(1.5 as double)) end, 6) as years_experience_match from prs p left join a on a.doc = p.job left join h on h.doc = p.cand""")
def feat_years(spark, d):
    asked = X.asked_years(D.requirements(job_segments(spark, d))).withColumnRenamed("doc", "job")
    has = X.experience_years(D.experience(resume_segments(spark, d)), AS_OF).withColumnRenamed("doc", "cand")
    rows = pairs(spark, d).join(asked, "job", "left").join(has, "cand", "left")
    return rows.select("cand", "job", F.round(X.years_match(F.col("asked_years"), F.col("years")), 6).alias("years_experience_match"))


_RANK = lambda c: f"case {c} when 'junior' then 0 when 'mid' then 1 when 'senior' then 2 when 'staff' then 3 end"


@_add("feat_seniority", f"""with {S.resume_sections()}, {S.entries('experience')}, {S.experience()}, {_PAIRS}, t as (select doc,
    arg_min(coalesce(title, ''), entry_no) t from expr group by doc)
    select p.cand, p.job, round(coalesce(1 - abs({_RANK(S.seniority('t.t'))} - {_RANK(S.seniority('j.title'))}) / cast(3 as double), 0.7),
    6) as seniority_match from prs p left join t on t.doc = p.cand left join jobs j on j.id = p.job""")
def feat_seniority(spark, d):
    first = D.experience(resume_segments(spark, d)).groupBy(F.col("doc").alias("cand")).agg(F.min_by("title", "entry_no").alias("t"))
    j = load(spark, d, "jobs").select(F.col("id").alias("job"), "title")
    rows = pairs(spark, d).join(first, "cand", "left").join(j, "job", "left")
    return rows.select("cand", "job", F.round(X.seniority_match(T.seniority("t"), T.seniority("title")), 6).alias("seniority_match"))


#: The query of each feature and the column it gives.
_PARTS = {
    "required_skill_coverage": ("feat_required_coverage", "required_skill_coverage"),
    "preferred_skill_coverage": ("feat_preferred_coverage", "preferred_skill_coverage"),
    "semantic_experience_similarity": ("feat_semantic_experience", "similarity"),
    "project_relevance_similarity": ("feat_project_relevance", "similarity"),
    "education_match": ("feat_education", "education_match"),
    "years_experience_match": ("feat_years", "years_experience_match"),
    "domain_similarity": ("feat_domain", "similarity"),
    "responsibility_similarity": ("feat_responsibility", "similarity"),
    "seniority_match": ("feat_seniority", "seniority_match"),
    "skill_importance_weighted_score": ("feat_importance", "importance"),
}


def feature_vectors(spark, d) -> DataFrame:
    """All ten features of every labelled pair, from the texts. The three coverages come from one pass; the parts share
    their key, so each further join meets a side that is partitioned by it already."""
    covered = [f for f in X.FEATURES if "skill" in f]
    out = X.coverage(pairs(spark, d), candidate_skills(spark, d), job_skills(spark, d))
    out = out.select("cand", "job", *[F.round(f, 6).alias(f) for f in covered])
    for feature, (query, column) in _PARTS.items():
        if feature not in covered:
            out = out.join(QUERIES[query](spark, d).select("cand", "job", F.col(column).alias(feature)), ["cand", "job"])
    return out.select("cand", "job", *X.FEATURES)


_ALL_SQL = " join ".join(f"(select cand, job, {c} as {f} from ({ORACLE[n]})) {f}_t" + (" using (cand, job)" if k else "") for k, (f, (n, c)) in enumerate(_PARTS.items()))


@_add("feat_vector", f"""select cand, job, {", ".join(X.FEATURES)},
    round(cast(0.35 as double) * required_skill_coverage + cast(0.2 as double) * semantic_experience_similarity + cast(0.15 as double) * project_relevance_similarity
    + cast(0.1 as double) * preferred_skill_coverage + cast(0.1 as double) * education_match + cast(0.1 as double) * (seniority_match + years_experience_match) / 2 + 1e-9,
    6) as score from {_ALL_SQL}""")
def feat_vector(spark, d):
    """The whole vector and its score."""
    rows = feature_vectors(spark, d)
    return rows.withColumn("score", F.round(X.rule_score() + 1e-9, 6))


_V = lambda c: f"feature_vector.{c}"
_SCORE = f"0.35 * {_V(X.FEATURES[0])} + cast(0.2 as double) * {_V(X.FEATURES[2])} + cast(0.15 as double) * {_V(X.FEATURES[3])} + cast(0.1 as double) * {_V(X.FEATURES[1])} + cast(0.1 as double) * {_V(X.FEATURES[4])} + cast(0.1 as double) * ({_V(X.FEATURES[8])} + {_V(X.FEATURES[5])}) / 2".replace("0.35 *", "cast(0.35 as double) *", 1)


def scored(spark, d) -> DataFrame:
    m = load(spark, d, "matches").select("id", "resume_id", "job_id", "feature_vector").distinct()
    return m.select("id", "resume_id", "job_id", X.rule_score(prefix="feature_vector.").alias("score"))


@_add("score_rule_based", f"select id, resume_id, job_id, round({_SCORE}, 6) as score from (select distinct id, resume_id, job_id, feature_vector from matches)")
def score_rule_based(spark, d):
    return scored(spark, d).withColumn("score", F.round("score", 6))


@_add("win_rank_jobs", """select id, resume_id, cast(row_number() over (partition by resume_id order by rule_based_score desc, id) as bigint) as rank
    from (select distinct id, resume_id, rule_based_score from matches where resume_id is not null and rule_based_score is not null)""")
def win_rank_jobs(spark, d):
    m = load(spark, d, "matches").where("resume_id is not null and rule_based_score is not null").select("id", "resume_id", "rule_based_score").distinct()
    return X.rank_within(m, "resume_id", "rule_based_score", "id").select("id", "resume_id", F.col("rank").cast("bigint").alias("rank"))


@_add("sort_matches", """select resume_id, id, cast(rule_based_score as double) as score from (select distinct id, resume_id, rule_based_score
    from matches where resume_id is not null)""")
def sort_matches(spark, d):
    """Every candidate's matches, best first: ranges of candidate, score and id, sorted inside, so that a candidate with
    very many matches spreads over several tasks and the files are in order as a whole."""
    m = load(spark, d, "matches").where("resume_id is not null").select("resume_id", "id", F.col("rule_based_score").cast("double").alias("score")).distinct()
    order = ["resume_id", F.desc_nulls_last("score"), "id"]
    return m.repartitionByRange(*order).sortWithinPartitions(*order)


@_add("prj_score_bars", f"""select id, metric, round(value, 6) as value, cast(least(greatest(round(value * 100, 6), 0), 100) as double) as width,
    case when value * 100 >= 70 then 'green' when value * 100 >= 40 then 'amber' else 'red' end as colour from
    (select id, unnest([{", ".join("'" + f + "'" for f in X.FEATURES)}]) metric, unnest([{", ".join(_V(f) for f in X.FEATURES)}]) value
    from (select distinct id, feature_vector from matches)) where value is not null""")
def prj_score_bars(spark, d):
    m = load(spark, d, "matches").select("id", "feature_vector").distinct()
    long = m.select("id", F.explode(F.arrays_zip(F.array(*map(F.lit, X.FEATURES)).alias("metric"), F.array(*[F.col(f"feature_vector.{f}") for f in X.FEATURES]).alias("value"))).alias("p"))
    value, percent = F.col("p.value"), F.col("p.value") * 100
    rows = long.where(value.isNotNull())
    return rows.select("id", F.col("p.metric").alias("metric"), F.round(value, 6).alias("value"), F.least(F.greatest(F.round(percent, 6), F.lit(0.0)), F.lit(100.0)).alias("width"), F.when(percent >= 70, "green").when(percent >= 40, "amber").otherwise("red").alias("colour"))


@_add("dash_avg_top", """select resume_id, count(*) as matches, round(avg(cast(rule_based_score as double)) + 1e-9, 6) as average, arg_max(job_id,
    (rule_based_score, id)) as top_job from (select distinct id, resume_id, job_id, rule_based_score from matches
    where resume_id is not null and rule_based_score is not null) group by resume_id""")
def dash_avg_top(spark, d):
    """Mean score and best job; the tiny addend keeps exact halves from rounding apart between engines."""
    m = load(spark, d, "matches").where("resume_id is not null and rule_based_score is not null").select("id", "resume_id", "job_id", "rule_based_score").distinct()
    return m.groupBy("resume_id").agg(F.count("*").alias("matches"), F.round(F.avg(F.col("rule_based_score").cast("double")) + 1e-9, 6).alias("average"), F.max_by("job_id", F.struct("rule_based_score", "id")).alias("top_job"))


def _gaps(spark, d) -> DataFrame:
    return X.skill_breakdown(pairs(spark, d), candidate_skills(spark, d), job_skills(spark, d)).select("cand", "job", "missing_required")


@_add("dash_common_gaps", f"""with {_COVER} select w.skill, count(*) as n from prs p join (select distinct job, skill from wt
    where level = 'required') w on w.job = p.job left join hv h on h.cand = p.cand and h.skill = w.skill where h.skill is null group by w.skill
    order by n desc, w.skill limit 5""")
def dash_common_gaps(spark, d):
    """The five skills that are missing most often."""
    return _gaps(spark, d).select(F.explode("missing_required").alias("skill")).groupBy("skill").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "skill").limit(5)


@_add("dash_opportunity", f"""with {_COVER}, g as (select p.cand, p.job, count(w.skill) filter (h.skill is null) n from prs p left
    join (select distinct job, skill from wt where level = 'required') w on w.job = p.job left join hv h on h.cand = p.cand and h.skill = w.skill
    group by p.cand, p.job)
    select cand, job, n as missing from g where n > 0 qualify row_number() over (partition by cand order by n, job) = 1""")
def dash_opportunity(spark, d):
    """For every candidate the job with the fewest, but some, missing required skills."""
    g = _gaps(spark, d).select("cand", "job", F.size("missing_required").cast("bigint").alias("missing")).where("missing > 0")
    return g.withColumn("_k", F.row_number().over(Window.partitionBy("cand").orderBy("missing", "job"))).where("_k = 1").drop("_k")


@_add("set_intersect", "select skill from (select distinct lower(trim(unnest(parsed_profile.skills))) skill from resumes) intersect select lower(canonical_name) from skills")
def set_intersect(spark, d):
    a = load(spark, d, "resumes").select(F.explode("parsed_profile.skills").alias("s")).select(F.lower(F.trim("s")).alias("skill"))
    return a.intersect(load(spark, d, "skills").select(F.lower("canonical_name").alias("skill")))


@_add("set_except", "select lower(canonical_name) as skill from skills except select lower(trim(unnest(parsed_profile.skills))) from resumes")
def set_except(spark, d):
    a = load(spark, d, "resumes").select(F.explode("parsed_profile.skills").alias("s")).select(F.lower(F.trim("s")).alias("skill"))
    return load(spark, d, "skills").select(F.lower("canonical_name").alias("skill")).exceptAll(a.distinct())


@_add("semi_missing_skills", f"""with {_COVER}, c as (select distinct p.cand, p.job, w.skill from prs p join wt w on w.job = p.job) select c.cand,
    c.job, c.skill from c where not exists (select 1 from hv where hv.cand = c.cand and hv.skill = c.skill)""")
def semi_missing_skills(spark, d):
    """Claimed gaps (every skill a job names) that are gaps indeed."""
    claims = pairs(spark, d).join(job_skills(spark, d).select("job", "skill").distinct(), "job")
    gaps = X.skill_breakdown(pairs(spark, d), candidate_skills(spark, d), job_skills(spark, d))
    real = gaps.select("cand", "job", F.explode(F.array_union("missing_required", "missing_preferred")).alias("skill"))
    return claims.join(real, ["cand", "job", "skill"], "left_semi").select("cand", "job", "skill")


@_add("txt_token_jaccard", f"""select a.canonical_name as a, b.canonical_name as b,
    round({_JAC('lower(a.canonical_name)', 'lower(b.canonical_name)')}, 6) as score from skills a
    join skills b on a.category = b.category and a.canonical_name < b.canonical_name
    where {_JAC('lower(a.canonical_name)', 'lower(b.canonical_name)')} > 0""")
def txt_token_jaccard(spark, d):
    s = load(spark, d, "skills").select("category", F.col("canonical_name").alias("a"))
    rows = s.join(s.withColumnRenamed("a", "b"), "category").where("a < b")
    return rows.select("a", "b", F.round(token_jaccard(F.lower("a"), F.lower("b")), 6).alias("score")).where("score > 0")
