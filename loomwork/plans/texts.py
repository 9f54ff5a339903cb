"""Queries over texts: sources, lines, sections, scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.functions import text as T
from loomwork.functions.redaction import redacted
from loomwork.functions.dates import parse_resume_date
from loomwork.operators import documents as D
from loomwork.operators import features as X
from loomwork.plans import sql as S
from loomwork.tables import load

AS_OF = "2026-01-01"
QUERIES, ORACLE = {}, {}


def _add(name: str, sql: str | None = None):
    def wrap(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return wrap


def resume_lines(spark: SparkSession, d: str) -> DataFrame:
    return D.text_lines(load(spark, d, "resumes").select("id", "raw_text"), "id", "raw_text")


def job_lines(spark: SparkSession, d: str) -> DataFrame:
    return D.text_lines(load(spark, d, "jobs").select("id", "raw_text"), "id", "raw_text")


def resume_segments(spark: SparkSession, d: str) -> DataFrame:
    return D.segments(resume_lines(spark, d), T.RESUME_ALIASES)


def job_segments(spark: SparkSession, d: str) -> DataFrame:
    return D.segments(job_lines(spark, d), T.JOB_ALIASES)


@_add("src_text_lines", f'with {S.lines("resumes")} select doc, pos, "text" from lines')
def src_text_lines(spark, d):
    return resume_lines(spark, d).withColumn("pos", F.col("pos").cast("bigint"))


@_add("src_file_type", """select id, nullif(case when regexp_extract(lower(original_filename), '\\.([^.]+)$', 1) in ('pdf','docx','txt')
    then regexp_extract(lower(original_filename), '\\.([^.]+)$', 1) else '' end, '') as kind from resumes""")
def src_file_type(spark, d):
    return load(spark, d, "resumes").select("id", T.file_type("original_filename").alias("kind"))


@_add("src_magic_prefix", """select id, case file_type when 'pdf' then coalesce(left(raw_text, 5) = '%PDF-', null) when 'docx' then left(raw_text,
    4) = 'PK' || chr(3) || chr(4) else true end as ok from resumes""")
def src_magic_prefix(spark, d):
    return load(spark, d, "resumes").select("id", T.magic_ok(F.col("file_type"), F.encode("raw_text", "UTF-8")).alias("ok"))


@_add("src_text_hash", "select 'resume' as kind, id, substr(sha256(raw_text), 1, 16) as ref from resumes union all select 'job', id, substr(sha256(raw_text), 1, 16) from jobs")
def src_text_hash(spark, d):
    part = lambda t, k: load(spark, d, t).select(F.lit(k).alias("kind"), "id", T.text_id("raw_text").alias("ref"))
    return part("resumes", "resume").unionByName(part("jobs", "job"))


@_add("src_major_group", "select id, split_part(scoring_model_version, '-', 1) as major_group from matches group by all")
def src_major_group(spark, d):
    return load(spark, d, "matches").select("id", F.split_part("scoring_model_version", F.lit("-"), F.lit(1)).alias("major_group")).distinct()


@_add("txt_clean_name", f"""select alias, {S.strip(f"regexp_replace({S.strip('alias')}, '(?i)\\s+software$', '')")} as clean,
    'feed:' || regexp_replace(lower({S.strip('alias')}), '\\s+', '_', 'g') as category from
    (select alias from skill_aliases union all select alias || ' Software' from skill_aliases) group by all""")
def txt_clean_name(spark, d):
    a = load(spark, d, "skill_aliases").select("alias")
    rows = a.unionByName(a.select(F.concat("alias", F.lit(" Software")).alias("alias")))
    return rows.select("alias", T.clean_name("alias").alias("clean"), T.category_key("alias", "feed").alias("category")).distinct()


@_add("txt_normalize_header", f"with {S.lines('resumes')} select distinct \"text\", {S.norm_header(chr(34) + 'text' + chr(34))} as header from lines")
def txt_normalize_header(spark, d):
    return resume_lines(spark, d).select("text").distinct().withColumn("header", T.normalize_header("text"))


@_add("txt_alias_lookup", f"""with {S.lines('resumes')}, {S.aliases(T.RESUME_ALIASES)} select kind, count(*) as n, count(distinct doc) as docs
    from lines join al on al.name = {S.norm_header(chr(34) + 'text' + chr(34))} group by kind""")
def txt_alias_lookup(spark, d):
    rows = resume_lines(spark, d).withColumn("kind", T.alias_type("text", T.RESUME_ALIASES)).where("kind is not null")
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("doc").alias("docs"))


@_add("txt_header_predicate", f"with {S.lines('resumes')} select doc, pos, \"text\" from lines where {S.header_like(chr(34) + 'text' + chr(34))}")
def txt_header_predicate(spark, d):
    return resume_lines(spark, d).where(T.looks_like_header(F.col("text"))).withColumn("pos", F.col("pos").cast("bigint"))


_GLUED = "|".join(T.GLUED_HEADERS)


@_add("txt_unglue_headers", f"""select id, regexp_replace(regexp_replace(raw_text, '\\b({_GLUED})\\n', '\\1', 'g'), '\\b({_GLUED})([A-Z])', '\\1
\\2', 'g') as "text" from resumes where raw_text is not null""")
def txt_unglue_headers(spark, d):
    """Headers are glued first, as broken extraction does it, and then separated again."""
    glued = F.regexp_replace("raw_text", rf"\b({_GLUED})\n", "$1")
    return load(spark, d, "resumes").where("raw_text is not null").select("id", T.unglue_headers(glued).alias("text"))


@_add("txt_bullets", f"with {S.lines('resumes')} select doc, pos, {S.bullet(chr(34) + 'text' + chr(34))} as bullet from lines where regexp_matches(\"text\", '{T.BULLET}')")
def txt_bullets(spark, d):
    return resume_lines(spark, d).where(T.is_bullet(F.col("text"))).select("doc", F.col("pos").cast("bigint").alias("pos"), T.strip_bullet("text").alias("bullet"))


@_add("win_segments", f"""with {S.resume_sections()} select doc, seg_no, any_value(section_type) as section_type, any_value(raw_header) as raw_header,
    count(*) filter (not is_header) as n_lines from seg group by doc, seg_no""")
def win_segments(spark, d):
    return D.section_table(resume_segments(spark, d))


@_add("win_segments_jobs", f"""with {S.job_sections()} select doc, seg_no, any_value(section_type) as section_type,
    any_value(raw_header) as raw_header, count(*) filter (not is_header) as n_lines from seg group by doc, seg_no""")
def win_segments_jobs(spark, d):
    return D.section_table(job_segments(spark, d))


@_add("win_entries", f"""with {S.resume_sections()}, {S.entries('experience')} select doc, cast(entry_no as bigint) as entry_no, header,
    cast(coalesce(len(bullets), 0) as bigint) as bullets, coalesce(array_to_string(bullets, '|'), '') as joined from ent""")
def win_entries(spark, d):
    e = D.entries(resume_segments(spark, d), "experience")
    per = e.groupBy("doc", "entry_no").agg(F.first("header").alias("header"), F.array_sort(F.collect_list(F.when(F.col("bullet").isNotNull(), F.struct("bullet_no", "bullet")))).alias("b"))
    return per.select("doc", "entry_no", "header", F.size("b").cast("bigint").alias("bullets"), F.array_join(F.col("b.bullet"), "|").alias("joined"))


@_add("txt_experience_header", f"""with {S.resume_sections()}, {S.entries('experience')}, {S.experience()} select doc,
    cast(entry_no as bigint) as entry_no, title, organization, start_date, end_date from expr""")
def txt_experience_header(spark, d):
    return D.experience(resume_segments(spark, d)).drop("bullets")


@_add("date_parse_resume", f"""with {S.resume_sections()}, {S.entries('experience')}, {S.experience()}, u as (select start_date t from expr
    union select end_date from expr) select t, {S.resume_date('t', AS_OF)} as day from u where t is not null""")
def date_parse_resume(spark, d):
    e = D.experience(resume_segments(spark, d))
    raw = e.select(F.explode(F.array("start_date", "end_date")).alias("t")).where("t is not null").distinct()
    return raw.select("t", parse_resume_date("t", AS_OF).alias("day"))


@_add("date_span_years", f"""with {S.resume_sections()}, {S.entries('experience')}, {S.experience()}
    select doc, round(coalesce(greatest(date_diff('day', min({S.resume_date('start_date', AS_OF)}),
    max({S.resume_date('end_date', AS_OF)})) / cast(365.25 as double), 0), 0), 6) as years from expr group by doc""")
def date_span_years(spark, d):
    return X.experience_years(D.experience(resume_segments(spark, d)), AS_OF).select("doc", F.round("years", 6).alias("years"))


_EDU_PLAIN = S.strip(f"regexp_replace({S.strip(f"regexp_replace({chr(34)}text{chr(34)}, '^(.*?){T.YEAR}', '\\1')")}, ',+$', '')")


@_add("txt_education", f"""with {S.resume_sections()}, p as (select doc, pos, {_EDU_PLAIN} plain, nullif(regexp_extract("text", '{T.YEAR}'), '') y
    from seg where section_type = 'education' and not is_header),
    r as (select *, nullif(regexp_extract(plain, '{S.q(T.DEGREE)}', 1), '') g,
    list_filter(list_transform(regexp_split_to_array(case when regexp_matches(plain, '{S.q(T.DEGREE)}') then regexp_extract(plain, '{S.q(T.DEGREE)}',
    2) else plain end, ','), lambda x: {S.strip('x')}), lambda x: x <> '') a from p)
    select doc, pos, g as degree, case when len(a) >= 2 then a[1] end as field_of_study, case when len(a) >= 2 then array_to_string(a[2:],
    ', ') when len(a) = 1 then a[1] end as institution, y as graduation_year from r""")
def txt_education(spark, d):
    return D.education(resume_segments(spark, d)).withColumn("pos", F.col("pos").cast("bigint"))


@_add("txt_split_dedupe", f"""with {S.resume_sections()}, t as (select doc, pos, unnest(range(len(a))) k, unnest(a) item from (select doc, pos,
    list_transform(regexp_split_to_array("text", '[,;|/]'), lambda x: {S.bullet('x')}) a from seg where section_type = 'skills' and not is_header))
    select doc, arg_min(item, pos * 100000 + k) as item from t where item <> '' group by doc, lower(item)""")
def txt_split_dedupe(spark, d):
    return D.split_list(resume_segments(spark, d), "skills", True).select("doc", "item")


@_add("txt_contact_regex", f"""with {S.resume_sections()}, f as (select *, min(seg_no) over (partition by doc) f from seg), c as (select doc,
    string_agg("text", chr(10) order by pos) b from f
    where ((seg_no = f and section_type in ('unlabeled', 'other')) or section_type = 'contact') and not is_header group by doc),
    n as (select doc, max(case when is_header then "text" end) n from f where seg_no = f and section_type in ('unlabeled', 'other') group by doc)
    select coalesce(c.doc, n.doc) as doc, n as name, nullif(regexp_extract(b, '{T.EMAIL}'), '') as email, nullif(regexp_extract(b, '{S.q(T.PHONE)}'),
    '') as phone, nullif(regexp_extract(b, '{T.CITY_STATE}'), '') as location,
    coalesce(array_to_string(regexp_extract_all(b, '{T.URL}'), ' '), '') as links from c full join n on c.doc = n.doc""")
def txt_contact_regex(spark, d):
    c = D.contact(resume_segments(spark, d))
    return c.select("doc", "name", "email", "phone", "location", F.coalesce(F.array_join("links", " "), F.lit("")).alias("links"))


@_add("prj_contact_block", f"""with {S.resume_sections()}, f as (select *, min(seg_no) over (partition by doc) f from seg) select doc,
    string_agg("text", chr(10) order by pos) as block from f
    where ((seg_no = f and section_type in ('unlabeled', 'other')) or section_type = 'contact') and not is_header group by doc""")
def prj_contact_block(spark, d):
    return D.contact(resume_segments(spark, d)).where("block is not null").select("doc", "block")


@_add("prj_summary", f"""with {S.resume_sections()}, p as (select doc, seg_no, string_agg("text", ' ' order by pos) t from seg
    where section_type = 'summary' and not is_header group by doc, seg_no)
    select doc, arg_min(t, seg_no) as "text" from p group by doc""")
def prj_summary(spark, d):
    return D.joined_section(resume_segments(spark, d), "summary")


@_add("txt_req_level", f'with {S.job_sections()}, {S.requirements()} select doc, idx, "text", level from req')
def txt_req_level(spark, d):
    return D.requirements(job_segments(spark, d))


@_add("prj_section_lines", f"""with {S.job_sections()} select doc, row_number() over (partition by doc order by pos) - 1 as idx, t as "text" from
    (select *, {S.bullet(chr(34) + 'text' + chr(34))} t from seg where section_type = 'responsibilities' and not is_header) where t <> ''""")
def prj_section_lines(spark, d):
    return D.section_items(job_segments(spark, d), "responsibilities")


@_add("win_first_pick", f"""with {S.job_sections()}, f as (select *, min(seg_no) over (partition by doc) f from seg) select doc, arg_min("text",
    pos) as title from f where seg_no = f and section_type in ('unlabeled', 'other') group by doc""")
def win_first_pick(spark, d):
    return D.job_title(job_segments(spark, d))


@_add("txt_seniority", f"select id, title, {S.seniority('title')} as level from jobs group by all")
def txt_seniority(spark, d):
    return load(spark, d, "jobs").select("id", "title", T.seniority("title").alias("level")).distinct()


@_add("txt_degree_rank", f"""with {S.lines('resumes')} select \"text\", {S.degree(chr(34) + 'text' + chr(34))} as rank from (select distinct \"text\"
    from lines) where {S.degree(chr(34) + 'text' + chr(34))} is not null""")
def txt_degree_rank(spark, d):
    rows = resume_lines(spark, d).select("text").distinct().withColumn("rank", T.degree_rank("text"))
    return rows.where("rank is not null")


@_add("txt_gazetteer_scan", f"""with {S.lines('jobs')}, g as (select doc, unnest({S.ngrams(chr(34) + 'text' + chr(34))}) g from lines)
    select canonical_name as name, count(distinct doc) as docs from g join skills on g = lower(canonical_name) group by canonical_name""")
def txt_gazetteer_scan(spark, d):
    names = load(spark, d, "skills").select(F.col("canonical_name").alias("name"))
    return D.scan_names(job_lines(spark, d), names, ["doc"]).groupBy("name").agg(F.count("*").alias("docs"))


@_add("txt_normalize_term", f"select raw_text, {S.norm_term('raw_text')} as norm from normalization_results where raw_text is not null group by all")
def txt_normalize_term(spark, d):
    return load(spark, d, "normalization_results").where("raw_text is not null").select("raw_text").distinct().withColumn("norm", T.normalize_term("raw_text"))


@_add("arr_numeric_subset", f"""with {S.lines('resumes')}, c as (select "text" a, lead("text") over (partition by doc order by pos) b, doc, pos
    from lines)
    select doc, pos, len(list_filter(list_distinct(regexp_extract_all(a, '{T.NUMBER}')), lambda x: not list_contains(regexp_extract_all(b,
    '{T.NUMBER}'), x))) = 0 as within from c where b is not null""")
def arr_numeric_subset(spark, d):
    rows = resume_lines(spark, d).withColumn("b", F.lead("text").over(Window.partitionBy("doc").orderBy("pos"))).where("b is not null")
    return rows.select("doc", F.col("pos").cast("bigint").alias("pos"), T.numbers_within("text", "b").alias("within"))


@_add("prj_query_text", f"""with {S.resume_sections()}, {S.entries('experience')}, {S.experience()}, t as (select doc, arg_min(title, entry_no) t from expr group by doc)
    select r.id, coalesce(nullif(t.t, ''), array_to_string(r.parsed_profile.skills[1:8], ', ')) as query from resumes r left join t on t.doc = r.id""")
def prj_query_text(spark, d):
    first = D.experience(resume_segments(spark, d)).groupBy("doc").agg(F.min_by("title", "entry_no").alias("t"))
    r = load(spark, d, "resumes").select("id", F.array_join(F.slice(F.col("parsed_profile.skills"), 1, 8), ", ").alias("s"))
    return r.join(first, F.col("id") == F.col("doc"), "left").select("id", F.coalesce(F.when(F.col("t") != "", F.col("t")), F.col("s")).alias("query"))


@_add("prj_doc_text", "select id, trim(coalesce(parsed_profile.summary, '') || ' ' || coalesce(array_to_string(parsed_profile.skills, ', '), '')) as doc from resumes")
def prj_doc_text(spark, d):
    p = F.col("parsed_profile")
    return load(spark, d, "resumes").select("id", F.trim(F.concat(F.coalesce(p["summary"], F.lit("")), F.lit(" "), F.coalesce(F.array_join(p["skills"], ", "), F.lit("")))).alias("doc"))


@_add("prj_chunks", """select id, unnest(range(len(a))) as chunk_index, unnest(a) as chunk_text from (select id, parsed_profile.responsibilities a
    from jobs where parsed_profile.responsibilities is not null)""")
def prj_chunks(spark, d):
    return load(spark, d, "jobs").select("id", F.posexplode("parsed_profile.responsibilities").alias("chunk_index", "chunk_text")).withColumn("chunk_index", F.col("chunk_index").cast("bigint"))


@_add("prj_redact_log", """select id, created_at, case when raw_text is not null then '[REDACTED]' end as raw_text,
    case when parsed_profile is not null then '[REDACTED]' end as parsed_profile,
    cast(len(raw_text) as bigint) as n from resumes""")
def prj_redact_log(spark, d):
    """Rows as they may be logged: sensitive columns are masked at any depth."""
    rows = load(spark, d, "resumes").select("id", "created_at", "raw_text", "parsed_profile", F.length("raw_text").cast("bigint").alias("n"))
    return redacted(rows)


@_add("agg_median", f"with {S.lines('resumes')} select doc, median(cast(length(\"text\") as double)) as body from lines group by doc")
def agg_median(spark, d):
    return D.body_font_size(resume_lines(spark, d).select("doc", F.length("text").cast("double").alias("font_size")))


@_add("metric_extraction_pr", f"""with {S.resume_sections()}, t as (select distinct doc, lower({S.bullet('item')}) item from (select doc,
    unnest(regexp_split_to_array("text", '[,;|/]')) item from seg where section_type = 'skills' and not is_header)),
    x as (select doc, item from t where item <> ''), g as (select distinct id doc, lower(unnest(parsed_profile.skills)) item from resumes),
    n as (select (select count(*) from x join g using (doc, item)) tp, (select count(*) from x) px, (select count(*) from g) pg)
    select round(tp / px, 6) as precision, round(tp / pg, 6) as recall from n""")
def metric_extraction_pr(spark, d):
    found = D.split_list(resume_segments(spark, d), "skills", True).select("doc", F.lower("item").alias("item")).distinct()
    gold = load(spark, d, "resumes").select(F.col("id").alias("doc"), F.explode("parsed_profile.skills").alias("s")).select("doc", F.lower("s").alias("item")).distinct()
    both = found.withColumn("f", F.lit(1)).join(gold.withColumn("g", F.lit(1)), ["doc", "item"], "full_outer")
    tp = F.count_if(F.col("f").isNotNull() & F.col("g").isNotNull())
    return both.agg(F.round(tp / F.count("f"), 6).alias("precision"), F.round(tp / F.count("g"), 6).alias("recall"))
