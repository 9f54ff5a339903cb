"""Queries over the engine's services, seams and round trips: what is written and read again must be what it was."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork import api
from loomwork.functions import text as T
from loomwork.functions.embedders import StubEmbedder, embed
from loomwork.operators import documents as D
from loomwork.operators import store as R
from loomwork.plans import matching, stores
from loomwork.plans import sql as S
from loomwork.plans.texts import resume_segments
from loomwork.session import materialize, temporary_path
from loomwork.sources import feeds, files
from loomwork.tables import load

QUERIES, ORACLE = {}, {}


def _add(name: str, sql: str | None = None):
    def wrap(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return wrap


@_add(
    "txt_flat_split",
    f"""with {S.resume_sections()}, t as (select doc, unnest(list_transform(regexp_split_to_array("text", '[,;|/]'), lambda x: {S.bullet('x')})) item
    from seg where section_type = 'skills' and not is_header)
    select doc, item, count(*) as n from t where item <> '' group by doc, item""",
)
def txt_flat_split(spark, d) -> DataFrame:
    """Every token of the skill sections, repeats counted."""
    return D.split_list(resume_segments(spark, d), "skills", False).groupBy("doc", "item").agg(F.count("*").alias("n"))


@_add("txt_category_key", f"select id, 'feed:' || regexp_replace(lower({S.strip('category')}), '\\s+', '_', 'g') as category from skills")
def txt_category_key(spark, d) -> DataFrame:
    return load(spark, d, "skills").select("id", T.category_key("category", "feed").alias("category"))


@_add("api_taxonomy", matching.ORACLE["join_taxonomy_browse"])
def api_taxonomy(spark, d) -> DataFrame:
    return api.taxonomy(spark, d)


@_add(
    "api_rank_jobs",
    """select id, job_id, cast(rule_based_score as double) as score from (select distinct id, job_id, resume_id, rule_based_score from matches)
    where resume_id = (select min(resume_id) from matches)""",
)
def api_rank_jobs(spark, d) -> DataFrame:
    """All matches of one candidate, the first by id."""
    first = load(spark, d, "matches").agg(F.min("resume_id")).first()[0]
    return api.rank_jobs(spark, d, first).select("id", "job_id", F.col("rule_based_score").cast("double").alias("score"))


@_add("api_validate", stores.ORACLE["ev_check_passed"])
def api_validate(spark, d) -> DataFrame:
    return api.validate(stores._claims(spark, d), stores._paths(spark, d)[0])[1]


_SCORE = """0.0::double + 0.35::double * required_skill_coverage + 0.2::double * semantic_experience_similarity + 0.15::double * project_relevance_similarity
    + 0.1::double * preferred_skill_coverage + 0.1::double * education_match + 0.1::double * (seniority_match + years_experience_match) / 2"""


@_add(
    "api_match",
    f"""with a as (select cand, job, round(({_SCORE}) * 100, 2) score from (select * from {matching._ALL_SQL}))
    select cand, job, score, cast(row_number() over (partition by cand order by score desc, job) as bigint) as rank from a""",
)
def api_match(spark, d) -> DataFrame:
    """Score out of 100 and rank of every labelled pair, worked out from the texts."""
    return api.match(spark, d).select("cand", "job", "score", F.col("rank").cast("bigint").alias("rank"))


@_add(
    "lookup_weights",
    """with w as (select version, is_active, k, v from (values (1, true, 'education_match', 0.2), (2, true, 'education_match', 0.3), (3, false,
    'education_match', 0.9)) t(version, is_active, k, v)),
    n as (select k, arg_max(v, version) v from w where is_active group by k),
    b as (select * from (values ('required_skill_coverage', 0.35), ('semantic_experience_similarity', 0.2), ('project_relevance_similarity', 0.15),
    ('preferred_skill_coverage', 0.1), ('education_match', 0.1), ('seniority_and_experience', 0.1)) t(k, v))
    select b.k as feature, cast(coalesce(n.v, b.v) as double) as weight from b left join n using (k)""",
)
def lookup_weights(spark, d) -> DataFrame:
    """The newest active weights over the defaults (no table of the data holds any, so three rows are made)."""
    rows = spark.createDataFrame([(1, True, {"education_match": 0.2}), (2, True, {"education_match": 0.3}), (3, False, {"education_match": 0.9})], "version int, is_active boolean, weights map<string,double>")
    return spark.createDataFrame(sorted(api.active_weights(rows).items()), "feature string, weight double")


@_add(
    "sink_update_values",
    """with n as (select skill_id, min(trim(alias)) a from skill_aliases group by skill_id)
    select s.id, case when n.skill_id is null then s.category else n.a end as category from skills s left join n on n.skill_id = s.id""",
)
def sink_update_values(spark, d) -> DataFrame:
    """One column changed in place for the keys that a second table names."""
    new = load(spark, d, "skill_aliases").groupBy(F.col("skill_id").alias("id")).agg(F.min(F.trim("alias")).alias("category"))
    return R.update_values(load(spark, d, "skills").select("id", "category"), new, "id", "category")


@_add(
    "sink_upsert_labels",
    """with o as (select id, any_value(label) label from training_labels where label_source is not null group by id having min(label_source) < 'e'),
    n as (select id, any_value(label) / 3 label from training_labels where label_source is not null group by id having max(label_source) >= 'd')
    select coalesce(o.id, n.id) as id, cast(case when n.id is null then o.label else round(cast(n.label as double), 2) end as double) as label,
    case when n.id is null then -1 when o.id is null then 1 else 0 end as inserted from o full join n on n.id = o.id""",
)
def sink_upsert_labels(spark, d) -> DataFrame:
    """The table that an upsert leaves, and for each key whether it was new (1), known (0) or not sent (-1)."""
    rows = load(spark, d, "training_labels").where("label_source is not null").groupBy("id")
    rows = rows.agg(F.min("label_source").alias("lo"), F.max("label_source").alias("hi"), F.first("label").cast("double").alias("label"))
    old, new = rows.where("lo < 'e'").select("id", "label"), rows.where("hi >= 'd'").select("id", (F.col("label") / 3).alias("label"))
    table, outcome = R.upsert(old, new, ["id"], "label", "label", 2)
    return table.join(outcome, "id", "left").fillna(-1, ["inserted"])


@_add("udf_embed_memo", "select distinct id, cast(length(chunk_text) % 7 + 1 as double) as first, 4 as size from text_embeddings where chunk_text is not null")
def udf_embed_memo(spark, d) -> DataFrame:
    """Vectors of all chunks; each different text is embedded once and joined back."""
    rows = load(spark, d, "text_embeddings").select("id", "chunk_text").where("chunk_text is not null").distinct()
    return embed(rows, "chunk_text", "v", StubEmbedder()).select("id", F.col("v")[0].alias("first"), F.size("v").alias("size"))


_PROFILE_SQL = """select id as ref, parsed_profile.contact.email as email, parsed_profile.summary as summary, len(parsed_profile.skills) as skills
    from resumes where parsed_profile is not null"""


def _profiles(spark, d) -> DataFrame:
    p = F.col("parsed_profile")
    contact = F.struct(*[p["contact"][c].alias(c) for c in ("name", "email", "phone", "location", "links")])
    profile = F.struct(contact.alias("contact"), p["summary"].alias("summary"), p["skills"].alias("skills"))
    return load(spark, d, "resumes").where("parsed_profile is not null").select(F.col("id").alias("ref"), profile.alias("profile"))


def _told(rows: DataFrame) -> DataFrame:
    p = F.col("profile")
    return rows.select("ref", p["contact"]["email"].alias("email"), p["summary"].alias("summary"), F.when(p["skills"].isNotNull(), F.size(p["skills"])).cast("bigint").alias("skills"))


@_add("src_json_profiles", _PROFILE_SQL)
def src_json_profiles(spark, d) -> DataFrame:
    """Profiles written as JSON and read again."""
    folder = temporary_path(spark, "profiles")
    feeds.write_profiles(_profiles(spark, d), folder)
    return _told(feeds.profiles(spark, folder, lines=True))


@_add("src_cached", _PROFILE_SQL)
def src_cached(spark, d) -> DataFrame:
    """The same from a cache that is built on the first call and answers the second."""
    folder, built = temporary_path(spark, "cache"), []

    def build() -> DataFrame:
        built.append(1)
        return _told(_profiles(spark, d))

    feeds.cached(spark, build, folder, "v1")
    again = feeds.cached(spark, build, folder, "v1")
    if len(built) != 1:
        raise AssertionError("the cache was built twice")
    return again


@_add("sink_stream_ingest", "select id, min(label_source) as label_source from training_labels where label_source is not null group by id")
def sink_stream_ingest(spark, d) -> DataFrame:
    """Label rows that arrive as a stream of files, each id appended once."""
    from loomwork.streaming.ingest import append_absent, stream_table

    source, target = temporary_path(spark, "arrivals"), temporary_path(spark, "ingested")
    rows = load(spark, d, "training_labels").where("label_source is not null").select("id", "label_source").distinct()
    rows = materialize(rows.groupBy("id").agg(F.min("label_source").alias("label_source")))
    for part in (rows, rows.where(F.pmod(F.xxhash64("id"), F.lit(2)) == 0)):  # the second batch brings what is stored
        part.coalesce(1).write.mode("append").parquet(source)
    stream = stream_table(spark, source, rows.schema, 1)
    append_absent(stream, target, ["id"], "label_source", temporary_path(spark, "checkpoint"), 16).awaitTermination()
    return spark.read.parquet(target).select("id", "label_source")


# --- documents: the texts are packed into files of each type and read back ------------------------------------------------

_LINES_SQL = """with c as (select id doc, regexp_replace(raw_text, '[^ -~\\n\\r]', '', 'g') t from resumes where raw_text is not null),
    l as (select doc, unnest(range(len(a))) i, unnest(a) x from (select doc, regexp_split_to_array(t, '\\r\\n|\\n|\\r') a from c)),
    k as (select doc, i, regexp_replace(trim(x), ' +', ' ', 'g') x from l where trim(x) <> '')
    select doc, cast(row_number() over (partition by doc order by i) - 1 as bigint) as pos, x as \"text\" from k"""


def _docx(lines: list[str], extra: bool = False) -> bytes:
    space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    paragraphs = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in lines)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{space}"><w:body>{paragraphs}</w:body></w:document>')
        if extra:
            z.writestr("word/extra.xml", '<!DOCTYPE a [<!ENTITY b "c">]><a/>')
    return out.getvalue()


def _pdf(lines: list[str]) -> bytes:
    shown = "\n".join("(" + re.sub(r"([\\()])", r"\\\1", x) + ") Tj T*" for x in lines)
    body = zlib.compress(f"BT /F1 10 Tf 14 TL 50 750 Td\n{shown} ET".encode("latin-1"))
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>"]
    objects += [b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>"]
    objects += [b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(body), body), b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, o) for k, o in enumerate(objects, 1)) + b"%%EOF"


def _packed(spark, d, ending: str, pack: Callable[[list[str], str], bytes]) -> DataFrame:
    """The printable ASCII lines of every resume as one file each, parsed."""
    rows = load(spark, d, "resumes").where("raw_text is not null").select("id", F.regexp_replace("raw_text", r"[^ -~\n\r]", "").alias("t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            content = [pack([x for x in re.split(r"\r\n|\n|\r", t) if x.strip()], t) for t in pdf["t"]]
            yield pd.DataFrame({"path": pdf["id"] + ending, "length": [len(c) for c in content], "content": content})

    return files.parse_documents(rows.mapInPandas(run, "path string, length long, content binary"))


def _lines_of(documents: DataFrame) -> DataFrame:
    lines = files.document_lines(documents)
    return lines.select(F.split_part("doc", F.lit("."), F.lit(1)).alias("doc"), "pos", F.regexp_replace("text", " +", " ").alias("text"))


@_add("src_docx_lines", _LINES_SQL)
def src_docx_lines(spark, d) -> DataFrame:
    return _lines_of(_packed(spark, d, ".docx", lambda lines, _: _docx(lines)))


@_add("src_pdf_lines", _LINES_SQL)
def src_pdf_lines(spark, d) -> DataFrame:
    return _lines_of(_packed(spark, d, ".pdf", lambda lines, _: _pdf(lines)))


@_add(
    "src_docx_refused",
    f"""with n as ({_LINES_SQL}), has as (select distinct doc from n), c as (select id doc, length(regexp_replace(raw_text, '[^ -~\\n\\r]', '', 'g')) k from resumes where raw_text is not null)
    select c.doc, case when k % 2 = 0 then 'refused part: word/extra.xml' when has.doc is null then 'no text' end as error from c left join has on has.doc = c.doc""",
)
def src_docx_refused(spark, d) -> DataFrame:
    """Archives of texts of even length declare an entity in one of their parts."""
    rows = _packed(spark, d, ".docx", lambda lines, t: _docx(lines, len(t) % 2 == 0))
    return rows.select(F.split_part("path", F.lit("."), F.lit(1)).alias("doc"), "error")


@_add(
    "src_upload_verdict",
    """with f as (select id, original_filename p, octet_length(encode(raw_text)) n, raw_text t,
    case when contains(original_filename, '.') then lower(regexp_extract(original_filename, '[^.]*$')) else '' end e from resumes where raw_text is not null and original_filename is not null)
    select id, case when n > 4000 then 'too large' when e not in ('txt', 'docx', 'pdf') then 'unsupported type: ' || case e when '' then 'none' else e end
    when e in ('docx', 'pdf') then 'content does not match the type' when not regexp_matches(t, '\\S') then 'no text' end as error from f""",
)
def src_upload_verdict(spark, d) -> DataFrame:
    """What an upload of each text under its file's name would be told, with a cap of 4,000 bytes."""
    rows = load(spark, d, "resumes").where("raw_text is not null and original_filename is not null")
    content = F.encode("raw_text", "UTF-8")
    rows = rows.select(F.concat("id", F.lit("/"), "original_filename").alias("path"), F.octet_length("raw_text").cast("bigint").alias("length"), content.alias("content"))
    return files.parse_documents(rows, most=4000).select(F.split_part("path", F.lit("/"), F.lit(1)).alias("id"), "error")
