"""Generated claims checked against what they cite."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions import text as T

#: The only forms a reference may have. Fixed values.
REF_FORMS = [
    r"experience\[(\d+)\]\.bullets\[(\d+)\]",
    r"projects\[(\d+)\]\.bullets\[(\d+)\]",
    r"skills\[(\d+)\]",
    r"certifications\[(\d+)\]",
    r"summary",
    r"responsibilities\[(\d+)\]",
    r"requirements\[(\d+)\]\.text",
    r"about",
    r"title",
]


def valid_ref(ref: str | Column) -> Column:
    return F.coalesce((F.col(ref) if isinstance(ref, str) else ref).rlike("^(?:" + "|".join(REF_FORMS) + ")$"), F.lit(False))


def path_table(parts: dict[str, DataFrame]) -> DataFrame:
    """(doc, ref, text) from {form with # for the index: DataFrame(doc, idx, text)}; '#' is absent in single fields."""
    out = None
    for form, df in parts.items():
        ref = F.lit(form)
        if "#" in form:
            head, tail = form.split("#", 1)
            ref = F.concat(F.lit(head), F.col("idx").cast("string"), F.lit(tail))
        rows = df.select("doc", ref.alias("ref"), "text").where(F.col("text").isNotNull())
        out = rows if out is None else out.unionByName(rows)
    return out


def validate(claims: DataFrame, paths: DataFrame) -> DataFrame:
    """claims(doc, claim_id, text, ref, is_inference) with resolved, kept and drop_reason. Inferences stay; others must
    cite a reference that resolves, and state no number that the cited text lacks."""
    rows = claims.join(paths.select("doc", "ref", F.col("text").alias("resolved")), ["doc", "ref"], "left")
    reason = (
        F.when(F.col("is_inference"), F.lit(None).cast("string"))
        .when(F.col("ref").isNull(), "no reference")
        .when(~valid_ref("ref"), "unknown form")
        .when(F.col("resolved").isNull(), "does not resolve")
        .when(~T.numbers_within("text", "resolved"), "fabricated number")
    )
    return rows.withColumn("drop_reason", reason).withColumn("kept", F.col("drop_reason").isNull())


def validate_recommendations(recs: DataFrame, paths: DataFrame) -> DataFrame:
    """recs(doc, rec_id, suggestion, based_on) with resolved, kept and drop_reason. Unlike claims, recommendations have no
    inferences: what they are based on must resolve, and they state no number that it lacks."""
    claims = recs.select("doc", F.col("rec_id").alias("claim_id"), F.col("suggestion").alias("text"), F.col("based_on").alias("ref"), F.lit(False).alias("is_inference"))
    rows = validate(claims, paths)
    return rows.select("doc", F.col("claim_id").alias("rec_id"), F.col("text").alias("suggestion"), F.col("ref").alias("based_on"), "resolved", "kept", "drop_reason")


def validate_missing(said: DataFrame, computed: DataFrame) -> DataFrame:
    """said(doc, skill) with kept: whether the skill is among the computed gaps, computed(doc, skill), of its document."""
    gaps = computed.select("doc", "skill", F.lit(True).alias("_gap")).distinct()
    return said.join(gaps, ["doc", "skill"], "left").withColumn("kept", F.col("_gap").isNotNull()).drop("_gap")


def explanation_passed(*parts: DataFrame) -> DataFrame:
    """(doc, statements, kept, passed) over validated parts of any kind, each with doc and kept."""
    rows = None
    for part in parts:
        part = part.select("doc", "kept")
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("doc").agg(F.count("*").alias("statements"), F.count_if("kept").alias("kept"), F.bool_and("kept").alias("passed"))


def payload(paths: DataFrame, order: list[str]) -> DataFrame:
    """(doc, payload): every line that may be cited, as [ref] "text", one a line. order lists the forms, index as #, in the
    order they stand; inside a form lines go by index."""
    form = F.regexp_replace("ref", r"\[\d+\]", "[#]")
    index = F.transform(F.regexp_extract_all("ref", F.lit(r"\[(\d+)\]"), 1), lambda x: x.cast("int"))
    place = F.array_position(F.array(*map(F.lit, order)), form)
    line = F.concat(F.lit("["), F.col("ref"), F.lit('] "'), F.col("text"), F.lit('"'))
    rows = paths.select("doc", F.struct(place.alias("p"), index.alias("i"), line.alias("line")).alias("l")).where("l.p > 0")
    return rows.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("payload"))


def fill(template: str, values: dict[str, Column]) -> Column:
    """template with each {name} replaced by a column; null counts as empty. Used for prompts; the wording is the caller's."""
    parts: list[Column] = []
    at = 0
    for m in re.finditer(r"\{(\w+)\}", template):
        parts += [F.lit(template[at : m.start()]), F.coalesce(values[m[1]].cast("string"), F.lit(""))]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def check_passed(validated: DataFrame) -> DataFrame:
    """(doc, claims, kept, passed): passed only if nothing was dropped."""
    return validated.groupBy("doc").agg(F.count("*").alias("claims"), F.count_if("kept").alias("kept"), F.bool_and("kept").alias("passed"))
