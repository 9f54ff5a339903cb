"""From texts to lines, sections, entries and structured profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions import text as T

#: Names up to which a scan broadcasts them; some hundred bytes each.
MAX_BROADCAST_NAMES = 200_000


def text_lines(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, pos, text): stripped, non-blank lines numbered from 0. Map-only: blank lines go before the explode."""
    kept = F.filter(F.transform(F.split(F.col(text), T.LINE_BREAK), T.strip), lambda line: line != "")
    return docs.where(F.col(text).isNotNull()).select(F.col(doc).alias("doc"), F.posexplode(kept).alias("pos", "text"))


def body_font_size(lines: DataFrame) -> DataFrame:
    """(doc, body): exact median of the stated sizes."""
    return lines.groupBy("doc").agg(F.median("font_size").alias("body"))


def segments(lines: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """lines(doc, pos, text[, font_size, bold, style_name]) with seg_no, is_header, section_type and raw_header. A line
    that is a known header, or looks like one (type other), starts a segment; lines before any header are unlabeled."""
    has = set(lines.columns)
    rows = lines
    if "font_size" in has:
        rows = rows.join(body_font_size(lines), "doc", "left")
    at: dict[str, Column] = {k: F.col(c) for k, c in (("style", "style_name"), ("bold", "bold"), ("size", "font_size")) if c in has}
    if "font_size" in has:
        at["body"] = F.col("body")
    known = T.alias_type("text", aliases)
    kind = F.coalesce(known, F.when(T.looks_like_header(F.col("text"), **at), "other"))
    order = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_kind", kind)
    return rows.select(
        "doc",
        "pos",
        "text",
        *([F.col("style_name")] if "style_name" in has else []),
        F.col("_kind").isNotNull().alias("is_header"),
        F.count_if(F.col("_kind").isNotNull()).over(order).alias("seg_no"),
        F.coalesce(F.last("_kind", ignorenulls=True).over(order), F.lit("unlabeled")).alias("section_type"),
        F.last(F.when(F.col("_kind").isNotNull(), F.col("text")), ignorenulls=True).over(order).alias("raw_header"),
    )


def section_table(segmented: DataFrame) -> DataFrame:
    """One row a section: (doc, seg_no, section_type, raw_header, n_lines). A leading part without lines has no row, a
    header without lines has one."""
    return segmented.groupBy("doc", "seg_no").agg(
        F.first("section_type").alias("section_type"), F.first("raw_header").alias("raw_header"), F.count_if(~F.col("is_header")).alias("n_lines")
    )


def entries(segmented: DataFrame, section_type: str) -> DataFrame:
    """(doc, entry_no, header, bullet_no, bullet): a plain line begins an entry, bullets attach to it across sections of
    the same type; bullets before any entry are dropped. An entry without bullets has one row with a null bullet."""
    style = F.col("style_name") if "style_name" in segmented.columns else None
    lines = segmented.where((F.col("section_type") == section_type) & ~F.col("is_header"))
    order = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("_b", T.is_bullet(F.col("text"), style))
    lines = lines.withColumn("entry_no", F.count_if(~F.col("_b")).over(order)).where("entry_no > 0")
    grouped = lines.groupBy("doc", "entry_no").agg(
        F.max(F.when(~F.col("_b"), F.col("text"))).alias("header"),
        F.array_sort(F.collect_list(F.when(F.col("_b"), F.struct("pos", T.strip_bullet("text").alias("t"))))).alias("b"),
    )
    return grouped.select("doc", "entry_no", "header", F.posexplode_outer("b").alias("bullet_no", "b")).select("doc", "entry_no", "header", "bullet_no", F.col("b.t").alias("bullet"))


def experience_header(c: str = "header") -> list[Column]:
    """title, organization, start_date, end_date of an entry's header: 'Title, Org -- Start to End', else what stands
    before the first comma is the title."""
    head = F.col(c)
    known = head.rlike(T.EXPERIENCE_HEADER)
    dates = T.strip(F.regexp_extract(head, T.EXPERIENCE_HEADER, 3))
    ranged = dates.rlike(T.DATE_RANGE)
    return [
        F.when(known, T.strip(F.regexp_extract(head, T.EXPERIENCE_HEADER, 1))).otherwise(T.strip(F.split(head, ",")[0])).alias("title"),
        F.when(known, T.strip(F.regexp_extract(head, T.EXPERIENCE_HEADER, 2))).alias("organization"),
        F.when(known & ranged, T.strip(F.regexp_extract(dates, T.DATE_RANGE, 1))).when(known & (dates != ""), dates).alias("start_date"),
        F.when(known & ranged, T.strip(F.regexp_extract(dates, T.DATE_RANGE, 2))).alias("end_date"),
    ]


def experience(segmented: DataFrame) -> DataFrame:
    """(doc, entry_no, title, organization, start_date, end_date, bullets)."""
    grouped = entries(segmented, "experience").groupBy("doc", "entry_no").agg(
        F.first("header").alias("header"), F.array_sort(F.collect_list(F.when(F.col("bullet").isNotNull(), F.struct("bullet_no", "bullet")))).alias("b")
    )
    return grouped.select("doc", "entry_no", *experience_header(), F.col("b.bullet").alias("bullets"))


def education(segmented: DataFrame) -> DataFrame:
    """(doc, pos, degree, field_of_study, institution, graduation_year) of every education line."""
    lines = segmented.where((F.col("section_type") == "education") & ~F.col("is_header"))
    year = T.first_match("text", T.YEAR)
    # only the first year goes
    plain = T.strip(F.regexp_replace(T.strip(F.regexp_replace("text", rf"^(.*?){T.YEAR}", "$1")), r",+$", ""))
    lines = lines.withColumn("_plain", plain)
    rest = F.when(F.col("_plain").rlike(T.DEGREE), F.regexp_extract("_plain", T.DEGREE, 2)).otherwise(F.col("_plain"))
    parts = F.filter(F.transform(F.split(rest, ","), T.strip), lambda p: p != "")
    lines = lines.withColumn("_parts", parts)
    n = F.size("_parts")
    return lines.select(
        "doc",
        "pos",
        T.first_match("_plain", T.DEGREE, 1).alias("degree"),
        F.when(n >= 2, F.try_element_at("_parts", F.lit(1))).alias("field_of_study"),
        F.when(n >= 2, F.array_join(F.slice("_parts", 2, n), ", ")).when(n == 1, F.try_element_at("_parts", F.lit(1))).alias("institution"),
        year.alias("graduation_year"),
    )


def split_list(segmented: DataFrame, section_type: str, unique: bool) -> DataFrame:
    """(doc, item): the tokens of a section between , ; | and /, bullets stripped; unique keeps the first spelling."""
    lines = segmented.where((F.col("section_type") == section_type) & ~F.col("is_header"))
    tokens = lines.select("doc", "pos", F.posexplode(F.split("text", r"[,;|/]")).alias("k", "t")).select("doc", "pos", "k", T.strip_bullet("t").alias("item")).where("item <> ''")
    if not unique:
        return tokens
    return tokens.groupBy("doc", F.lower("item").alias("_key")).agg(F.min_by("item", F.struct("pos", "k")).alias("item"), F.min(F.struct("pos", "k")).alias("_at")).select("doc", F.col("_at.pos").alias("pos"), F.col("_at.k").alias("k"), "item")


def contact(segmented: DataFrame) -> DataFrame:
    """(doc, name, email, phone, location, links): from a leading part without a known header and all contact sections.
    The name is the leading header, else null (no entity recogniser is bundled)."""
    lead = (F.col("seg_no") == F.col("_first")) & F.col("section_type").isin("unlabeled", "other")
    rows = segmented.withColumn("_first", F.min("seg_no").over(Window.partitionBy("doc")))
    chosen = rows.where((lead | (F.col("section_type") == "contact")) & ~F.col("is_header"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), "\n")
    block = chosen.groupBy("doc").agg(text.alias("block"))
    name = rows.where(lead).groupBy("doc").agg(F.max(F.when(F.col("is_header"), F.col("text"))).alias("name"))
    return name.join(block, "doc", "full_outer").select(
        "doc",
        "name",
        T.first_match("block", T.EMAIL).alias("email"),
        T.first_match("block", T.PHONE).alias("phone"),
        T.first_match("block", T.CITY_STATE).alias("location"),
        F.regexp_extract_all("block", F.lit(T.URL), 0).alias("links"),
        "block",
    )


def joined_section(segmented: DataFrame, section_type: str) -> DataFrame:
    """(doc, text): the lines of the first section of a type that has any, joined by blanks."""
    lines = segmented.where((F.col("section_type") == section_type) & ~F.col("is_header"))
    per = lines.groupBy("doc", "seg_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), " ").alias("t"))
    return per.groupBy("doc").agg(F.min_by("t", "seg_no").alias("text"))


def requirements(segmented: DataFrame) -> DataFrame:
    """(doc, idx, text, level) of every line under requirements and preferred headers, in order."""
    lines = segmented.where(F.col("section_type").isin("requirements", "preferred") & ~F.col("is_header")).withColumn("t", T.strip_bullet("text")).where("t <> ''")
    idx = F.row_number().over(Window.partitionBy("doc").orderBy("pos")) - 1
    return lines.select("doc", idx.cast("long").alias("idx"), F.col("t").alias("text"), T.requirement_level("t", "section_type").alias("level"))


def section_items(segmented: DataFrame, section_type: str) -> DataFrame:
    """(doc, idx, text): bullets of a section, stripped, empty ones dropped, numbered from 0."""
    lines = segmented.where((F.col("section_type") == section_type) & ~F.col("is_header")).withColumn("t", T.strip_bullet("text")).where("t <> ''")
    return lines.select("doc", (F.row_number().over(Window.partitionBy("doc").orderBy("pos")) - 1).cast("long").alias("idx"), F.col("t").alias("text"))


def job_title(segmented: DataFrame) -> DataFrame:
    """(doc, title): the leading header, or the first line of a leading part that has no header."""
    first = segmented.withColumn("_first", F.min("seg_no").over(Window.partitionBy("doc"))).where("seg_no = _first and section_type in ('unlabeled', 'other')")
    return first.groupBy("doc").agg(F.min_by("text", "pos").alias("title"))


def scan_names(lines: DataFrame, names: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key, name) for every listed name that occurs as whole words in a line: runs of words, as long as the longest name,
    meet the names in an equi-join, so neither the number of lines nor of names multiplies. While the names number at most
    MAX_BROADCAST_NAMES, which is checked, they are broadcast, and of all runs only hits leave a task. A contained name is found
    too.
    A name with marks that terms lack (CI/CD, .NET) meets the run of its terms and must then stand in the line as it is."""
    plain = lambda c: F.regexp_replace(F.lower(c), r"\s+", " ")
    terms = F.regexp_extract_all(F.lower("name"), F.lit(T.TERM), 0)
    listed = names.select(F.array_join(terms, " ").alias("_g"), "name", F.size(terms).alias("_n")).where("_n > 0").distinct()
    marked = F.col("_g") != plain("name")
    longest, any_marked, many = listed.agg(F.coalesce(F.max("_n"), F.lit(1)), F.coalesce(F.max(marked), F.lit(False)), F.count("*")).first()
    if many <= MAX_BROADCAST_NAMES:
        listed = F.broadcast(listed)
    kept = [plain(text).alias("_line")] if any_marked else []
    grams = lines.select(*key, *kept, F.explode(T.term_ngrams(text, longest)).alias("_g"))
    hits = grams.join(listed, "_g")
    if any_marked:
        hits = hits.where(~marked | F.col("_line").contains(plain("name")))
    return hits.select(*key, "name").distinct()
