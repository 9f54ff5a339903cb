"""Delimited and JSON feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import text as T
from loomwork.operators.datasets import fit_label

PROFILE = "struct<contact: struct<name: string, email: string, phone: string, location: string, links: array<string>>, summary: string, skills: array<string>>"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, quoted line breaks and doubled quotes."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


def labelled_pairs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(resume_ref, job_ref, resume_text, job_text, label) of files with the columns resume_text, job_description_text and
    label; equal texts share a ref, an unknown label is an error."""
    rows = read_csv(spark, path, "resume_text string, job_description_text string, label string")
    return rows.select(
        T.text_id("resume_text").alias("resume_ref"), T.text_id("job_description_text").alias("job_ref"), "resume_text", F.col("job_description_text").alias("job_text"), fit_label("label").alias("label")
    )


def hot_technologies(spark: SparkSession, path: str, rename: dict[str, str] | None = None, source: str = "feed") -> DataFrame:
    """(name, category) of the rows flagged Y: cleaned names, sorted. A name with several categories keeps that of its smallest
    occupation code, then of its smallest element id, whatever order and partitions the file is read in."""
    schema = "code string, title string, example string, element_id string, element string, hot string, in_demand string"
    rows = read_csv(spark, path, schema).where("hot = 'Y'")
    place = F.struct("code", "element_id", "element")
    named = rows.select(T.clean_name("example", rename).alias("name"), T.category_key("element", source).alias("category"), place.alias("_o"))
    return named.groupBy("name").agg(F.min_by("category", "_o").alias("category")).orderBy("name")


def occupations(spark: SparkSession, path: str) -> DataFrame:
    """(code, title, major_group)."""
    return read_csv(spark, path, "code string, title string").select("code", "title", F.split_part("code", F.lit("-"), F.lit(1)).alias("major_group"))


def write_profiles(rows: DataFrame, path: str) -> None:
    """Writes rows(ref, profile) as JSON, one profile a line, by all tasks at once; null fields are written, too."""
    rows.select("ref", "profile").write.option("ignoreNullFields", "false").mode("overwrite").json(path)


def profiles(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(ref, profile) of profiles as write_profiles leaves them (lines), which are read in splits, or of a small JSON file that
    maps refs to profiles, which is one task's work."""
    if lines:
        return spark.read.schema(f"ref string, profile {PROFILE}").json(path)
    raw = spark.read.text(path, wholetext=True)
    table = F.from_json("value", f"map<string, {PROFILE}>")
    return raw.select(F.explode(table).alias("ref", "profile"))


def cached(spark: SparkSession, build, path: str, fingerprint: str) -> DataFrame:
    """The table at path/fingerprint, built once for each fingerprint of its inputs, so a changed input is never
    answered from an old file."""
    where = f"{path.rstrip('/')}/{fingerprint}"
    try:
        return spark.read.parquet(where)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
    build().write.mode("errorifexists").parquet(where)
    return spark.read.parquet(where)
