"""The engine's services as functions from tables to DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import text as T
from loomwork.operators import documents as D
from loomwork.operators import evidence as E
from loomwork.operators import features as X
from loomwork.plans import matching as P
from loomwork.sources import files
from loomwork.tables import load


def ingest(spark: SparkSession, folder: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """(segmented lines, rejected files) of a folder of resumes or job descriptions."""
    documents = files.read_documents(spark, folder)
    aliases = {"resume": T.RESUME_ALIASES, "job": T.JOB_ALIASES}[kind]
    return D.segments(files.document_lines(documents), aliases), documents.where("error is not null").select("path", "kind", "error")


def active_weights(weights: DataFrame) -> dict[str, float]:
    """The weights of the newest active row of weights(version, is_active, weights map), else the defaults."""
    row = weights.where("is_active").orderBy(F.desc("version")).limit(1).collect()
    return X.WEIGHTS | (dict(row[0]["weights"]) if row else {})


def match(spark: SparkSession, tables: str, weights: dict[str, float] | None = None) -> DataFrame:
    """Features, score out of 100 and rank of every labelled pair, from the texts."""
    rows = P.feature_vectors(spark, tables).withColumn("score", F.round(X.rule_score(weights) * 100, 2))
    return X.rank_within(rows, "cand", "score", "job")


def rank_jobs(spark: SparkSession, tables: str, candidate: str) -> DataFrame:
    """Stored matches of one candidate, best first; the key filter reaches the scan."""
    m = load(spark, tables, "matches").where(F.col("resume_id") == candidate).select("id", "job_id", "rule_based_score").distinct()
    return m.orderBy(F.desc_nulls_last("rule_based_score"), "id")


def taxonomy(spark: SparkSession, tables: str) -> DataFrame:
    return P.join_taxonomy_browse(spark, tables).orderBy("canonical_name")


def validate(claims: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(claims with what became of them, whether each document's claims all stood)."""
    checked = E.validate(claims, paths)
    return checked, E.check_passed(checked)
