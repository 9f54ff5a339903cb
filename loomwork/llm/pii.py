"""Problem 5: personal information inside free text, found by a character tagger and replaced by typed placeholders."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import pii_model
from loomwork.llm.common import records
from loomwork.llm.pii_labels import ADDRESS, EMAIL, IDENTITY, PHONE
from loomwork.tables import load

#: How far a finding's ends may be corrected to the exact shape of its type.
_REACH = 40
_SHAPES = {"email": EMAIL, "phone": PHONE, "identity": IDENTITY, "address": ADDRESS}
_TITLE = re.compile(r"^(?:(?:Dr|Mr|Mrs|Ms|Mx|Prof|Herr|Frau|Sir|Mme|Sr|Sra|Dipl|Ing)\.?\s+)+", re.I)
_NOISE = re.compile(r"[\W_]+")


def value_of(found: str) -> str:
    """The found text with everything but letters and digits removed, lower-cased."""
    return _NOISE.sub("", found).lower()


def correct(text: str, start: int, stop: int, kind: str) -> tuple[int, int] | None:
    """The exact bounds of a finding, None if its type can't look like that. Where the shape of the type matches across
    the finding its ends count; otherwise whole words are taken and a few plain conditions must hold."""
    shape = _SHAPES.get(kind)
    if shape:
        low, best = max(0, start - _REACH), None
        for m in shape.finditer(text, low, min(len(text), stop + _REACH)):
            shared = min(stop, m.end()) - max(start, m.start())
            if shared > 0 and (best is None or shared > best[0]):
                best = (shared, m.start(), m.end())
        if best:
            return best[1], best[2]
    while start > 0 and text[start - 1].isalnum() and text[start].isalnum():
        start -= 1
    while stop < len(text) and text[stop - 1].isalnum() and text[stop].isalnum():
        stop += 1
    while start < stop and not (text[start].isalnum() or text[start] in "+("):
        start += 1
    while start < stop and not (text[stop - 1].isalnum() or (text[stop - 1] == "." and kind == "name")):
        stop -= 1
    found = text[start:stop]
    digits, letters = sum(c.isdigit() for c in found), sum(c.isalpha() for c in found)
    if kind == "name":
        titled = _TITLE.match(found)
        if titled:
            start += titled.end()
            found = text[start:stop]
        parts = [p for p in re.split(r"[\s,]+", found) if p]
        ok = len(parts) >= 2 and not digits and all(p[0].isupper() for p in parts) and "\n" not in found
    elif kind == "email":
        ok = "@" in found and letters > 3
    elif kind == "phone":
        ok = 7 <= digits <= 15 and letters == 0
    elif kind == "identity":
        ok = digits >= 5 and len(found) <= 24
    else:
        ok = digits >= 1 and letters >= 6
    return (start, stop) if ok else None


def findings(texts: list[str], model: dict) -> list[list[tuple[int, int, str]]]:
    """(start, stop, type) of each text, corrected, sorted and without overlaps (the longer one stays)."""
    out = []
    for text, spans in zip(texts, pii_model.decode_texts(model, texts), strict=True):
        good = {(*c, kind) for a, b, kind in spans if (c := correct(text, a, b, kind))}
        kept: list[tuple[int, int, str]] = []
        for a, b, kind in sorted(good, key=lambda s: (s[0] - s[1], s[0], s[2])):
            if not any(a < y and x < b for x, y, _ in kept):
                kept.append((a, b, kind))
        out.append(sorted(kept))
    return out


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    for a, b, kind in reversed(spans):
        text = f"{text[:a]}[{kind.upper()}]{text[b:]}"
    return text


def find_personal(rows: DataFrame, item: str, text: str, model: str = pii_model.WEIGHTS) -> DataFrame:
    """(item, redacted, findings: array of (start, stop, type, found)) for every row with a text; null texts are left
    out, empty ones come back unchanged without findings, very long ones are read in windows like any other. Rows with
    the same item count once. Other columns don't matter.

    The tagger reads whole texts in overlapping windows; each task handles bounded batches.
    """
    kind = dict(rows.dtypes)[item]
    weights = rows.sparkSession.sparkContext.broadcast(pii_model.load_model(model))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = weights.value
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                texts = list(part["t"])
                spans = findings(texts, p)
                yield pd.DataFrame(
                    {
                        "item": part["item"],
                        "redacted": [redact(t, s) for t, s in zip(texts, spans, strict=True)],
                        "findings": [[{"start": a, "stop": b, "type": k, "found": t[a:b]} for a, b, k in s] for t, s in zip(texts, spans, strict=True)],
                    }
                )

    schema = f"item {kind}, redacted string, findings array<struct<start: long, stop: long, type: string, found: string>>"
    once = records(rows.select(F.col(item).alias("item"), F.col(text).alias("t")).where("t is not null"), ["item"], ["t"])
    cores = rows.sparkSession.sparkContext.defaultParallelism
    # reading is quick and tagging slow: without this a small table would be tagged by one task
    return once.repartition(4 * cores, "item").mapInPandas(run, schema).withColumnRenamed("item", item)


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal(load(spark, sf_dir, "resumes").select("id", "raw_text"), "id", "raw_text")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _found(spark, sf_dir).select(F.col("id").alias("resume_id"), F.explode("findings").alias("f"))
    value = F.lower(F.regexp_replace("f.found", r"[^\p{L}\p{N}]+", ""))
    return rows.select("resume_id", F.col("f.type").alias("pii_type"), value.alias("pii_value")).distinct()


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).select(F.col("id").alias("resume_id"), F.col("redacted").alias("redacted_text"), F.size("findings").cast("long").alias("replaced"))


QUERIES = {"p5_found": p5_found, "p5_redacted": p5_redacted}
ORACLE: dict[str, str] = {}
