import datetime as dt

import pytest
from pyspark.sql import functions as F

from loomwork.functions import dates, similarity, vectors
from loomwork.functions import text as T


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v")).alias("o")).collect()]


def test_normalize_header(spark):
    got = column(spark, ["  Skills & Tools: ", "WHAT YOU'LL DO", None, ""], T.normalize_header)
    assert got == ["skills and tools", "what you ll do", None, ""]


def test_alias_type(spark):
    got = column(spark, ["Technical Skills", "Why hire me", None], lambda c: T.alias_type(c, T.RESUME_ALIASES))
    assert got == ["skills", None, None]


def test_header_predicate(spark):
    assert column(spark, ["WHY HIRE ME", "Why hire me", "ONE TWO THREE FOUR FIVE SIX", "123"], T.looks_like_header) == [True, False, False, False]


def test_normalize_term(spark):
    got = column(spark, ["  Python 3.11 ", "Angular v2+", "node.js", "C++", "Java 8", "", None], T.normalize_term)
    assert got == ["python", "angular", "node.js", "c++", "java", "", None]


def test_requirement_level(spark):
    df = spark.createDataFrame([("Must have SQL", "preferred"), ("SQL is a plus", "requirements"), ("SQL", "preferred"), ("SQL", "requirements")], "t string, s string")
    assert [r[0] for r in df.select(T.requirement_level("t", "s")).collect()] == ["required", "preferred", "preferred", "required"]


def test_seniority(spark):
    got = column(spark, ["Staff Engineer", "Senior Staffing Lead", "Sr. Analyst", "Sales Associate", "Mid-level Dev", "Engineer", None, ""], T.seniority)
    assert got == ["staff", "staff", "senior", "junior", "mid", "unspecified", "unspecified", "unspecified"]


def test_degree_rank(spark):
    assert column(spark, ["Ph.D. in physics", "MBA", "MS Office", "B.S. Computing", "Associate's", "none", None], T.degree_rank) == [4, 3, 3, 2, 1, None, None]


def test_unglue(spark):
    assert column(spark, ["SummaryHighly motivated", "Technical SkillsPython", "Summary of", None], T.unglue_headers) == ["Summary\nHighly motivated", "Technical Skills\nPython", "Summary of", None]


def test_numbers(spark):
    df = spark.createDataFrame([("cut 60% in 3.5 years", "60 percent over 3.5 years"), ("cut 40%", "60 percent"), ("none", "")], "a string, b string")
    assert [r[0] for r in df.select(T.numbers_within("a", "b")).collect()] == [True, False, True]


def test_file_type_and_magic(spark):
    assert column(spark, ["a.PDF", "b.tar.docx", "c.txt", "d.exe", "noext", None], T.file_type) == ["pdf", "docx", "txt", None, None, None]
    df = spark.createDataFrame([("pdf", b"%PDF-1"), ("pdf", b"PK\x03\x04"), ("docx", b"PK\x03\x04x"), ("txt", b"x")], "k string, c binary")
    assert [r[0] for r in df.select(T.magic_ok(F.col("k"), F.col("c"))).collect()] == [True, False, True, True]


def test_term_ngrams(spark):
    got = column(spark, ["Spring Boot, C++ and node.js!", ""], lambda c: T.term_ngrams(c, 2))
    assert {"spring boot", "spring", "c++", "node.js"} <= set(got[0])


@pytest.mark.parametrize(
    ("text", "want"),
    [("Jun 2021", dt.date(2021, 6, 1)), ("June 2021", dt.date(2021, 6, 1)), ("2021", dt.date(2021, 1, 1)), ("Present", dt.date(2026, 1, 1)), ("current", dt.date(2026, 1, 1)), ("gibberish", None), ("", None), (None, None), ("Foo 2021", None)],
)
def test_resume_dates(spark, text, want):
    assert column(spark, [text], lambda c: dates.parse_resume_date(c, "2026-01-01")) == [want]


def test_span_counts_overlap_once(spark):
    df = spark.createDataFrame([("a", "Jan 2019", "Jan 2022"), ("a", "Jan 2020", "Present"), ("b", None, "x")], "k string, s string, e string")
    got = dict(df.groupBy("k").agg(F.round(dates.span_years(dates.parse_resume_date("s", "2026-01-01"), dates.parse_resume_date("e", "2026-01-01")), 2)).collect())
    assert got == {"a": 7.0, "b": 0.0}


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0, 1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(F.round(vectors.cosine("a", "b"), 6)).collect()] == [1.0, 0.0, 0.0, None]
    assert [r[0] for r in df.select(vectors.unit("a")).collect()][0] == pytest.approx([0.6, 0.8])
    assert [r[0] for r in df.select(vectors.unit("a")).collect()][2:] == [None, None]


def test_sequence_ratio_depends_on_order(spark):
    df = spark.createDataFrame([("pyhton", "python"), ("tide", "diet"), ("diet", "tide"), (None, "a")], "a string, b string")
    got = [r[0] for r in df.select(similarity.sequence_ratio(F.col("a"), F.col("b"))).collect()]
    assert got[:3] == pytest.approx([0.8333, 0.25, 0.5], abs=1e-3) and got[3] is None


def test_token_jaccard(spark):
    df = spark.createDataFrame([("react native", "react"), ("a b", "b a"), ("", "a")], "a string, b string")
    assert [r[0] for r in df.select(similarity.token_jaccard("a", "b")).collect()] == [0.5, 1.0, 0.0]


def test_redaction_at_any_depth(spark):
    from loomwork.functions.redaction import MASK, MaskingFilter, mask, redacted

    schema = "id int, raw_text string, p struct<text: string, n: int, l: array<struct<Text: string, k: int>>>, m map<string, string>, a array<string>"
    df = spark.createDataFrame([(1, "body", ("t", 2, [("x", 3), (None, 4)]), {"text": "t", "k": "v"}, ["s"]), (2, None, None, None, None)], schema)
    got = [r.asDict(True) for r in redacted(df).orderBy("id").collect()]
    assert got[0] == {"id": 1, "raw_text": MASK, "p": {"text": MASK, "n": 2, "l": [{"Text": MASK, "k": 3}, {"Text": None, "k": 4}]}, "m": {"text": MASK, "k": "v"}, "a": ["s"]}
    assert got[1] == {"id": 2, "raw_text": None, "p": None, "m": None, "a": None}
    assert mask({"a": [{"raw_text": "x", "b": ({"text": "y"},)}]}) == {"a": [{"raw_text": MASK, "b": ({"text": MASK},)}]}
    import logging

    record = logging.LogRecord("x", 20, "f", 1, {"raw_text": "x"}, None, None)
    assert MaskingFilter().filter(record) and record.msg == {"raw_text": MASK}


def test_strict_schema_and_failures(spark):
    from loomwork.functions import structured as S

    schema = {"type": "object", "properties": {"a": {"type": "string"}, "b": {"$ref": "#/$defs/B"}}, "required": ["a"], "$defs": {"B": {"properties": {"c": {"type": "array", "items": {"type": "object"}}}, "additionalProperties": True}}}
    strict = S.strict_schema(schema)
    assert strict["required"] == ["a", "b"] and strict["additionalProperties"] is False and schema["required"] == ["a"]
    assert strict["$defs"]["B"] == {"properties": {"c": {"type": "array", "items": {"type": "object", "additionalProperties": False}}}, "additionalProperties": True, "required": ["c"]}

    class Model:
        name = "echo"

        def generate(self, prompt, schema):
            if prompt == "bad":
                raise ValueError("no answer")
            return {"said": prompt, "keys": sorted(schema["properties"])}

    df = spark.createDataFrame([(1, "hi"), (2, "bad"), (3, None), (4, "")], "k int, prompt string")
    rows = S.generate(df, "k", "prompt", Model, schema)
    got = {r["k"]: (r["answer"], r["error"]) for r in rows.collect()}
    assert got[1] == ('{"said": "hi", "keys": ["a", "b"]}', None) and got[2] == (None, "ValueError: no answer") and got[3][1] == "no text" and got[4][1] is None
    assert {r["error"]: r["rows"] for r in S.failures(rows).collect()} == {None: 2, "ValueError": 1, "no text": 1}
