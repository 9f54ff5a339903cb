import io
import zipfile

import pytest
from pyspark.sql import functions as F

from loomwork.sources import feeds, files

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(body: str, extra: dict | None = None) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
        z.writestr("word/styles.xml", f'<w:styles xmlns:w="{W}"><w:style w:styleId="H1"><w:name w:val="heading 1"/><w:rPr><w:sz w:val="32"/><w:b/></w:rPr></w:style></w:styles>')
        for name, text in (extra or {}).items():
            z.writestr(name, text)
    return out.getvalue()


PAR = '<w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:t>Sam Rivera</w:t></w:r></w:p><w:p><w:r><w:rPr><w:sz w:val="20"/></w:rPr><w:t> body </w:t></w:r></w:p><w:p/>'


def test_docx():
    assert files.parse_docx(docx(PAR)) == [("Sam Rivera", 16.0, True, "heading 1"), ("body", 10.0, False, None)]


def test_docx_refuses_entities_and_damage():
    with pytest.raises(files.ParseError, match="refused"):
        files.parse_docx(docx(PAR, {"word/x.xml": '<!DOCTYPE a [<!ENTITY b "c">]><a/>'}))
    with pytest.raises(files.ParseError, match="damaged"):
        files.parse_docx(b"PK\x03\x04 no archive")


def test_dispatch():
    assert files.parse_any("a.txt", b" x \n\n y\r\n")[2] == [("x", None, False, None), ("y", None, False, None)]
    assert files.parse_any("a.exe", b"")[1].startswith("unsupported")
    assert files.parse_any("a.pdf", b"hello")[1] == "content does not match the type"
    assert files.parse_any("a.txt", b"  \n ")[1] == "no text"


def test_slow_parser_times_out():
    import time

    assert files.parse_any("a.txt", b"x", {"txt": lambda c: time.sleep(1) or []}, 0.05)[1] == "timed out"


def test_read_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\ntwo")
    (tmp_path / "b.docx").write_bytes(docx(PAR))
    (tmp_path / "c.txt").write_bytes(b"x" * 5000)
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.read_documents(spark, str(tmp_path), most=4000).collect()}
    assert got["c.txt"]["error"] == "too large" and [x["text"] for x in got["b.docx"]["lines"]] == ["Sam Rivera", "body"]
    lines = files.document_lines(files.read_documents(spark, str(tmp_path), most=4000))
    assert lines.columns == ["doc", "pos", "text", "font_size", "bold", "style_name"] and lines.count() == 4


def test_feeds(spark, tmp_path):
    p = tmp_path / "pairs.csv"
    p.write_text('resume_text,job_description_text,label\n"a ""quoted""\nline",job,Good Fit\nb,job,No Fit\n')
    rows = feeds.labelled_pairs(spark, str(p)).collect()
    assert [r["label"] for r in rows] == [1.0, 0.0] and rows[0]["resume_text"] == 'a "quoted"\nline' and rows[0]["job_ref"] == rows[1]["job_ref"]
    t = tmp_path / "tech.csv"
    t.write_text("Code,Title,Workplace Example,Element ID,Element Name,Hot Technology,In Demand\n1,x,Foo software,1,Data base,Y,N\n1,x,Foo,1,Other,Y,N\n1,x,Bar,1,Other,N,N\n1,x,Vendor Baz,2,Web Tools,Y,N\n")
    assert [tuple(r) for r in feeds.hot_technologies(spark, str(t), {"vendor baz": "Baz"}).collect()] == [("Baz", "feed:web_tools"), ("Foo", "feed:data_base")]
    o = tmp_path / "occ.csv"
    o.write_text("code,title\n15-1252.00,Developers\n")
    assert feeds.occupations(spark, str(o)).first()["major_group"] == "15"
    j = tmp_path / "p.json"
    j.write_text('{"r1": {"contact": {"name": "A B", "links": []}, "summary": null,\n "skills": ["SQL"]}}')
    got = feeds.profiles(spark, str(j)).first()
    assert got["ref"] == "r1" and got["profile"]["skills"] == ["SQL"] and got["profile"]["contact"]["name"] == "A B"


def test_profiles_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("r1", (("A B", None, None, None, []), None, ["SQL"]))], f"ref string, profile {feeds.PROFILE}")
    feeds.write_profiles(rows, str(tmp_path / "p"))
    assert feeds.profiles(spark, str(tmp_path / "p"), lines=True).collect() == rows.collect()


def test_first_category_ignores_the_order_of_lines(spark, tmp_path):
    head = "Code,Title,Workplace Example,Element ID,Element Name,Hot Technology,In Demand\n"
    lines = ["2,x,Foo,9,Late,Y,N", "1,x,Foo,5,Early,Y,N", "1,x,Foo,7,Later,Y,N"]
    for k, order in enumerate((lines, lines[::-1])):
        (tmp_path / f"t{k}.csv").write_text(head + "\n".join(order) + "\n")
        assert [tuple(r) for r in feeds.hot_technologies(spark, str(tmp_path / f"t{k}.csv")).collect()] == [("Foo", "feed:early")]


def test_cache_follows_fingerprint(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(len(built))

    where = str(tmp_path / "c")
    assert [feeds.cached(spark, build, where, f).count() for f in ("a", "a", "b")] == [1, 1, 2]


def test_stream_appends_once(spark, tmp_path):
    from loomwork.streaming.ingest import append_absent, stream_table

    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    for k in (0, 1):
        spark.createDataFrame([("a", k), (f"b{k}", k)], "k string, i int").write.mode("append").parquet(src)
        append_absent(stream_table(spark, src, spark.read.parquet(src).schema), out, ["k"], "i", str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(r["k"] for r in spark.read.parquet(out).collect()) == ["a", "b0", "b1"]


def test_stream_windows(spark, tmp_path):
    from loomwork.streaming.windows import tumbling

    src = str(tmp_path / "ev")
    spark.sql("select timestamp_ntz'2024-01-01 00:10:00' ts, 'x' event_type, 1.0D value union all select timestamp_ntz'2024-01-01 05:00:00', 'x', 2.0D").write.parquet(src)
    rows = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    q = tumbling(rows, "1 hour", "10 minutes").writeStream.format("memory").queryName("tumbled").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("tumbled").select(F.col("n")).collect()[0][0] == 1


def test_tables_go_with_their_scope(spark, tmp_path):
    import os

    from loomwork.session import materialize, temporary_tables

    path = lambda df: df._loomwork_path.removeprefix("file://")
    with temporary_tables(spark):
        outer = materialize(spark.range(3))
        with temporary_tables(spark):
            inner = materialize(outer)
            assert inner.count() == 3
        assert not os.path.exists(path(inner)) and outer.count() == 3
    assert not os.path.exists(path(outer))
