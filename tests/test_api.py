from pyspark.sql import functions as F

from loomwork import api
from loomwork.functions.embedders import HashingEmbedder, ModelEmbedder, StubEmbedder, embed
from loomwork.operators import learning as L
from loomwork.operators.store import update_values

DATA = "/root/testdata/sf0.001"


def test_embedders(spark):
    df = spark.createDataFrame([("hello world", 1), ("hello world", 2), ("", 3), (None, 4)], "t string, k int")
    got = {r["k"]: r["v"] for r in embed(df, "t", "v", StubEmbedder()).collect()}
    assert got[1] == got[2] == [11 % 7 + 1.0, 1.0, 0.0, 0.0] and got[3][0] == 1.0 and got[4] is None
    hashed = {r["k"]: r["v"] for r in embed(df, "t", "v", HashingEmbedder(16)).collect()}
    assert len(hashed[1]) == 16 and abs(sum(x * x for x in hashed[1]) - 1) < 1e-9 and hashed[4] is None
    assert {r["k"]: r["v"] for r in embed(df, "t", "v", ModelEmbedder(lambda: lambda ts: [[float(len(t))] for t in ts], 1)).collect()}[1] == [11.0]


def test_services(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Engineer\nRequirements\n- SQL basics")
    (tmp_path / "b.exe").write_text("x")
    lines, rejected = api.ingest(spark, str(tmp_path), "job")
    assert lines.where("section_type = 'requirements'").count() == 2 and rejected.count() == 1
    some = spark.read.parquet(f"{DATA}/matches.parquet").where("resume_id is not null").first()["resume_id"]
    scores = [r["rule_based_score"] for r in api.rank_jobs(spark, DATA, some).collect() if r["rule_based_score"] is not None]
    assert scores == sorted(scores, reverse=True) and scores
    assert api.taxonomy(spark, DATA).count() == 350
    assert api.match(spark, DATA).where("rank = 1").count() > 0


def test_active_weights(spark):
    rows = spark.createDataFrame([(1, True, {"education_match": 0.5}), (2, False, {"education_match": 0.9})], "version int, is_active boolean, weights map<string,double>")
    assert api.active_weights(rows)["education_match"] == 0.5 and api.active_weights(rows.limit(0))["education_match"] == 0.1


def test_update_values(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, v int")
    new = spark.createDataFrame([("a", 9), ("b", None)], "k string, v int")
    assert sorted(map(str, (r["v"] for r in update_values(df, new, "k", "v").collect()))) == ["3", "9", "None"]


def test_model_round_trip(spark, tmp_path):
    df = spark.range(60).select((F.col("id") / 60).alias("x"), (F.col("id") % 2).cast("double").alias("label"), (F.col("id") / 60).alias("score"))
    model = L.forest(["x"], 3, 2).fit(df)
    L.save_model(model, str(tmp_path), {"rows": 60})
    again, about = L.load_model(str(tmp_path))
    assert about == {"rows": 60} and L.predict(again, df).count() == 60
