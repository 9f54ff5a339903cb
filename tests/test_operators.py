import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.functions import text as T
from loomwork.operators import datasets as B
from loomwork.operators import documents as D
from loomwork.operators import evidence as E
from loomwork.operators import features as X
from loomwork.operators import learning
from loomwork.operators import metrics as M
from loomwork.operators import skills as K
from loomwork.operators import store as R
from loomwork.operators import trees
from loomwork.operators.graph import components

JOB = """Staff Platform Engineer
About Us
We are a fintech startup.
Requirements
- 5+ years with Kubernetes and Docker
- Strong SQL, a plus for Spark
Nice to Have
- Must have Terraform
- Rust
Responsibilities
- Mentor junior engineers
-
Benefits
Lunch"""


def lines(spark, text, doc="d"):
    return D.text_lines(spark.createDataFrame([(doc, text)], "id string, t string"), "id", "t")


def test_job_profile(spark):
    seg = D.segments(lines(spark, JOB), T.JOB_ALIASES)
    req = [tuple(r) for r in D.requirements(seg).orderBy("idx").select("text", "level").collect()]
    assert req == [("5+ years with Kubernetes and Docker", "required"), ("Strong SQL, a plus for Spark", "preferred"), ("Must have Terraform", "required"), ("Rust", "preferred")]
    assert D.job_title(seg).first()["title"] == "Staff Platform Engineer"
    assert D.joined_section(seg, "about").first()["text"] == "We are a fintech startup."
    assert [r["text"] for r in D.section_items(seg, "responsibilities").collect()] == ["Mentor junior engineers"]
    names = spark.createDataFrame([("Kubernetes",), ("Docker",), ("SQL",), ("Spark",), ("Rust",), ("C++",)], "name string")
    found = D.scan_names(D.requirements(seg), names, ["doc", "idx"])
    assert {(r["idx"], r["name"]) for r in found.collect()} == {(0, "Kubernetes"), (0, "Docker"), (1, "SQL"), (1, "Spark"), (3, "Rust")}


def test_no_line_is_lost(spark):
    seg = D.segments(lines(spark, JOB), T.JOB_ALIASES)
    assert seg.count() == lines(spark, JOB).count() == 14 - 0
    table = D.section_table(seg)
    assert table.agg(F.sum("n_lines")).first()[0] + table.where("raw_header is not null").count() == seg.count()


def test_layout_headers(spark):
    rows = [("d", 0, "Jordan Ellis", 20.0, True, None), ("d", 1, "x@example.com", 10.0, False, None), ("d", 2, "Why hire me", 13.0, False, None), ("d", 3, "body", 10.0, False, "List Bullet"), ("d", 4, "Intro", 10.0, False, "Heading 1")]
    seg = D.segments(spark.createDataFrame(rows, "doc string, pos int, text string, font_size double, bold boolean, style_name string"), T.RESUME_ALIASES)
    assert [r["is_header"] for r in seg.orderBy("pos").collect()] == [True, False, True, False, True]
    assert D.contact(seg).first()["name"] == "Jordan Ellis"
    assert D.contact(seg).first()["email"] == "x@example.com"


def test_entries_span_fragments(spark):
    text = "Experience\n- lost\nA, Acme -- Jan 2020 to Present\n- one\nWork history\n- two\nBee"
    seg = D.segments(lines(spark, text), T.RESUME_ALIASES)
    got = [(r["title"], r["organization"], r["start_date"], r["end_date"], r["bullets"]) for r in D.experience(seg).orderBy("entry_no").collect()]
    assert got == [("A", "Acme", "Jan 2020", "Present", ["one", "two"]), ("Bee", None, None, None, [])]


def test_education(spark):
    seg = D.segments(lines(spark, "Education\nB.S. Computing, Hill College, Zarnice, 2019\nCourse, 2010\nSchool"), T.RESUME_ALIASES)
    got = [tuple(r)[2:] for r in D.education(seg).orderBy("pos").collect()]
    assert got == [("B.S.", "Computing", "Hill College, Zarnice", "2019"), (None, None, "Course", "2010"), (None, None, "School", None)]


def test_education_keeps_all_parts(spark):
    places = [f"Place {i}" for i in range(150)]
    seg = D.segments(lines(spark, "Education\nB.S. Computing, " + ", ".join(places)), T.RESUME_ALIASES)
    assert D.education(seg).first()["institution"] == ", ".join(places)


def test_skill_list_keeps_first_spelling(spark):
    seg = D.segments(lines(spark, "Skills\nPython, SQL | python\n- CI/CD; sql"), T.RESUME_ALIASES)
    assert {r["item"] for r in D.split_list(seg, "skills", True).collect()} == {"Python", "SQL", "CI", "CD"}


@pytest.fixture(scope="module")
def taxonomy(spark):
    skills = spark.createDataFrame([(1, "Java"), (2, "JavaScript"), (3, "React"), (4, "React Native"), (5, "Angular"), (6, "AngularJS"), (7, "Python"), (8, "Kubernetes"), (9, "Docker")], "id int, name string")
    aliases = spark.createDataFrame([(8, "k8s"), (2, "JS"), (6, "Angular 1")], "skill_id int, alias string")
    partners = spark.createDataFrame([("Java", "JavaScript"), ("React", "React Native"), ("Angular", "AngularJS")], "skill_a string, skill_b string")
    return K.taxonomy_terms(skills, aliases), partners


@pytest.mark.parametrize(
    ("raw", "want"),
    [("k8s", "Kubernetes"), ("Pyhton", "Python"), ("Kuberentes", "Kubernetes"), ("Dcoker", "Docker"), ("java 17", "Java"), ("Angular 1", "Angular"), ("angularj", None), ("unknown thing", None), ("", None)],
)
def test_skill_cascade(spark, taxonomy, raw, want):
    got = K.normalize_skills(spark.createDataFrame([(raw,)], "raw_text string"), *taxonomy).first()
    assert got["canonical_name"] == want


def test_knn_paths_agree(spark):
    q = spark.createDataFrame([("q", [1.0, 0.0]), ("z", [0.0, 0.0]), ("n", None)], "query string, vec array<double>")
    b = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("c", [0.0, 1.0]), ("d", [1.0, 0.0, 0.0])], "item string, vec array<double>")
    for most in (100, 1):
        got = [(r["query"], r["item"], r["rank"]) for r in K.knn(q, b, 2, 0.4, most).orderBy("rank").collect()]
        assert got == [("q", "a", 1), ("q", "b", 2)]


def test_knn_in_blocks_equals_broadcast(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    make = lambda n, c: spark.createDataFrame([(f"{c}{i:03d}", rng.standard_normal(6 if i % 7 else 4).round(1).tolist()) for i in range(n)], f"{'query' if c == 'q' else 'item'} string, vec array<double>")
    q, b = make(90, "q"), make(130, "b")
    a, c = ([(r["query"], r["item"], r["rank"], round(r["similarity"], 9)) for r in K.knn(q, b, 4, 0.1, most).orderBy("query", "rank").collect()] for most in (1000, 20))
    assert a == c and len(a) > 300
    assert K.knn(q.limit(0), b, 2, 0.1, 20).count() == 0 and K.infer_occupation(q, b, 0.99).count() < 90


def test_fuzzy_candidates_lose_none(spark):
    import random
    from difflib import SequenceMatcher

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 16)))
    left, right = sorted({word() for _ in range(70)} | {"ab ab", "abcabcabcabc"}), sorted({word() for _ in range(90)} | {"axbxcxdx", "abcd"})
    for t in (0.6, 0.7, 0.8):
        got = K.fuzzy_candidates(spark.createDataFrame([(x, x) for x in left], "raw_text string, norm string"), spark.createDataFrame([(x, x) for x in right], "term string, canonical string"), t)
        want = {(a, b) for a in left for b in right if SequenceMatcher(None, a, b).ratio() >= t}
        assert want - {(r["norm"], r["term"]) for r in got.collect()} == set()


def test_blocklist_by_tokens_and_sequence(spark):
    terms = spark.createDataFrame([("react native", "React Native"), ("react", "React")], "term string, canonical string")
    partners = spark.createDataFrame([("React", "React Native")], "skill_a string, skill_b string")
    said = spark.createDataFrame([("reactnative", "React"), ("native react", "React"), ("reac", "React")], "raw_text string, canonical string")
    assert {r["raw_text"] for r in K.drop_blocked(said, terms, partners).collect()} == {"reac"}
    assert {r["raw_text"] for r in K.drop_blocked(said, terms, partners, sequence=False).collect()} == {"reac", "reactnative"}


def test_coverage_and_breakdown(spark):
    pairs = spark.createDataFrame([("c", "j"), ("c", "none")], "cand string, job string")
    have = spark.createDataFrame([("c", "SQL")], "cand string, skill string")
    want = spark.createDataFrame([("j", "SQL", "required", 1), ("j", "Python", "required", 1), ("j", "SQL", "preferred", 1)], "job string, skill string, level string, w int")
    got = {r["job"]: tuple(r)[2:] for r in X.coverage(pairs, have, want).collect()}
    assert got["j"] == pytest.approx((0.5, 1.0, 3 / 5)) and got["none"] == (0.7, 0.7, 0.7)
    b = {r["job"]: r for r in X.skill_breakdown(pairs, have, want).collect()}
    assert b["j"]["missing_required"] == ["Python"] and b["j"]["matched_preferred"] == ["SQL"] and b["none"]["matched_required"] == []


def test_rule_score(spark):
    values = {f: 0.0 for f in X.FEATURES} | {"required_skill_coverage": 1.0, "seniority_match": 1.0, "years_experience_match": 1.4, "domain_similarity": 0.9}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{f} double" for f in values))
    assert df.select(X.rule_score()).first()[0] == pytest.approx(0.35 + 0.1 * 1.2)
    assert sum(X.WEIGHTS.values()) == pytest.approx(1.0)


def test_max_pool(spark):
    pairs = spark.createDataFrame([("c", "j"), ("x", "j")], "cand string, job string")
    asked = spark.createDataFrame([("j", [1.0, 0.0]), ("j", [0.0, 1.0])], "job string, vec array<double>")
    told = spark.createDataFrame([("c", [1.0, 0.0]), ("c", [1.0, 1.0])], "cand string, vec array<double>")
    got = {r["cand"]: r["similarity"] for r in X.max_pool_mean(pairs, asked, told).collect()}
    assert got["c"] == pytest.approx((1 + 2**-0.5) / 2) and got["x"] == 0.0


def test_ranking_metrics(spark):
    rows = [("a", 1.0, 0.9, 1), ("a", 0.0, 0.1, 2), ("b", 0.0, 0.9, 3), ("b", 1.0, 0.1, 4), ("single", 1.0, 0.5, 5), ("none", 0.0, 0.5, 6), ("none", 0.0, 0.5, 7)]
    df = spark.createDataFrame(rows, "q string, rel double, s double, i int")
    n = {r["q"]: r["ndcg"] for r in M.ndcg(df, ["q"], "rel", "s", "i").collect()}
    assert n["a"] == 1.0 and n["b"] < 1 and n["none"] == 0.0 and "single" not in n
    m = {r["q"]: r["rr"] for r in M.mrr(df, ["q"], "rel", "s", "i").collect()}
    assert m == {"a": 1.0, "b": 0.5, "none": 0.0}
    one = df.withColumn("g", F.lit(1))
    assert M.roc_auc(one.where("q = 'a'"), ["g"], "rel", "s").first()["auc"] == 1.0
    assert M.roc_auc(one.where("q = 'none'"), ["g"], "rel", "s").first()["auc"] is None


def test_tied_scores_share_gain(spark):
    df = spark.createDataFrame([("a", 1.0, 0.5, 1), ("a", 0.0, 0.5, 2)], "q string, rel double, s double, i int")
    assert M.ndcg(df, ["q"], "rel", "s", "i").first()["ndcg"] == pytest.approx((1 + 1 / 1.5849625) / 2, abs=1e-6)


def test_grade_and_minmax(spark):
    df = spark.createDataFrame([(0.125,), (0.375,), (1.2,), (-1.0,)], "v double")
    assert [r[0] for r in df.select(M.grade(F.col("v"))).collect()] == [0, 2, 4, 0]
    assert {r[1] for r in M.min_max(spark.createDataFrame([(3.0,), (3.0,)], "v double"), "v", []).collect()} == {0.5}
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", 2.0), (None, 5.0), (None, 7.0), ("b", 4.0)], "g string, scaled double")
    assert sorted((str(r["g"]), r["out"]) for r in M.min_max(rows, "scaled", ["g"], "out").collect()) == [("None", 0.0), ("None", 1.0), ("a", 0.0), ("a", 0.5), ("a", 1.0), ("b", 0.5)]


def test_grouped_split_shares(spark):
    rows = spark.range(300).select(F.col("id").cast("string").alias("k"))
    got = dict(B.grouped_split(rows, "k").groupBy("split").count().collect())
    assert got == {"train": 210, "val": 45, "test": 45}
    assert B.grouped_split(rows.limit(0), "k").count() == 0


def test_components_chain_and_hot_node(spark):
    n = 60
    chain = [(f"a{i:03d}", f"x{i}") for i in range(n)] + [(f"a{i + 1:03d}", f"x{i}") for i in range(n)]
    hot = [(f"h{i:04d}", "hub") for i in range(2000)]
    rows = [*chain, *chain, *hot, ("z", None), (None, "x0")]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(rows, "l string, r string"), "l", "r").collect()}
    assert len(got) == n + 1 + 2000 and {got[f"a{i:03d}"] for i in range(n + 1)} == {"a000"} and {got[h] for h, _ in hot} == {"h0000"}
    assert components(spark.createDataFrame([], "l string, r string"), "l", "r").count() == 0


def test_leaks(spark):
    df = spark.createDataFrame([("a", "train"), ("a", "test"), ("b", "train"), (None, "val"), ("b", None)], "r string, split string")
    assert [tuple(r) for r in B.leaked(df, "r").collect()] == [("a", 2)]
    with pytest.raises(Exception, match="more than one split"):
        B.assert_no_leak(df, "r").collect()
    assert B.assert_no_leak(df.where("r = 'b'"), "r").count() == 2


def test_labels(spark):
    df = spark.createDataFrame([("Good Fit",), ("No Fit",)], "l string")
    assert [r[0] for r in df.select(B.fit_label("l")).collect()] == [1.0, 0.0]
    with pytest.raises(Exception, match="unknown label"):
        spark.createDataFrame([("Bad",)], "l string").select(B.fit_label("l")).collect()


def test_evidence(spark):
    skills = spark.createDataFrame([("d", 0, "SQL 2019")], "doc string, idx int, text string")
    summary = spark.createDataFrame([("d", "ten years")], "doc string, text string")
    paths = E.path_table({"skills[#]": skills, "summary": summary})
    claims = [("d", "ok", "uses SQL", "skills[0]", False), ("d", "number", "40 SQL", "skills[0]", False), ("d", "end", "x", "skills[7]", False), ("d", "form", "x", "__class__", False), ("d", "no", "x", None, False), ("d", "inf", "99", None, True)]
    got = {r["claim_id"]: r["drop_reason"] for r in E.validate(spark.createDataFrame(claims, "doc string, claim_id string, text string, ref string, is_inference boolean"), paths).collect()}
    assert got == {"ok": None, "number": "fabricated number", "end": "does not resolve", "form": "unknown form", "no": "no reference", "inf": None}


def test_store(spark):
    old = spark.createDataFrame([("a", 1)], "k string, i int")
    new = spark.createDataFrame([("a", 2), ("b", 4), ("b", 3)], "k string, i int")
    assert [tuple(r) for r in R.insert_absent(old, new, ["k"], "i").select("k", "i").collect()] == [("b", 3)]
    assert sorted(tuple(r) for r in R.replace(old, new.where("k = 'a'"), ["k"]).collect()) == [("a", 2)]
    left = R.delete_cascade(old.union(new), old, "k", {"child": (new, "k")})
    assert left["parent"].count() == 2 and left["child"].count() == 2
    assert sorted(str(r["k"]) for r in R.nullify(new, "k", old, "k").collect()) == ["None", "b", "b"]
    long = R.flatten_metrics(spark.createDataFrame([("m", 0.5, None)], "n string, a double, b double"), ["n"], ["a", "b"])
    assert [tuple(r) for r in long.collect()] == [("m", "a", 0.5)]


@pytest.mark.parametrize("rows_of_a_window", [10**6, 100])
def test_rank_of_a_hot_group(spark, monkeypatch, rows_of_a_window):
    monkeypatch.setattr(X, "WINDOW_ROWS", rows_of_a_window)
    rows = [("hot", i % 7, f"t{i:05d}") for i in range(3000)] + [("g", None, "a"), ("g", 1, "b"), (None, 1, "c")]
    df = spark.createDataFrame(rows, "g string, s int, t string")
    got = {r["t"]: r["rank"] for r in X.rank_within(df, "g", "s", "t").collect()}
    want = {t: k for k, (_, t) in enumerate(sorted((-s, t) for g, s, t in rows if g == "hot"), 1)}
    assert got == want | {"b": 1, "a": 2, "c": 1}


def test_ranker_pairs_all_scores_of_a_tied_group(spark):
    """Fifty rows a score: the neighbours of a row are nearly all tied, yet every row takes part, good against bad too."""
    rows = [("hot", f"{s}-{i:02d}", s / 4, s / 4, float(i)) for s in range(4) for i in range(50)] + [("tied", f"t{i}", 0.5, 1.0, 1.0) for i in range(3)]
    df = spark.createDataFrame(rows, "g string, id string, score double, x double, y double")
    pairs = learning.score_pairs(df, "g", ["x", "y"]).collect()
    assert len(pairs) == 6 and sum(r["weight"] for r in pairs) == 6 * 50 * 50
    signed = sorted(round(r["x"] if r["label"] == 1 else -r["x"], 6) for r in pairs)
    assert signed == [0.25, 0.25, 0.25, 0.5, 0.5, 0.75] and all(abs(r["y"]) < 1e-9 for r in pairs)
    ranked = learning.predict(learning.pairwise_ranker(df, "g", ["x", "y"]), df.where("g = 'hot' and y = 0")).orderBy("score").collect()
    assert len({r["prediction"] for r in ranked}) == 4 and [r["prediction"] for r in ranked] == sorted(r["prediction"] for r in ranked)


def learner_rows(spark, n=1500):
    rng = np.random.default_rng(3)
    x = np.round(rng.random((n, 3)), 2)
    score = np.round(0.6 * x[:, 0] + 0.3 * x[:, 1] * x[:, 2] + 0.1 * rng.random(n), 2)
    group = np.where(np.arange(n) % 3 == 0, "hot", np.char.add("g", (np.arange(n) % 70).astype(str)))
    rows = [(f"i{k:05d}", str(g), *map(float, v), float(y)) for k, (g, v, y) in enumerate(zip(group, x, score, strict=True))]
    return spark.createDataFrame(rows, "id string, resume_id string, a double, b double, c double, score double")


def test_trees_are_those_of_sparks_boosting(spark):
    df, features = learner_rows(spark), ["a", "b", "c"]
    want = learning.predict(learning.boosted(features, 4, 3).fit(df), df).orderBy("id").select("prediction").toPandas()["prediction"]
    splits, forest, rounds = trees.fit_trees(df, features, (15, 4), (4, 3, 0.05))
    pdf = df.orderBy("id").toPandas()
    rows = trees.Rows((pdf[f].to_numpy() for f in features), splits)
    assert trees.predict_trees(rows, rounds) == pytest.approx(want.to_numpy(), abs=1e-9)
    assert len(forest) == 15 and np.corrcoef(trees.predict_trees(rows, forest) / 15, pdf["score"])[0, 1] > 0.85
    again = trees.fit_trees(df.orderBy(F.desc("b")), features, (15, 4), (1, 1, 0.05))[1]
    assert all((x == y).all() for a, b in zip(forest, again, strict=True) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize(("listed", "block"), [(64, 1024), (4, 50), (1000, 1024)])
def test_ranker_without_pairs_equals_logistic_regression_on_pairs(spark, listed, block, monkeypatch):
    for name, value in (("LISTED", listed), ("BLOCK", block), ("SLAB", 16)):
        monkeypatch.setattr(trees, name, value)
    df, features = learner_rows(spark, 600), ["a", "b", "c"]
    got = trees.fit_ranker(df, "resume_id", features)
    want = learning.pairwise_ranker(df, "resume_id", features).stages[-1].coefficients.toArray()
    assert got == pytest.approx(want, rel=1e-3)
    assert list(trees.fit_ranker(df.limit(0), "resume_id", features)) == [0, 0, 0]


def test_learners_of_full_size_take_few_jobs(spark):
    """300 trees and 300 rounds by Spark's own learners take thousands."""
    df = learner_rows(spark, 400).select("id", "resume_id", "score", *[F.col("abc"[k % 3]).alias(f) for k, f in enumerate(X.FEATURES)])
    spark.sparkContext.setJobGroup("learners", "")
    got = learning.compare(df, df, "score").toPandas()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("learners"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got["model"].value_counts().to_dict() == dict.fromkeys(("logistic", "forest", "boosted", "ranker"), 400)
    assert jobs < 400


def test_learners_have_their_full_size(spark):
    logistic, forest, boosted = (f().getStages()[-1] for f in (learning.logistic, learning.forest, learning.boosted))
    assert logistic.getMaxIter() == 1000
    assert (forest.getNumTrees(), forest.getMaxDepth(), forest.getSeed()) == (300, 10, 42)
    assert (boosted.getMaxIter(), boosted.getMaxDepth(), boosted.getStepSize()) == (300, 6, 0.05)


def test_names_of_any_length_and_mark_are_found(spark):
    names = spark.createDataFrame([("CI/CD",), (".NET",), ("Amazon Elastic Container Service Anywhere",), ("Spring",), ("Spring Boot",)], "name string")
    texts = spark.createDataFrame([(1, "CI/CD with Spring Boot"), (2, "amazon elastic container service anywhere"), (3, "net CI, CD springs"), (4, "C# and .NET"), (5, "")], "doc int, text string")
    got = {(r["doc"], r["name"]) for r in D.scan_names(texts, names, ["doc"]).collect()}
    assert got == {(1, "CI/CD"), (1, "Spring"), (1, "Spring Boot"), (2, "Amazon Elastic Container Service Anywhere"), (4, ".NET")}


def test_recommendations_and_gaps(spark):
    paths = spark.createDataFrame([("d", "title", "Lead of 3 teams"), ("d", "experience[0].bullets[1]", "Cut costs by 60 percent")], "doc string, ref string, text string")
    recs = spark.createDataFrame([("d", 1, "Say how you cut 60%", "experience[0].bullets[1]"), ("d", 2, "Say 61%", "experience[0].bullets[1]"), ("d", 3, "x", "experience[9].bullets[1]"), ("d", 4, "x", "anything"), ("d", 5, "x", None), ("e", 6, "Lead of 3", "title")], "doc string, rec_id int, suggestion string, based_on string")
    got = {r["rec_id"]: r["drop_reason"] for r in E.validate_recommendations(recs, paths).collect()}
    assert got == {1: None, 2: "fabricated number", 3: "does not resolve", 4: "unknown form", 5: "no reference", 6: "does not resolve"}
    missing = E.validate_missing(spark.createDataFrame([("d", "SQL"), ("d", "Go")], "doc string, skill string"), spark.createDataFrame([("d", "SQL"), ("d", "SQL")], "doc string, skill string"))
    assert {r["skill"]: r["kept"] for r in missing.collect()} == {"SQL": True, "Go": False}
    passed = {r["doc"]: (r["statements"], r["passed"]) for r in E.explanation_passed(missing.where("kept"), E.validate_recommendations(recs.where("rec_id = 1"), paths)).collect()}
    assert passed == {"d": (2, True)}


def test_payload_and_template(spark):
    paths = spark.createDataFrame([("d", f"experience[0].bullets[{k}]", f"b{k}") for k in (10, 2)] + [("d", "summary", "s"), ("d", "other", "no")], "doc string, ref string, text string")
    got = E.payload(paths, ["summary", "experience[#].bullets[#]"]).first()["payload"]
    assert got == '[summary] "s"\n[experience[0].bullets[2]] "b2"\n[experience[0].bullets[10]] "b10"'
    row = spark.createDataFrame([("x", None)], "a string, b int").select(E.fill("<{a}|{b}|{a}>", {"a": F.col("a"), "b": F.col("b")}).alias("t")).first()
    assert row["t"] == "<x||x>"


def test_generated_pairs(spark):
    left = spark.createDataFrame([(f"l{i}", ["a", "b", "z", None][i % 4]) for i in range(40)] + [("l0", "a")], "ref string, grp string")
    right = spark.createDataFrame([(f"r{i:02d}", "a" if i < 30 else "b" if i < 31 else None) for i in range(35)], "ref string, grp string")
    rows = B.generate_pairs(left, right, 3, 2).collect()
    group = {f"r{i:02d}": "a" if i < 30 else "b" for i in range(31)}
    assert len({(r["left_ref"], r["right_ref"]) for r in rows}) == len(rows)
    per = {}
    for r in rows:
        own = ["a", "b", "z", None][int(r["left_ref"][1:]) % 4]
        assert own is not None and (r["label"] == 0.8) == (group[r["right_ref"]] == own)
        per.setdefault((own, r["left_ref"], r["label"]), []).append(r["right_ref"])
    size = lambda own, label: {len(v) for k, v in per.items() if k[0] == own and k[2] == label}
    assert (size("a", 0.8), size("a", 0.2)) == ({3}, {1}) and (size("b", 0.8), size("b", 0.2)) == ({1}, {2}) and (size("z", 0.8), size("z", 0.2)) == (set(), {2})
    assert B.generate_pairs(left, right.limit(0)).count() == 0 and B.generate_pairs(left.limit(0), right).count() == 0


@pytest.mark.parametrize("rows_of_a_window", [10**6, 0])
def test_rank_keeps_rows_without_a_group(spark, monkeypatch, rows_of_a_window):
    monkeypatch.setattr(X, "WINDOW_ROWS", rows_of_a_window)
    df = spark.createDataFrame([("g", 1.0, "a"), ("g", 2.0, "b"), (None, 5.0, "c"), (None, 6.0, "d"), ("h", None, "e")], "g string, s double, t string")
    assert {(r["t"], r["rank"]) for r in X.rank_within(df, "g", "s", "t").collect()} == {("a", 2), ("b", 1), ("c", 2), ("d", 1), ("e", 1)}


def test_runs_are_appended(spark, tmp_path):
    where = str(tmp_path / "runs")
    rows = R.source_metrics(spark.createDataFrame([("s", 0.5, None)], "src string, f1 double, auc double"), "src", ["f1", "auc"])
    assert [tuple(r) for r in rows.collect()] == [("s__f1", 0.5)]
    first = R.log_run(where, "one", "forest", "v1", ["a", "b"], {"trees": 3}, rows).first()
    assert first["metrics"] == {"s__f1": 0.5} and first["features"] == ["a", "b"] and first["hyperparameters"] == '{"trees": 3}' and first["git_commit"] is None
    assert R.log_run(where, "two", "forest", "v1", [], {}, rows.limit(0), "abc").first()["metrics"] == {} and spark.read.parquet(where).count() == 2


def test_upsert_tells_new_from_known(spark):
    schema = "k string, label double, at int"
    old = spark.createDataFrame([("a", 0.5, 1), ("b", 0.25, 1), (None, 0.1, 1)], schema)
    new = spark.createDataFrame([("a", 0.125, 2), ("a", 0.876, 3), ("c", 1.0, 2)], schema)
    table, outcome = R.upsert(old, new, ["k"], "label", "at", 2)
    assert sorted(map(str, (tuple(r) for r in table.collect()))) == ["('a', 0.88, 3)", "('b', 0.25, 1)", "('c', 1.0, 2)", "(None, 0.1, 1)"]
    assert {r["k"]: r["inserted"] for r in outcome.collect()} == {"a": 0, "c": 1}
