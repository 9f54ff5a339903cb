"""Overlaps across splits, linked groups, neighbours."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.llm import groups as G
from loomwork.llm import neighbours as N
from loomwork.llm import overlap as O
from loomwork.llm.common import words

TEXTS = "kind string, id string, text string"
SPLITS = "kind string, id string, in_train boolean, in_held boolean"


def brute(texts, splits, threshold=0.7):
    sets = {}
    for kind, key, text in texts:
        w = words(text or "")
        if len(w) >= 20:
            sets[kind, key] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    flags = {(k, i): (t, h) for k, i, t, h in splits}
    out = set()
    for a in sets:
        for b in sets:
            if a[0] == b[0] and a[1] < b[1] and a in flags and b in flags:
                (ta, ha), (tb, hb) = flags[a], flags[b]
                if (ta and hb or tb and ha) and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                    out.add((a[0], a[1], b[1]))
    return out


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(60)] for _ in range(12)]
    texts, splits = [], []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 9])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        kind = rng.choice(["resume", "job"])
        texts.append((kind, f"{i:03d}", " ".join(w)))
        splits.append((kind, f"{i:03d}", *rng.choice([(True, False), (False, True), (True, True)])))
    texts += [("resume", "null", None), ("resume", "empty", ""), ("resume", "short", "w1 " * 10), ("job", "000x", "Ä1 " * 5000)]
    splits += [("resume", k, True, True) for k in ("null", "empty", "short")] + [("job", "000x", True, False)]
    return texts, splits


def found(spark, texts, splits):
    t = spark.createDataFrame([(*r, "x") for r in texts], TEXTS + ", cls string")  # a column whose name the operator uses itself
    got = O.cross_split_pairs(t, spark.createDataFrame(splits, SPLITS))
    return sorted(tuple(r) for r in got.collect())


def test_overlap_equals_brute_force(spark):
    texts, splits = corpus()
    assert found(spark, texts + texts[:20], splits) == sorted(brute(texts, splits))


def test_overlap_heavy_buckets_meet_by_rare_shingles(spark, monkeypatch):
    monkeypatch.setattr(O, "LIGHT_PAIRS", 4)
    monkeypatch.setattr(O, "MAX_BROADCAST_ROWS", 0)
    texts, splits = corpus(2, 90)
    assert found(spark, texts, splits) == sorted(brute(texts, splits))


def test_overlapping_records_are_those_of_the_pairs(spark):
    texts, splits = corpus(5)
    got = O.overlapping_records(spark.createDataFrame(texts, TEXTS), spark.createDataFrame(splits, SPLITS))
    assert {tuple(r) for r in got.collect()} == {(k, x) for k, a, b in brute(texts, splits) for x in (a, b)}


def test_overlap_copies_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(O, "PAIR_BLOCK", 7)
    same = " ".join(f"w{i}" for i in range(30))
    texts = [("resume", f"{i}", same) for i in range(6)]
    splits = [("resume", f"{i}", i < 3, i >= 3) for i in range(6)]
    assert len(found(spark, texts, splits)) == 9
    texts, splits = [("resume", f"{i:04d}", same) for i in range(60)], [("resume", f"{i:04d}", i % 2 == 0, i % 2 == 1) for i in range(60)]
    assert len(found(spark, texts, splits)) == 900
    empty = O.cross_split_pairs(spark.createDataFrame([], TEXTS), spark.createDataFrame([], SPLITS))
    assert empty.count() == 0


def label_rows(spark, rows):
    return spark.createDataFrame(rows, "id string, l string, r string, _l string, group_id string")


def test_ref_key(spark):
    vals = ["00000000000000ff", " 00000000000000FF\n", " 00000000000000ff ", "ffffffffffffffff", "0" * 16, "n/a", "", None, "0" * 17, "g000000000000000"]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "v string").select(G.ref_key("v")).collect()]
    assert got == [255, 255, 255, -1, None, None, None, None, None, None]


def test_linked_groups(spark):
    h = lambda n: f"{n:016x}"
    rows = [("c", h(1), h(9), "", ""), ("a", h(2), h(9).upper(), "", ""), ("b", f" {h(2)}", None, "", ""), ("d", None, h(1), "", ""), ("e", None, h(1), "", ""), ("f", "n/a", "n/a", "", ""), ("g", None, None, "", ""), (None, h(1), h(1), "", ""), ("a", h(2), h(9).upper(), "", "")]
    got = {r["id"]: r["group_id"] for r in G.linked_groups(label_rows(spark, rows).drop("_l", "group_id"), "id", "l", "r").collect()}
    # d and e share a job ref whose digits are those of a resume ref: no link between the two kinds
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "f", "g": "g"}
    assert G.linked_groups(label_rows(spark, []).drop("_l", "group_id"), "id", "l", "r").count() == 0


def test_row_with_right_ref_only_joins_the_left_component(spark):
    h = lambda n: f"{n:016x}"
    rows = [("x", h(1), h(5)), ("y", None, h(5)), ("z", h(7), None), ("w", h(7), h(8)), ("v", None, h(8))]
    got = {r["id"]: r["group_id"] for r in G.linked_groups(spark.createDataFrame(rows, "id string, l string, r string"), "id", "l", "r").collect()}
    assert got == {"x": "x", "y": "x", "z": "v", "w": "v", "v": "v"}


def test_assigned_shares_and_strata(spark):
    rng = random.Random(4)
    rows, k = [], 0
    for g in range(3000):
        for _ in range(rng.choice([1, 1, 2, 3])):
            rows.append((f"g{g}", rng.choice("abc")))
            k += 1
    rows += [("hot", "a")] * (k // 3)
    df = spark.createDataFrame(rows, "g string, s string")
    out = G.assign_splits(df, "g", F.col("s"))
    assert out.count() == out.select("g").distinct().count() == 3001
    share = {r["split"]: r["n"] / len(rows) for r in out.groupBy("split").agg(F.sum("rows").alias("n")).collect()}
    assert share == pytest.approx({"train": 0.70, "val": 0.15, "test": 0.15}, abs=0.02)
    per = df.join(out, "g").groupBy("s", "split").count().collect()
    total = {s: sum(r["count"] for r in per if r["s"] == s) for s in "abc"}
    for r in per:
        assert r["count"] / total[r["s"]] == pytest.approx({"train": 0.7, "val": 0.15, "test": 0.15}[r["split"]], abs=0.05)
    assert G.assign_splits(df.limit(0), "g", F.col("s")).count() == 0


def test_rare_strata_are_pooled(spark, monkeypatch):
    monkeypatch.setattr(G, "MAX_STRATA", 4)
    rng = random.Random(2)
    rows = [(f"g{i // 2}", rng.choice("abc" + "defghijklm" * 1)) for i in range(2000)]
    df = spark.createDataFrame(rows + [("gnull", None)], "g string, s string")
    out = G.assign_splits(df, "g", F.col("s"))
    assert out.count() == 1001 and out.agg(F.sum("rows")).first()[0] == 2001
    share = {r["split"]: r["n"] / 2001 for r in out.groupBy("split").agg(F.sum("rows").alias("n")).collect()}
    assert share == pytest.approx({"train": 0.70, "val": 0.15, "test": 0.15}, abs=0.03)


def test_assigned_labels_against_sql_counts(spark, duck_small):
    """Every label once, groups whole, shares as asked, and label kinds spread over the splits."""
    got = G.p2_assigned(spark, "/root/testdata/sf0.001").toPandas()
    n = duck_small.sql("select count(distinct id) from training_labels").fetchall()[0][0]
    assert len(got) == got["label_id"].nunique() == n
    assert got.groupby("group_id")["split"].nunique().max() == 1
    duck_small.register("assigned", got)
    torn = duck_small.sql(f"select count(*) from ({G.ORACLE['p2_found']}) f left join assigned a using (label_id) where a.group_id is distinct from f.group_id").fetchall()[0][0]
    assert torn == 0
    shares = dict(duck_small.sql(f"select split, count(*) / {n}.0 from assigned group by split").fetchall())
    assert shares == pytest.approx({"train": 0.70, "val": 0.15, "test": 0.15}, abs=0.08)


def test_codes_estimate_within_bounds():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 384)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turn = N.rotation(384)
    bits, align, turned = N.encode(x, turn)
    got, error = N.estimate(turned, bits, align)
    off = ~np.eye(400, dtype=bool)
    gap = np.abs(got - x @ x.T)[off]
    assert bits.shape == (400, 48) and np.mean(gap > (N.EPSILON * np.broadcast_to(error, got.shape))[off]) < 0.005


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    mid = rng.standard_normal((40, 48))
    x = mid[rng.integers(0, 40, 1500)] + 0.6 * rng.standard_normal((1500, 48))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def test_recall_against_brute_force(spark, vectors):
    rows = [(f"{i:05d}", "m", v.tolist()) for i, v in enumerate(vectors)]
    members, links = N.neighbours(spark.createDataFrame(rows, "id string, model string, embedding array<float>"), 10)
    got = {}
    for r in N.similar_ids(members, links, 10).collect():
        got.setdefault(int(r["id"]), set()).add(int(r["other"]))
    like = vectors @ vectors.T
    np.fill_diagonal(like, -2)
    best = np.argsort(-like, axis=1)[:, :10]
    assert np.mean([len(got[i] & set(best[i])) / 10 for i in range(len(vectors))]) >= 0.9


def test_blocks_meet(spark, vectors, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 60)
    rows = [(f"{i:05d}", "m", v.tolist()) for i, v in enumerate(vectors[:600])]
    members, links = N.neighbours(spark.createDataFrame(rows, "id string, model string, embedding array<float>"), 5, 0.5)
    got = {(r["id"], r["other"]) for r in N.similar_ids(members, links, 5).collect()}
    like = vectors[:600] @ vectors[:600].T
    np.fill_diagonal(like, -2)
    want = {(f"{i:05d}", f"{j:05d}") for i in range(600) for j in np.argsort(-like[i])[:5] if like[i, j] >= 0.5}
    assert len(got & want) >= 0.9 * len(want) and len(got - want) <= 0.1 * len(want)


def test_two_levels_of_lists(spark, vectors, monkeypatch):
    monkeypatch.setattr(N, "SAMPLE", 160)
    monkeypatch.setattr(N, "ROOT", 0.8)
    monkeypatch.setattr(N, "PER_CENTRE", 8)
    rows = [(f"{i:05d}", "m", v.tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "id string, model string, embedding array<float>")
    lists = N.fit_lists(N._prepare(df))["48|m"]
    assert lists.under is not None and len(lists.blocks) == sum(map(len, lists.under)) > 40 > len(lists.mid)
    members, links = N.neighbours(df, 10)
    got = {}
    for r in N.similar_ids(members, links, 10).collect():
        got.setdefault(int(r["id"]), set()).add(int(r["other"]))
    like = vectors @ vectors.T
    np.fill_diagonal(like, -2)
    best = np.argsort(-like, axis=1)[:, :10]
    assert np.mean([len(got.get(i, set()) & set(best[i])) / 10 for i in range(len(vectors))]) >= 0.9


def test_a_vector_with_many_ids_is_entered_once_a_task(spark):
    rng = np.random.default_rng(1)
    hot = rng.standard_normal(16).astype(np.float32).tolist()
    other = spark.createDataFrame([(f"o{i}", "m", (np.array(hot) + 0.1 * rng.standard_normal(16)).tolist()) for i in range(40)], "id string, model string, embedding array<float>")
    copies = spark.range(0, 100_000, 1, 4).select(F.concat(F.lit("c"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("id"), F.lit("m").alias("model"), F.array(*map(F.lit, hot)).cast("array<float>").alias("embedding"))
    seen = N._Seen()
    nodes, asked = np.array(["a"] * 1000 + ["b"], object), np.array([False] * 500 + [True] * 501)
    assert list(seen.new(nodes, asked)) == [0, 500, 1000] and not len(seen.new(nodes, asked))
    members, links = N.neighbours(copies.unionByName(other), 3)
    assert members.count() == 100_040 and links.groupBy("node").count().agg(F.max("count")).first()[0] == 3
    got = N.similar_ids(members, links, 3)
    assert got.groupBy("id").count().agg(F.count("*"), F.min("count"), F.max("count")).first()[:] == (100_040, 3, 3)
    assert sorted(r["other"] for r in got.where("id = 'c070000'").collect()) == ["c000000", "c000001", "c000002"]


def test_odd_vectors_copies_and_models(spark):
    v, w = [1.0, 0.0, 0.0], [0.9, 0.1, 0.0]
    rows = [(f"c{i:02d}", "m", v, "n") for i in range(30)] + [("near", "m", w, "n"), ("scaled", "m", [2.0, 0.0, 0.0], "n"), ("other", "k", v, "n"), ("zero", "m", [0.0] * 3, "n"), ("null", "m", None, "n"), ("none", None, v, "n"), ("long", "m", [1.0] * 5, "n"), ("nan", "m", [float("nan"), 1.0, 0.0], "n"), ("hole", "m", [None, 1.0, 0.0], "n"), ("void", "m", [], "n"), (None, "m", v, "n"), ("near", "m", w, "n")]
    df = spark.createDataFrame(rows, "id string, model string, embedding array<float>, node string")
    members, links = N.neighbours(df, 3, 0.5)
    got = {}
    for r in N.similar_ids(members, links, 3).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["other"])
    assert got["c05"] == ["c00", "c01", "c02"] and got["c00"] == ["c01", "c02", "c03"] and got["near"] == ["c00", "c01", "c02"]
    assert set(got) == {f"c{i:02d}" for i in range(30)} | {"near", "scaled"}
    assert N.similar_ids(*N.neighbours(df.limit(0), 3), 3).count() == 0
