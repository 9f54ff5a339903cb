"""Splitting, packing, leaks, mapping, personal information, keyword pages, top N."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomwork.llm import canonical as C
from loomwork.llm import leaks as L
from loomwork.llm import packing as P
from loomwork.llm import pii, pii_model, stuffing
from loomwork.llm import split as S
from loomwork.llm.pii_labels import first_names, label, name_pattern
from loomwork.llm.topn import top_n_per_group

ITEMS = "kind string, id string, text string, size_limit int, overlap int, data string"


def pieces_of(spark, rows, range_bytes=1 << 18):
    pieces, items = S.split_items(spark.createDataFrame([(*r, "x") for r in rows], ITEMS), range_bytes)
    out = {}
    for r in pieces.orderBy("id", "piece_index").collect():
        out.setdefault(r["id"], []).append(r)
    return out, {r["id"]: r for r in items.collect()}


def check_pieces(text, got, limit, overlap):
    assert [p["piece_index"] for p in got] == list(range(len(got)))
    assert got[0]["start"] == 0 and got[-1]["stop"] == len(text)
    for p in got:
        assert p["text"] == text[p["start"] : p["stop"]] and 0 < len(p["text"]) <= limit
    for a, b in zip(got, got[1:], strict=False):
        assert a["start"] < b["start"] <= a["stop"] and a["stop"] - b["start"] <= overlap


def test_split_round_trip(spark):
    rng = random.Random(2)
    some = ["one two.\n\n", "drei, vier! ", "é€漢字 ", "x\r\n", "tail\t", "😀😀 "]
    texts = {"mixed": "".join(rng.choice(some) for _ in range(3000)), "solid": "k" * 1001, "wide": "技能。" * 400, "edge": "a" * 100, "over": "a" * 101, "empty": "", "line": ("word " * 30 + "\n") * 20}
    rows = [("t", k, v, 100, 10) for k, v in texts.items()] + [("t", "null", None, 100, 10), (None, "x", "y" * 200, 100, 10), ("t", "over", texts["over"], 100, 10)]
    got, items = pieces_of(spark, rows)
    assert set(got) == {"mixed", "solid", "wide", "over", "line"}
    for k, p in got.items():
        check_pieces(texts[k], p, 100, 10)
        assert items[k]["chars"] == len(texts[k])
        assert items[k]["longest"] == max(map(len, __import__("re").findall(r"[^ \t\n\r]+", texts[k])), default=0)
    # natural boundaries where there are any
    assert all(p["text"][-1] in " \n" for p in got["line"][:-1])
    assert all(a["stop"] - b["start"] == 10 for a, b in zip(got["solid"], got["solid"][1:], strict=False))


@pytest.mark.parametrize("unit", ["wörd ", "k", "技", "a\n\nb 😀 "])
def test_ranges_are_stitched(spark, unit):
    text = unit * 6000
    got, items = pieces_of(spark, [("t", "big", text, 50, 5)], range_bytes=900)
    check_pieces(text, got["big"], 50, 5)
    assert items["big"]["longest"] == max(map(len, text.split()))


@pytest.mark.parametrize("unit", ["wörd ", "k", "技", "a. ", "a\n\nb 😀 "])
def test_pieces_overlap_at_seams_of_ranges(spark, unit):
    got, _ = pieces_of(spark, [("t", "big", unit * 6000, 50, 5)], range_bytes=900)
    check_pieces(unit * 6000, got["big"], 50, 5)
    assert {a["stop"] - b["start"] for a, b in zip(got["big"], got["big"][1:], strict=False)} == {5}


def test_files_are_read_by_range(spark, tmp_path):
    text = "".join(f"Zeile {i} mit ä und 漢.\n" for i in range(4000))
    p = tmp_path / "big.txt"
    p.write_text(text, encoding="utf-8")
    pieces, items = S.split_ranges(S.ranges_of_files(spark, [(str(p), p.stat().st_size)], 200, 4096))
    check_pieces(text, pieces.orderBy("piece_index").collect(), 200, 20)
    assert items.first()["chars"] == len(text)


def test_files_of_a_folder(spark, tmp_path):
    text = "".join(f"Zeile {i} mit ä und 漢.\n" for i in range(3000))
    (tmp_path / "a.txt").write_text(text, encoding="utf-8")
    (tmp_path / "_SUCCESS").write_text("x")
    files = S.files_below(spark, f"file://{tmp_path}")
    assert [(f.rsplit("/", 1)[1], n) for f, n in files] == [("a.txt", len(text.encode()))]
    pieces, _ = S.split_ranges(S.ranges_of_files(spark, files, 200, 4096))
    check_pieces(text, pieces.orderBy("piece_index").collect(), 200, 20)


def test_pieces_of_written_files_cover_every_text(spark):
    from pyspark.sql import Window

    got = S.p7_files(spark, "/root/testdata/sf0.001", range_bytes=1 << 14)
    texts = spark.read.parquet("/root/testdata/sf0.001/resumes.parquet").where("raw_text is not null")
    want = texts.agg(F.sum(F.length("raw_text") + 1)).first()[0]
    order = Window.partitionBy("file").orderBy("piece_index")
    rows = got.withColumn("before", F.lag("stop").over(order))
    odd = rows.where("length(piece) > 3000 or stop - start <> length(piece) or before is not null and before - start <> 300")
    assert odd.count() == 0 and rows.where("before is null").agg(F.max("start")).first()[0] == 0
    assert got.groupBy("file").agg(F.max("stop").alias("n")).agg(F.sum("n")).first()[0] == want


def test_split_of_nothing(spark):
    pieces, items = S.split_items(spark.createDataFrame([], ITEMS))
    assert pieces.count() == 0 and items.count() == 0


def test_packing_invariants(spark):
    rng = random.Random(7)
    rows = [(i, rng.randint(1, 700)) for i in range(900)] + [(5000, 2048), (5001, 5000), (5002, 0), (5003, None), (None, 7), (0, 3)]
    out = P.pack(spark.createDataFrame(rows, "item long, tokens long"), 2048).collect()
    fill, parts = {}, {}
    for r in out:
        fill[r["container"]] = fill.get(r["container"], 0) + r["tokens"]
        parts.setdefault(r["item"], []).append(r)
    assert max(fill.values()) <= 2048 and sum(fill.values()) / (2048 * len(fill)) > 0.985
    want = {}
    for k, n in rows:
        if k is not None and n:
            want[k] = max(want.get(k, 0), n)
    assert {k: sum(r["tokens"] for r in v) for k, v in parts.items()} == want
    assert all(len(v) == 1 for k, v in parts.items() if want[k] <= 2048) and [r["tokens"] for r in sorted(parts[5001], key=lambda r: r["part"])] == [2048, 2048, 904]
    assert P.pack(spark.createDataFrame([], "item long, tokens long")).count() == 0


def test_local_search_empties_a_bin():
    sizes = np.array([6, 5, 5, 4, 4, 3, 3])
    where = np.array([0, 1, 2, 0, 1, 2, 3])
    better = P.improve(sizes, where, 10)
    fill = np.bincount(better, sizes)
    assert len(fill) == 3 and fill.max() <= 10


def test_search_does_the_packing():
    rng = np.random.default_rng(4)
    sizes = rng.integers(40, 900, 3000)
    start = P.next_fit(sizes, 2048)
    assert np.bincount(start, sizes).max() <= 2048 and (np.diff(start) >= 0).all()
    better, need = P.improve(sizes, start, 2048), -(-int(sizes.sum()) // 2048)
    assert np.bincount(better, sizes).max() <= 2048 and better.max() + 1 <= need * 1.01 < (start.max() + 1) * 0.92


def test_leftovers_of_blocks_are_packed_together(spark):
    rng = random.Random(9)
    rows = [(i, rng.randint(1, 700)) for i in range(2000)] + [(9000 + k, 2048 * k + 5) for k in range(1, 4)]
    want = dict(rows)
    out = P.pack(spark.createDataFrame(rows, "item long, tokens long"), 2048, block=100).collect()
    fill, got = {}, {}
    for r in out:
        fill[r["container"]] = fill.get(r["container"], 0) + r["tokens"]
        got[r["item"]] = got.get(r["item"], 0) + r["tokens"]
        assert r["first_token"] == r["part"] * 2048
    assert got == want and max(fill.values()) <= 2048
    assert sum(n < 0.95 * 2048 for n in fill.values()) <= 2  # 21 blocks, yet what they left short is packed


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world", 3), (2, "", 3), (3, None, 3), (4, "<|endoftext|> ä" * 2000, 3)], "id int, body string, tokens int")
    got = {r["item"]: r["tokens"] for r in P.token_counts(df, "id", "body").collect()}
    assert got[1] == 2 and set(got) == {1, 4} and got[4] > 10000


def tile_brute(doc, item, least):
    best = 0
    for i in range(len(doc)):
        for j in range(len(item)):
            n = 0
            while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n]:
                n += 1
            best = max(best, n)
    return best if best >= least else 0


def test_tiles_against_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        item = [rng.randrange(12) for _ in range(60)]
        doc = [rng.randrange(12) for _ in range(50)] + item[10:35] + [99] + item[30:60] + [rng.randrange(12) for _ in range(20)]
        a, b = np.array(doc, np.uint64) + np.uint64(1), np.array(item, np.uint64) + np.uint64(1)
        got = L.tiles(a, b, 8)
        assert max((t[2] for t in got), default=0) == tile_brute(doc, item, 8)
        for x, y, n in got:
            assert doc[x : x + n] == item[y : y + n]
        marks = [k for x, y, n in got for k in range(y, y + n)]
        assert len(marks) == len(set(marks))


def leak_rows(spark):
    w = [f"wort{i}" for i in range(60)]
    items = [(1, " ".join(w)), (2, None), (3, ""), (4, "too short"), (1, " ".join(w))]
    run = lambda a, b: " ".join(w[a:b])
    docs = [
        (10, f"Start {run(5, 25)} end"),
        (11, f"Start {run(5, 24)} end"),
        (12, f"<p>{run(0, 10).upper()}</p>\n<b>{run(10, 15)}</b>, {run(15, 22).replace('ort', 'o' + chr(0xAD) + 'rt')}!"),
        (13, None),
        (14, ""),
        (15, ("filler " * 20000) + run(30, 55)),
        (10, f"Start {run(5, 25)} end"),
        (16, run(40, 60) + " " + run(0, 20)),
    ]
    return spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(0)), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("most", [10**6, 0])
def test_leaks_both_ways(spark, most, monkeypatch):
    monkeypatch.setattr(L, "MAX_BROADCAST_SEEDS", most)
    docs, items = leak_rows(spark)
    got = {r["doc_id"]: r for r in L.leaked_pairs(docs, items).collect()}
    assert set(got) == {10, 12, 15, 16} and got[16]["covered"] == 40 and got[10]["longest"] == 20
    assert L.leaked_pairs(docs.limit(0), items).count() == 0 and L.leaked_pairs(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("most", [10**6, 0])
def test_reordered_passages_leak_by_coverage(spark, most, monkeypatch):
    monkeypatch.setattr(L, "MAX_BROADCAST_SEEDS", most)
    w = [f"wort{i}" for i in range(60)]
    runs = [w[k : k + 12] for k in range(0, 60, 12)]
    docs = [(1, [runs[3], runs[0], runs[4], runs[2]]), (2, [runs[1], runs[0]]), (3, [runs[2], runs[1], runs[0]])]
    rows = [(k, " x ".join(" ".join(r) for r in parts)) for k, parts in docs] + [(1, None)]
    # edited: every tenth word is another
    rows.append((4, " ".join("other" if k % 10 == 9 else x for k, x in enumerate(w))))
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(w))], "item_id long, text string")
    got = {r["doc_id"]: (r["longest"], r["covered"]) for r in L.leaked_pairs(docs, items).collect()}
    assert got == {1: (12, 48), 3: (12, 36), 4: (9, 54)}
    assert not [r for r in L.leaked_pairs(docs, items, coverage=1.1).collect()]


@pytest.mark.parametrize("most", [10**6, 0])
def test_leaks_in_pieces_are_found_wherever_they_lie(spark, most, monkeypatch):
    """Pieces of exactly 8 words at places that are no multiple of 4."""
    monkeypatch.setattr(L, "MAX_BROADCAST_SEEDS", most)
    w = [f"wort{i}" for i in range(40)]
    rows = []
    for shift in range(8):
        parts = ["x " * (shift + 1), " ".join(w[0:8]), "y " * 5, " ".join(w[16:24]), "z " * 6, " ".join(w[32:40])]
        rows.append((shift, " ".join(parts)))
        rows.append((shift + 10, " ".join(parts[:4])))  # 16 words only
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(w))], "item_id long, text string")
    got = {r["doc_id"]: (r["longest"], r["covered"]) for r in L.leaked_pairs(docs, items).collect()}
    assert got == dict.fromkeys(range(8), (8, 24))


def test_candidates_hold_every_leak_of_random_texts():
    rng = random.Random(4)
    for _ in range(60):
        item = [f"w{rng.randrange(60)}" for _ in range(rng.choice([20, 33, 60, 120]))]
        known = L._Items([1], [" ".join(item)])
        doc = []
        for _ in range(rng.randrange(1, 12)):
            at, n = rng.randrange(len(item)), rng.randrange(6, 14)
            doc += item[at : at + n] + ["other"] * rng.randrange(1, 4)
        hashes = np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in doc], np.uint64)
        if L._measure(hashes, known.hashes[0], 20, 0.5):
            assert list(known.candidates(hashes, 20, 0.5)) == [0]


NAMES = [("s1", "Handomrne"), ("s2", "Handomrne Native"), ("s3", "Momixmua"), ("s4", "MomixmuaJS"), ("s5", "Gnokathpeo Cloud"), ("s6", "Kimiquemin"), ("s6", "KQM "), ("s7", "Zerritathoo.js"), ("s8", "Twice"), ("s9", "twice"), ("s0", None)]
VALUES = {
    "handomrne": "s1", "working with HANDOMRNE NATIVE daily": "s2", "Hanodmrne v3.1": "s1", "momixmuaj": None, "Cloud, Gnokathpeo": "s5", "K I M I Q U E M I N": "s6", "some kqm": "s6", "kqn": None,
    "Zеrritathoo.js": "s7", "Kimiquemin and Momixmua": None, "public speaking": None, "": None, "   ": None, "twice": None, "Kím1quem1n: 4/10": "s6", "x" * 5000: None,
}


@pytest.mark.parametrize("most", [1000, 1])
def test_values_both_ways(spark, most):
    values = spark.createDataFrame([(v, "e") for v in [*VALUES, *VALUES, None]], "value string, skill_id string")
    entries = spark.createDataFrame(NAMES, "skill_id string, name string")
    got = {r["value"]: r["skill_id"] for r in C.match_values(values, entries, most).collect()}
    assert got == VALUES
    assert C.match_values(values.limit(0), entries, most).count() == 0
    assert {r["skill_id"] for r in C.match_values(values, entries.limit(0), most).collect()} == {None}


@pytest.mark.parametrize("most", [1000, 1])
def test_short_and_long_names(spark, most):
    long = " ".join(f"part{i}" for i in range(9))
    names = [("c", "C"), ("cpp", "C++"), ("cs", "C#"), ("r", "R"), ("long", long), ("wide", "abcdefghij" * 9), ("year", "2020")]
    want = {"experience with C": "c", "c++": "cpp", "C# (advanced)": "cs", "R": "r", f"some {long.upper()} daily": "long", "ABCDEFGHIJ" * 9: "wide", "2020": "year", "S": None, "1999": None}
    got = C.match_values(spark.createDataFrame([(v,) for v in want], "value string"), spark.createDataFrame(names, "skill_id string, name string"), most)
    assert {r["value"]: r["skill_id"] for r in got.collect()} == want


def test_both_ways_score_alike(spark):
    rng = random.Random(8)
    syllables = ["gno", "ver", "ska", "lum", "pix", "tor", "bae", "quo", "rin", "del"]
    names = sorted({"".join(rng.choice(syllables) for _ in range(rng.choice([2, 3, 4]))) for _ in range(120)})
    values = []
    for _ in range(300):
        w = list(rng.choice(names))
        for _ in range(rng.choice([0, 1, 1, 2])):
            k = rng.randrange(len(w))
            w[k] = rng.choice(["", "x", w[k] * 2])
        values.append(("".join(w) + rng.choice(["", " js", " v2"]),))
    v, e = spark.createDataFrame(values, "value string"), spark.createDataFrame([(f"s{i % 90}", n) for i, n in enumerate(names)], "skill_id string, name string")
    a, b = ({r["value"]: (r["skill_id"], r["stage"], round(r["confidence"], 9)) for r in C.match_values(v, e, most).collect()} for most in (1000, 1))
    assert a == b and sum(x[0] is not None for x in a.values()) > 100


CV = "Dr. Rosa Varholt\nrosa_varholt@mailhaven.example | +44 7700 900281 | Zarnice\nHome: 44 Foundry Lane, Lumegrove 65966\nPassport no. E80364092\nSkills\nSQL\n- Closed ticket 4586-94-702 within the agreed time, mentored by Talvi Márberry"


def test_personal_information(spark):
    rows = [("a", CV, 1), ("b", "", 1), ("c", None, 1), ("d", "plain " * 30000 + "\n" + CV, 1), ("a", CV, 1)]
    got = {r["id"]: r for r in pii.find_personal(spark.createDataFrame(rows, "id string, text string, findings int"), "id", "text").collect()}
    assert set(got) == {"a", "b", "d"} and got["b"]["redacted"] == "" and len(got["b"]["findings"]) == 0
    for k in "ad":
        found = {(f["type"], pii.value_of(f["found"])) for f in got[k]["findings"]}
        assert {("email", "rosavarholtmailhavenexample"), ("phone", "447700900281"), ("identity", "e80364092"), ("address", "44foundrylanelumegrove65966"), ("name", "rosavarholt"), ("name", "talvimárberry")} <= found
        assert "[EMAIL]" in got[k]["redacted"] and "4586-94-702" in got[k]["redacted"] and "Foundry" not in got[k]["redacted"]
    assert pii.find_personal(spark.createDataFrame([], "id string, text string"), "id", "text").count() == 0


def test_tagger_on_other_rows():
    """Exact spans against the labelling rules on rows of another scale than the one it was fitted on."""
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.01/resumes.parquet", columns=["raw_text", "parsed_profile"]).to_pylist()
    rows = [(r["raw_text"], ((r["parsed_profile"] or {}).get("contact") or {}).get("name")) for r in t if r["raw_text"]]
    names = name_pattern(first_names(n for _, n in rows))
    got = pii.findings([t for t, _ in rows], pii_model.load_model())
    a = {(k, *s) for k, spans in enumerate(got) for s in spans}
    b = {(k, *s) for k, (t, _) in enumerate(rows) for s in label(t, names)}
    assert len(a & b) / len(a) > 0.97 and len(a & b) / len(b) > 0.97


def test_findings_across_window_seams():
    model = pii_model.load_model()
    texts = ["word " * (n // 5) + "x" * (n % 5) + "\nHome: 44 Foundry Lane, Lumegrove 65966\n" + "and so on " * 40 for n in range(120, 420, 3)]
    for spans in pii.findings(texts, model):
        assert [k for _, _, k in spans] == ["address"]
    assert len({t[a:b] for t, spans in zip(texts, pii.findings(texts, model), strict=True) for a, b, _ in spans}) == 1


def test_one_path_over_pieces_and_lengths():
    """The path of every text is the best of all, however texts are grouped and cut into sections."""
    rng = np.random.default_rng(6)
    moves = pii_model.legal_moves()[:5, :5] + rng.standard_normal((5, 5)).astype(np.float32)
    lengths, scores = np.array([7, 5, 5, 2]), [rng.standard_normal((n, 5)).astype(np.float32) for n in (7, 5, 5, 2)]
    grid = np.zeros((4, 7, 5), np.float32)
    for r, x in enumerate(scores):
        grid[r, : len(x)] = x
    for cut in (7, 3):
        decoder = pii_model.Viterbi(moves)
        for at in range(0, 7, cut):
            steps = min(cut, 7 - at)
            decoder.feed(grid[:, at : at + steps], np.searchsorted(-lengths, -(at + np.arange(steps)), "left"))
        for x, path in zip(scores, decoder.paths(lengths), strict=True):
            total = lambda tags, x=x: moves[0, tags[0]] + x[0, tags[0]] + sum(moves[a, b] + x[i + 1, b] for i, (a, b) in enumerate(zip(tags, tags[1:], strict=False)))
            every = [np.unravel_index(k, (5,) * len(x)) for k in range(5 ** len(x))] if len(x) < 6 else []
            assert not every or total([int(t) for t in path]) == pytest.approx(max(total(t) for t in every), abs=1e-4)


def test_sections_change_nothing(monkeypatch):
    model, texts = pii_model.load_model(), [(CV + "\n") * 9, CV, "", "plain"]
    whole = pii_model.decode_texts(model, texts)
    monkeypatch.setattr(pii_model, "SECTION", (pii_model.WINDOW - pii_model.OVERLAP) * 2)
    assert pii_model.decode_texts(model, texts) == whole


def test_gradient_is_right():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in pii_model.start(6, 5).items()}
    x, y = rng.integers(0, 90, (3, 7)).astype(np.uint8), np.array([[0, 1, 2, 2, 0, 3, 4]] * 3)
    fixed = pii_model.legal_moves()
    _, grad = pii_model.gradients(p, x, y, fixed)
    for name, at in (("Uf", (2, 3)), ("Wb", (1, 5)), ("bf", (4,)), ("Wo", (3, 2)), ("T", (1, 2))):
        e = 1e-3
        up, down = ({k: v.copy() for k, v in p.items()} for _ in range(2))
        up[name][at] += e
        down[name][at] -= e
        slope = (pii_model.gradients(up, x, y, fixed)[0] - pii_model.gradients(down, x, y, fixed)[0]) / (2 * e)
        assert grad[name][at] == pytest.approx(slope, rel=0.05, abs=2e-4)


def pages(spark):
    rng = random.Random(5)
    nouns, verbs, places = [f"noun{i}" for i in range(40)], [f"verb{i}" for i in range(30)], [f"Town{i}" for i in range(9)]
    sentence = lambda: f"The {rng.choice(nouns)} will {rng.choice(verbs)} the {rng.choice(nouns)} in {rng.choice(places)} before the {rng.choice(nouns)} is ready."
    rows = [(i, " ".join(sentence() for _ in range(12))) for i in range(150)]
    rows.append((900, " ".join(f"near job {rng.choice(places)}," for _ in range(60))))
    rows.append((901, "\n".join(f"https://a.example/{rng.choice(nouns)}" for _ in range(30))))
    rows.append((902, " ".join("#" + rng.choice(nouns + verbs + places).lower() for _ in range(80))))
    rows.append((903, "<ul>" + "".join(f'<li><a href="https://b.example/{i}">{rng.choice(nouns)} jobs</a></li>' for i in range(20)) + "</ul>"))
    rows.append((904, sentence() + " " + sentence() + " tags: a, b"))
    rows += [(905, None), (906, ""), (907, "one"), (None, "x"), (908, " ".join(sentence() for _ in range(4000)))]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("words", F.lit("x"))


def test_keyword_pages(spark):
    got = {r["doc_id"] for r in stuffing.keyword_pages(pages(spark)).collect()}
    assert got == {900, 901, 902, 903}
    scores = {r["doc_id"]: r for r in stuffing.page_scores(pages(spark)).collect()}
    assert scores[905]["words"] == scores[906]["words"] == 0 and None not in scores
    assert stuffing.page_scores(pages(spark).limit(0)).count() == 0


def test_keyword_page_scores_by_join_are_the_same(spark):
    docs = pages(spark)
    a, b = ({r["doc_id"]: r for r in stuffing.page_scores(docs, exact).collect()} for exact in (False, True))
    assert set(a) == set(b) and all(a[k]["words"] == b[k]["words"] for k in a)
    for k in a:
        assert [a[k][f] for f in (*stuffing.FEATURES, "score")] == pytest.approx([b[k][f] for f in (*stuffing.FEATURES, "score")], abs=1e-4)


@pytest.mark.parametrize("held", [1 << 22, 400, 40])
def test_rare_words_and_pairs_count_exactly(spark, held, monkeypatch):
    """Against counts in plain Python, whatever is broadcast, in a corpus where one in 2^21 would be more than 1."""
    monkeypatch.setattr(stuffing, "HELD", held)
    monkeypatch.setattr(stuffing, "RARE", 1 << 6)
    rows = [(r["doc_id"], r["text"]) for r in pages(spark).collect() if r["doc_id"] not in (None, 901, 903)]
    rows += [rows[0], (rows[0][0], rows[1][1])]
    texts = [re.findall(r"[^\W_]+", (t or "").lower()) for _, t in rows]
    texts = [["0" if w.isdigit() else w for w in t] for t in texts]
    words, pairs = Counter(w for t in texts for w in t), Counter(p for t in texts for p in zip(t, t[1:], strict=False))
    n_pairs, floor_w, floor_p = pairs.total(), max(1.0, words.total() / 64 / 2), max(0.1, pairs.total() / 64 / 20)
    want = []
    for (k, _), t in zip(rows, texts, strict=True):
        own, mine = Counter(zip(t, t[1:], strict=False)), Counter(t)
        pmi = [math.log((pairs[a, b] - own[a, b] + floor_p) * n_pairs / ((words[a] - mine[a] + floor_w) * (words[b] - mine[b] + floor_w))) for a, b in zip(t, t[1:], strict=False)]
        want.append((k, len(t), round(sum(pmi) / max(1, len(pmi)), 6)))
    got = [(r["doc_id"], r["words"], round(r["mean_pmi"], 6)) for r in stuffing.page_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-5 for a, b in zip(sorted(got), sorted(want), strict=True))


def test_fit_separates():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, len(stuffing.FEATURES)))
    y = (2 * x[:, 3] - x[:, 0] > 0.3).astype(float)
    w, b = stuffing.fit(x, y)
    assert np.mean(((x @ w + b) > 0) == y) > 0.97


def test_top_n(spark):
    rng = random.Random(1)
    rows = [("hot", f"i{i:05d}", rng.randint(0, 5), "r") for i in range(3000)] + [(f"g{i % 50}", f"j{i}", rng.choice([None, 1, 2]), "r") for i in range(400)]
    rows += rows[:500] + [(None, "x", 9, "r"), ("g1", None, 9, "r")]
    df = spark.createDataFrame(rows, "g string, item string, s int, rank string")
    got = {}
    for r in top_n_per_group(df, "g", "item", [F.col("s").desc_nulls_last()], 5).orderBy("g", "rank_1").collect():
        got.setdefault(r["g"], []).append(r["item"])
    want = {}
    for g, i, s, _ in set(rows):
        if g is not None and i is not None:
            want.setdefault(g, []).append((-(s if s is not None else -1), i))
    assert got == {g: [i for _, i in sorted(v)[:5]] for g, v in want.items()}
    assert top_n_per_group(df.limit(0), "g", "item", [F.col("s").desc()], 5).count() == 0


def test_versions_of_an_item_take_one_place(spark):
    rows = [("g", "a", s) for s in range(100, 130)] + [("g", f"i{k}", k) for k in range(40)] + [("g", "i39", 1)]
    df = spark.createDataFrame(rows, "g string, item string, s int")
    for salts in (1, 8):
        best = top_n_per_group(df, "g", "item", [F.col("s").desc_nulls_last()], 5, salts).orderBy("rank").collect()
        assert [(r["item"], r["s"]) for r in best] == [("a", 129), ("i39", 39), ("i38", 38), ("i37", 37), ("i36", 36)]
