"""Problem 4: freely typed values mapped to a canonical list by a character n-gram index."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.llm.common import records
from loomwork.session import materialize
from loomwork.tables import load

#: A span means the skill of its nearest entry if their cosine reaches LEAST_COSINE and what it lacks to 1 is at most MARGIN
#: times what every other skill lacks.
LEAST_COSINE, MARGIN = 0.63, 0.74
#: Below this cosine an entry decides nothing: it neither wins nor comes within the margin of a winner.
FLOOR = 1 - (1 - LEAST_COSINE) / MARGIN
#: Weight of an n-gram: its inverse document frequency to this power. Weights of overlapping spans: cosine times a power of
#: their length, so of equally sure spans the longer one counts.
IDF_POWER, LENGTH_POWER = 0.25, 0.10
#: Stands for the cosine of a name that is typed exactly: more than any length can make up for.
EXACT = 1e6
#: Reference entries up to which the index is broadcast; beyond, n-grams meet in a join.
MAX_BROADCAST_ENTRIES = 50_000
#: A span has up to this many words more than the longest name, for blanks typed inside names.
EXTRA_WORDS = 3
#: Cyrillic and Greek letters that look like Latin ones. Fixed values.
_LOOKALIKES = str.maketrans("асеорхуіјѕԁһкмтвнАСЕОРХУІЈЅКМТВНоαβεικνορτυχ", "aceopxyijsdhkmtbhACEOPXYIJSKMTBHoabeiknoptux")
_LEET = str.maketrans("0134578", "oieastb")
_MIXED = re.compile(r"(?=[a-z0-9]*[a-z])(?=[a-z0-9]*[0-9])[a-z0-9]+")
#: A word with the marks that tell names such as C, C++ and C# apart.
_WORD = re.compile(r"[^\W_]+(?:\+\+|#)?")


def tokens(text: str) -> list[str]:
    """Words of a value, folded: compatible forms, look-alike letters, accents, case, digits typed for letters; letters
    with a blank between each are joined."""
    plain = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text).translate(_LOOKALIKES))
    plain = "".join(c for c in plain if unicodedata.category(c) not in ("Mn", "Cf")).lower()
    found = _WORD.findall(plain)
    if len(found) >= 4 and all(len(t) == 1 for t in found):
        return ["".join(found)]
    out = []
    for t in found:
        letters = sum(c.isalpha() for c in t)
        # 0xskel0 is a word with digits for letters, v11 is not
        if letters >= 3 and letters < len(t) and _MIXED.fullmatch(t):
            t = t.translate(_LEET)
        out.append(t)
    return out


def grams(key: str) -> Counter:
    """Letters, 2-grams and 2-grams with a letter left out, of a name with its ends marked. A swap of two letters keeps
    the letters and most gapped pairs, so it costs less than an exchange for others."""
    padded = f"^{key}$"
    out = list(key)
    out += [padded[i : i + 2] for i in range(len(padded) - 1)]
    out += [f"{padded[i]}_{padded[i + 2]}" for i in range(len(padded) - 2)]
    return Counter(out)


def spans(found: list[str], most_words: int) -> Iterator[tuple[int, int, str]]:
    """(start, stop, key) of the runs of up to most_words words; two words count in either order (Cloud, Name)."""
    n = len(found)
    for i in range(n):
        for j in range(i + 1, min(n, i + most_words) + 1):
            yield i, j, "".join(found[i:j])
            if j - i == 2:
                yield i, j, found[i + 1] + found[i]


def weight(count: int | float, of: int) -> float:
    """Weight of an n-gram that `count` of `of` entries have."""
    return math.log(1 + of / max(1, count)) ** IDF_POWER


class Index:
    """Inverted lists of n-grams over (skill, key) entries."""

    def __init__(self, entries: list[tuple[str, str]], most_words: int):
        self.entries, self.most_words = sorted(set(entries)), most_words
        self.exact: dict[str, set[str]] = {}
        for skill, key in self.entries:
            self.exact.setdefault(key, set()).add(skill)
        owner = [skill for skill, _ in self.entries]
        self.skills = sorted(set(owner))
        self.starts = np.searchsorted(np.array(owner, object), np.array(self.skills, object)) if owner else np.empty(0, int)
        counts = [grams(key) for _, key in self.entries]
        seen = Counter(g for c in counts for g in c)
        n = max(1, len(self.entries))
        self.weights, self.rare = {g: weight(v, n) for g, v in seen.items()}, weight(1, n)
        lists: dict[str, list[tuple[int, float]]] = {}
        for at, c in enumerate(counts):
            size = math.sqrt(sum((v * self.weights[g]) ** 2 for g, v in c.items()))
            for g, v in c.items():
                lists.setdefault(g, []).append((at, v * self.weights[g] / size))
        self.lists = {g: (np.array([a for a, _ in v]), np.array([w for _, w in v])) for g, v in lists.items()}

    def nearest(self, key: str) -> tuple[str, float, float] | None:
        """(skill, cosine, cosine of the next skill) of the nearest skill at FLOOR or more."""
        ids, weights, size = [], [], 0.0
        for g, v in grams(key).items():
            w = v * self.weights.get(g, self.rare)
            size += w * w
            if g in self.lists:
                ids.append(self.lists[g][0])
                weights.append(self.lists[g][1] * w)
        if not ids:
            return None
        score = np.bincount(np.concatenate(ids), np.concatenate(weights), len(self.entries)) / math.sqrt(size)
        score = np.maximum.reduceat(score, self.starts)
        best = int(score.argmax())
        cosine = float(score[best])
        if cosine < FLOOR:
            return None
        score[best] = 0
        return self.skills[best], cosine, float(score.max())

    def judge(self, key: str) -> tuple[str | None, float] | None:
        if key in self.exact:
            return (next(iter(self.exact[key])) if len(self.exact[key]) == 1 else None), EXACT
        near = self.nearest(key)
        return accept(*near) if near else None


def accept(skill: str, cosine: float, second: float) -> tuple[str | None, float] | None:
    """(skill, cosine) if the cosine is high enough, skill None if another comes within the margin; None for no match."""
    if cosine < LEAST_COSINE:
        return None
    return (skill if 1 - cosine <= MARGIN * (1 - second) else None), cosine


def _by_weight(judged: list[tuple]) -> list[tuple]:
    return sorted(judged, key=lambda s: (-s[4] * len(s[2]) ** LENGTH_POWER, s[0], s[2]))


def taken(judged: list[tuple]) -> list[tuple[int, int]]:
    """The words that the spans that win take."""
    out: list[tuple[int, int]] = []
    for i, j, *_ in _by_weight(judged):
        if not any(i < b and a < j for a, b in out):
            out.append((i, j))
    return out


def decide(judged: list[tuple[int, int, str, str | None, float]]) -> tuple[str | None, str, float]:
    """(skill, stage, confidence) of a value from its spans (start, stop, key, skill, cosine; EXACT for an exact name): of
    spans that overlap exact names and then the surer ones win; what is left must name exactly one skill."""
    skills, used, stage, confidence = set(), [], "exact", 1.0
    for i, j, _, skill, cosine in _by_weight(judged):
        if any(i < b and a < j for a, b in used):
            continue
        used.append((i, j))
        skills.add(skill)
        stage, confidence = ("exact", 1.0) if cosine == EXACT else ("fuzzy", cosine)
    if len(skills) != 1 or None in skills:
        return None, "unmatched", 0.0
    return skills.pop(), stage, confidence


_MATCH_SCHEMA = "value string, skill_id string, stage string, confidence double"


def match_values(values: DataFrame, entries: DataFrame, max_broadcast: int = MAX_BROADCAST_ENTRIES) -> DataFrame:
    """values(value), entries(skill_id, name) -> (value, skill_id, stage, confidence) for each distinct value; skill_id
    is null and stage unmatched where it means no skill, several, or is as close to one as to another. Null values give
    no row, blank ones are unmatched; null names are ignored, a name listed for two skills means neither. Names and values
    may have any length: spans grow with the longest name.

    Each distinct value is judged once. While the reference list has at most max_broadcast entries (checked), its index
    is broadcast; a longer list is joined by n-gram, with the same scores.
    """
    distinct = values.select("value").where("value is not null").distinct()
    rows = entries.select("skill_id", "name").dropna().distinct()
    spark = values.sparkSession
    if rows.limit(max_broadcast + 1).count() <= max_broadcast:
        listed = [(r[0], tokens(r[1])) for r in rows.collect()]
        longest = max((len(t) for _, t in listed), default=0)
        shared = spark.sparkContext.broadcast(Index([(skill, "".join(t)) for skill, t in listed if t], longest + EXTRA_WORDS))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = shared.value
            judge = lru_cache(1 << 16)(index.judge)  # words around names come again and again
            for pdf in batches:
                out = []
                for value in pdf["value"]:
                    every = list(spans(tokens(value), index.most_words))
                    # exact names win over all they overlap, so nothing that does needs a cosine
                    sure = [(i, j, key, *judge(key)) for i, j, key in every if key in index.exact]
                    kept = taken(sure)
                    free = [(i, j, key) for i, j, key in every if not any(i < b and a < j for a, b in kept)]
                    near = [(i, j, key, *g) for i, j, key in free if (g := judge(key))]
                    out.append((value, *decide(sure + near)))
                yield pd.DataFrame(out, columns=["value", "skill_id", "stage", "confidence"])

        # values are few bytes and much work: without a stated number the adaptive planner would give one task all of them
        cores = spark.sparkContext.defaultParallelism
        return distinct.repartition(4 * cores, "value").mapInPandas(run, _MATCH_SCHEMA)
    return _match_by_join(distinct, rows)


def _prefix(rows: DataFrame, owner: list[str]) -> DataFrame:
    """rows(owner, gram, df, w), w adding up to length 1 an owner, without the most frequent grams whose weights have a
    length below FLOOR together. Two owners that share none of the grams left have a cosine below FLOOR: all they share
    lies in what one of them left out. So only rarer grams are joined, and no pair is lost."""
    tail = Window.partitionBy(*owner).orderBy(F.desc("df"), F.desc("gram")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_t", F.sum(F.col("w") * F.col("w")).over(tail)).where(F.col("_t") >= (FLOOR - 1e-9) ** 2).drop("_t")


def _match_by_join(distinct: DataFrame, rows: DataFrame) -> DataFrame:
    """The same over an index that is a table: rare n-grams of both sides meet, cosines are sums of products."""

    def entry_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for skill, name in zip(pdf["skill_id"], pdf["name"], strict=True):
                found = tokens(name)
                key = "".join(found)
                out += [(skill, key, len(found), g, float(v)) for g, v in grams(key).items()] if key else []
            yield pd.DataFrame(out, columns=["skill_id", "name", "words", "gram", "n"])

    listed = materialize(rows.mapInPandas(entry_grams, "skill_id string, name string, words int, gram string, n double"))
    names = listed.select("name", "gram", "n").distinct()
    owners = listed.select("skill_id", "name").distinct()
    total, longest = owners.count(), listed.agg(F.max("words")).first()[0] or 0
    most_words = longest + EXTRA_WORDS

    def span_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(value, i, j, key) for value in pdf["value"] for i, j, key in spans(tokens(value), most_words)]
            yield pd.DataFrame(out, columns=["value", "i", "j", "key"])

    def key_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(key, g, float(v)) for key in pdf["key"] for g, v in grams(key).items()]
            yield pd.DataFrame(out, columns=["key", "gram", "n"])

    asked = materialize(distinct.mapInPandas(span_rows, "value string, i int, j int, key string"))
    df = materialize(owners.join(names, "name").groupBy("gram").agg(F.count("*").cast("double").alias("df")))
    scaled = lambda count: F.pow(F.log1p(F.lit(float(total)) / F.greatest(count, F.lit(1.0))), F.lit(IDF_POWER))

    def unit(table: DataFrame, owner: str) -> DataFrame:
        got = table.join(df, "gram", "left").withColumn("df", F.coalesce("df", F.lit(0.0)))
        got = got.withColumn("w", F.col("n") * scaled(F.col("df")))
        return got.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(owner)))).drop("n")

    keys = asked.select("key").distinct().mapInPandas(key_grams, "key string, gram string, n double")
    left, right = materialize(unit(keys, "key")), materialize(unit(names, "name"))
    pairs = _prefix(left, ["key"]).select("key", "gram").join(_prefix(right, ["name"]).select("name", "gram"), "gram").select("key", "name").distinct()
    near = pairs.join(left.select("key", "gram", F.col("w").alias("wq")), "key").join(right.select("name", "gram", "w"), ["name", "gram"])
    near = near.groupBy("key", "name").agg(F.sum(F.col("wq") * F.col("w")).alias("cosine")).where((F.col("cosine") >= FLOOR) | (F.col("key") == F.col("name")))
    best = near.join(owners, "name").groupBy("key", "skill_id").agg(F.max("cosine").alias("cosine"), F.max(F.col("key") == F.col("name")).alias("same"))
    order = Window.partitionBy("key").orderBy(F.desc("cosine"), "skill_id")
    ranked = best.withColumn("k", F.row_number().over(order)).where("k <= 2 or same")
    judged = ranked.groupBy("key").agg(
        F.count_if("same").alias("same"),
        F.min(F.when(F.col("same"), F.col("skill_id"))).alias("exact"),
        F.max_by("skill_id", F.when(F.col("k") == 1, F.lit(1))).alias("skill"),
        F.max(F.when(F.col("k") == 1, F.col("cosine"))).alias("cosine"),
        F.coalesce(F.max(F.when(F.col("k") == 2, F.col("cosine"))), F.lit(0.0)).alias("second"),
    )
    per = asked.join(judged, "key").groupBy("value").agg(F.collect_list(F.struct("i", "j", "key", "same", "exact", "skill", "cosine", "second")).alias("spans"))
    every = distinct.join(per, "value", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for value, each in zip(pdf["value"], pdf["spans"], strict=True):
                kept = []
                for s in each if each is not None else ():
                    got = ((s["exact"] if s["same"] == 1 else None), EXACT) if s["same"] else accept(s["skill"], s["cosine"], s["second"])
                    if got:
                        kept.append((s["i"], s["j"], s["key"], *got))
                out.append((value, *decide(kept)))
            yield pd.DataFrame(out, columns=["value", "skill_id", "stage", "confidence"])

    return every.mapInPandas(run, _MATCH_SCHEMA)


def reference_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = load(spark, sf_dir, "skills").select(F.col("id").alias("skill_id"), F.col("canonical_name").alias("name"))
    return names.unionByName(load(spark, sf_dir, "skill_aliases").select("skill_id", F.col("alias").alias("name")))


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(load(spark, sf_dir, "normalization_results"), ["result_id"], ["raw_text"])
    matched = match_values(rows.select(F.col("raw_text").alias("value")), reference_entries(spark, sf_dir))
    return rows.join(matched.withColumnRenamed("value", "raw_text"), "raw_text", "left")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).where("skill_id is not null").select("result_id", "skill_id")


def p4_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that mean no single skill, with the rows that hold them."""
    rows = _resolved(spark, sf_dir).where("skill_id is null and raw_text is not null")
    return rows.groupBy("raw_text").agg(F.count("*").alias("results"))


QUERIES = {"p4_found": p4_found, "p4_unmatched": p4_unmatched}
ORACLE: dict[str, str] = {}
