"""Problem 2: linked groups of label rows and splits that keep them together."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.llm.common import records
from loomwork.operators.graph import components
from loomwork.session import materialize
from loomwork.tables import load

#: Strata that are balanced one by one.
MAX_STRATA = 256


def ref_key(ref: str | Column) -> Column:
    """A ref of 16 hexadecimal digits, not all zeros, once trimmed and lower-cased, as the bigint with the same bits;
    anything else is null and links nothing."""
    # outer white space of any kind, as str.strip removes it
    text = F.lower(F.regexp_replace(ref, r"^[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$", ""))
    half = lambda a: F.conv(F.substring(text, a, 8), 16, 10).cast("bigint")
    valid = text.rlike("^[0-9a-f]{16}$") & (text != "0" * 16)
    return F.when(valid, F.shiftleft(half(1), 32).bitwiseOR(half(9)))


def linked_groups(rows: DataFrame, item: str, left_ref: str, right_ref: str, keep: list[str] | None = None) -> DataFrame:
    """rows with the column group_id: the smallest item of all rows that share a left or right ref, directly or through
    other rows. Rows with the same item count once, a row without valid refs is its own group, null items are left out."""
    keep = keep or []
    base = records(rows, [item], [left_ref, right_ref, *[k for k in keep if k not in (left_ref, right_ref)]])
    base = materialize(base.withColumn("_l", ref_key(left_ref)).withColumn("_r", ref_key(right_ref)))
    found = components(base.select("_l", "_r"), "_l", "_r")
    # every row hangs on its left ref, or on its right ref where it has no left one
    via_right = base.select("_l", "_r").dropna().distinct().join(found, F.col("_l") == F.col("node"))
    via_right = via_right.groupBy(F.col("_r").alias("_right")).agg(F.min("component").alias("_c2"))
    at = base.join(found.select(F.col("node").alias("_l"), F.col("component").alias("_c1")), "_l", "left")
    # rows with only a right ref: a right ref that no left ref touches is a group by itself
    at = at.join(via_right, at["_r"] == via_right["_right"], "left")
    label = (
        F.when(F.col("_c1").isNotNull(), F.concat(F.lit("c"), F.col("_c1").cast("string")))
        .when(F.col("_l").isNotNull(), F.concat(F.lit("c"), F.col("_l").cast("string")))
        .when(F.col("_c2").isNotNull(), F.concat(F.lit("c"), F.col("_c2").cast("string")))
        .when(F.col("_r").isNotNull(), F.concat(F.lit("r"), F.col("_r").cast("string")))
        .otherwise(F.concat(F.lit("i"), F.col(item).cast("string")))
    )
    at = at.withColumn("_label", label).select(item, left_ref, right_ref, *keep, "_label")
    least = at.groupBy("_label").agg(F.min(item).alias("group_id"))
    return at.join(least, "_label").select(item, "group_id", *keep)


def clean_split(column: str | Column) -> Column:
    """train, val or test once trimmed and lower-cased; blank is null."""
    text = F.lower(F.regexp_replace(column, r"^\s+|\s+$", ""))
    return F.when(text != "", text)


def _deal(rows_of: np.ndarray, owed: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Which part of the small groups of each main stratum each split gets, so that the rows of every stratum come near
    what the splits still need: least squares over parts that are not negative and add up to one."""
    weight = 1 / np.sqrt(np.maximum(1, rows_of.sum(axis=0)))
    a, b = (rows_of * weight).T, owed * weight[:, None]
    part = np.full((rows_of.shape[0], owed.shape[1]), 1 / max(1, owed.shape[1]))
    step = 1 / max(1e-9, float(np.linalg.norm(a, 2)) ** 2) if a.size else 0.0
    for _ in range(rounds if a.size else 0):
        part -= step * (a.T @ (a @ part - b))
        top = -np.sort(-part, axis=1)  # onto the simplex
        over = (np.cumsum(top, axis=1) - 1) / np.arange(1, part.shape[1] + 1)
        k = (top > over).sum(axis=1)
        part = np.maximum(0, part - over[np.arange(len(part)), k - 1][:, None])
    return part


def assign_splits(
    groups: DataFrame,
    group: str,
    stratum: Column,
    shares: dict[str, float] | None = None,
    large: float = 0.001,
    cells: int = 4096,
) -> DataFrame:
    """(group, rows, split): every group gets one split, the rows near the given shares and each stratum (label kind)
    spread alike over the splits.

    Groups with more than `large` of all rows (never more than 1/large of them, so they fit the driver) are placed
    greedily, largest first, where the squared deviation of stratum counts from the target is least. The others are
    ordered by hash in their main stratum and cut at the shares of what the large ones left, by prefix sums: over at
    most `cells` hash cells a stratum first, then inside each cell, so no task ever sorts a whole stratum. The MAX_STRATA - 1
    largest strata are balanced each by itself, all others together as one, so what reaches the driver (MAX_STRATA squared
    numbers) doesn't grow with the labels; no row is left out.
    """
    shares = shares or {"train": 0.70, "val": 0.15, "test": 0.15}
    rows = groups.select(F.col(group).alias("_g"), F.coalesce(stratum.cast("string"), F.lit("")).alias("_s")).where(F.col("_g").isNotNull())
    kinds = rows.groupBy("_s").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "_s").limit(MAX_STRATA + 1).collect()
    if len(kinds) > MAX_STRATA:
        rows = rows.withColumn("_s", F.when(F.col("_s").isin([r[0] for r in kinds[: MAX_STRATA - 1]]), F.col("_s")).otherwise(F.lit("\x00rare")))
    counts = rows.groupBy("_g", "_s").agg(F.count("*").alias("n"))
    per = counts.groupBy("_g").agg(
        F.sum("n").alias("n"), F.max_by("_s", F.struct("n", "_s")).alias("_s"), F.collect_list(F.struct("_s", "n")).alias("parts")
    )
    per = materialize(per)
    total = per.agg(F.sum("n")).first()[0] or 0
    strata = {r[0]: r[1] for r in counts.groupBy("_s").agg(F.sum("n")).collect()}  # at most MAX_STRATA
    names = list(shares)
    big = per.where(F.col("n") > large * total).orderBy(F.desc("n"), "_g").collect()
    held = {s: dict.fromkeys(strata, 0) for s in names}
    placed: list[tuple[str, str]] = []
    for g in big:
        def cost(s: str, parts=g["parts"]) -> float:
            change = 0.0
            for p in parts:
                goal, have = shares[s] * strata[p["_s"]], held[s][p["_s"]]
                change += ((have + p["n"] - goal) ** 2 - (have - goal) ** 2) / max(1.0, strata[p["_s"]])
            return change / shares[s]

        best = min(names, key=lambda s: (cost(s), names.index(s)))
        for p in g["parts"]:
            held[best][p["_s"]] += p["n"]
        placed.append((g["_g"], best))
    spark = groups.sparkSession
    fixed = spark.createDataFrame(placed, f"_g {dict(per.dtypes)['_g']}, _split string")
    # small groups are dealt by their main stratum but hold rows of others, too: strata times strata numbers tell how much
    mixed = per.where(F.col("n") <= large * total).select(F.col("_s").alias("main"), F.explode("parts").alias("p"))
    mixed = mixed.groupBy("main", F.col("p._s").alias("s")).agg(F.sum("p.n").alias("n")).collect()
    kinds = sorted(strata)
    rows_of = np.zeros((len(kinds), len(kinds)))
    for r in mixed:
        rows_of[kinds.index(r["main"]), kinds.index(r["s"])] = r["n"]
    owed = np.array([[shares[x] * strata[k] - held[x][k] for x in names] for k in kinds]) if kinds else np.zeros((0, len(names)))
    part = _deal(rows_of, owed)
    upto = np.cumsum(part, axis=1)
    cuts = [(k, x, float(upto[i, j] - part[i, j]), 2.0 if j == len(names) - 1 else float(upto[i, j])) for i, k in enumerate(kinds) for j, x in enumerate(names)]
    plan = spark.createDataFrame(cuts, "_s string, _split string, low double, high double")
    small = per.join(F.broadcast(fixed), "_g", "left_anti").withColumn("cell", F.pmod(F.xxhash64("_g"), F.lit(cells)))
    cell = small.groupBy("_s", "cell").agg(F.sum("n").alias("m"))
    along = Window.partitionBy("_s").orderBy("cell")
    cell = cell.withColumn("before", F.coalesce(F.sum("m").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cell = cell.withColumn("whole", F.sum("m").over(Window.partitionBy("_s"))).drop("m")
    inside = Window.partitionBy("_s", "cell").orderBy(F.xxhash64("_g", F.lit(1)), "_g")
    small = small.withColumn("here", F.sum("n").over(inside) - F.col("n") / 2)
    at = small.join(cell, ["_s", "cell"]).withColumn("u", (F.col("before") + F.col("here")) / F.col("whole"))
    at = at.join(F.broadcast(plan), "_s").where((F.col("u") >= F.col("low")) & (F.col("u") < F.col("high")))
    chosen = fixed.join(per.select("_g", "n"), "_g").unionByName(at.select("_g", "_split", "n"))
    return chosen.select(F.col("_g").alias(group), F.col("n").alias("rows"), F.col("_split").alias("split"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "training_labels")
    rows = rows.select("id", "external_resume_ref", "external_job_ref", "label", "label_source", clean_split("dataset_split").alias("split"))
    return linked_groups(rows, "id", "external_resume_ref", "external_job_ref", ["label", "label_source", "split"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(_labels(spark, sf_dir).select("id", "group_id", "split"))
    torn = rows.groupBy("group_id").agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a < b").select("group_id")
    return rows.join(torn, "group_id").select("group_id", F.col("id").alias("label_id"))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked groups by size."""
    sizes = _labels(spark, sf_dir).groupBy("group_id").agg(F.count("*").alias("labels"))
    return sizes.groupBy("labels").agg(F.count("*").alias("groups"), F.min("group_id").alias("first_group"))


def p2_assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New split of every label row."""
    rows = materialize(_labels(spark, sf_dir))
    stratum = F.concat_ws("|", "label_source", F.col("label").cast("string"))
    splits = assign_splits(rows, "group_id", stratum)
    return rows.select("id", "group_id").join(splits.select("group_id", "split"), "group_id").select(F.col("id").alias("label_id"), "group_id", "split")


_FOUND_SQL = """
with recursive x as (select id, any_value(lower(regexp_replace(external_resume_ref, '^\\s+|\\s+$', '', 'g'))) r,
    any_value(lower(regexp_replace(external_job_ref, '^\\s+|\\s+$', '', 'g'))) j,
    any_value(nullif(lower(regexp_replace(dataset_split, '^\\s+|\\s+$', '', 'g')), '')) s from training_labels group by id),
y as (select id, s, case when regexp_full_match(r, '[0-9a-f]{16}') and r <> '0000000000000000' then 'r' || r end r,
    case when regexp_full_match(j, '[0-9a-f]{16}') and j <> '0000000000000000' then 'j' || j end j from x),
e as (select id, unnest([r, j]) k from y), f as (select * from e where k is not null),
n as (select distinct a.id a, b.id b from f a join f b on a.k = b.k),
c(a, b) as (select a, b from n union select c.a, n.b from c join n on c.b = n.a),
g as (select a id, min(b) group_id from c group by a),
t as (select group_id from g join y using (id) group by group_id having count(distinct s) > 1)
select group_id, id as label_id from g join t using (group_id)
"""

_GROUPS_SQL = (
    _FOUND_SQL[: _FOUND_SQL.index("t as (select")].rstrip().rstrip(",")
    + """, w as (select y.id, coalesce(g.group_id, y.id) group_id from y left join g on g.id = y.id), z as (select group_id, count(*) labels from w group by group_id)
select labels, count(*) as groups, min(group_id) as first_group from z group by labels"""
)
QUERIES = {"p2_found": p2_found, "p2_assigned": p2_assigned, "p2_groups": p2_groups}
ORACLE = {"p2_found": _FOUND_SQL, "p2_groups": _GROUPS_SQL}
