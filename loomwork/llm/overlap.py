"""Problem 1: the same or nearly the same records on both sides of a split."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.llm.common import WordHashes, shingle_hashes, words
from loomwork.llm.groups import clean_split
from loomwork.session import materialize
from loomwork.tables import load

#: 40 bands of 4 rows: a pair at Jaccard 0.7 is missed with (1 - 0.7^4)^40, less than 2 in 100,000.
BANDS, ROWS = 40, 4
#: The classes of a bucket with more train x evaluation pairs than this are compared by their rarest shingles instead.
LIGHT_PAIRS = 20_000
#: Rows up to which a list of bucket numbers or ids is broadcast, which is checked; some 60 bytes each.
MAX_BROADCAST_ROWS = 500_000
#: Train members that meet the held-out members of a class in one task.
PAIR_BLOCK = 5_000
_RNG = np.random.default_rng(20240607)
_A = _RNG.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """Signature of BANDS * ROWS minima (upper 32 bits of multiply-add hashes)."""
    out = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 4096):  # very long texts in steps of bounded memory
            mixed = (shingles[at : at + 4096, None] * _A + _B) >> np.uint64(32)
            np.minimum(out, mixed.min(axis=0).astype(np.uint32), out=out)
    return out


def band_keys(kind: str, shingles: np.ndarray) -> np.ndarray:
    """A number for each band of the signature; equal numbers share a bucket."""
    raw = minhash(shingles).tobytes()
    width = ROWS * 4
    return np.array([xxhash.xxh3_64_intdigest(raw[b * width : (b + 1) * width] + kind.encode(), seed=b) - 2**63 for b in range(BANDS)], np.int64)


def _shingles(text: str, shingle: int, least_words: int, seen: WordHashes) -> np.ndarray | None:
    tokens = words(text)
    if len(tokens) < max(least_words, shingle):
        return None
    return np.unique(shingle_hashes(seen.array(tokens), shingle))


def _sign(shingle: int, least_words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = WordHashes()
        for pdf in batches:
            out = []
            for kind, key, text in zip(pdf["kind"], pdf["id"], pdf["text"], strict=True):
                sh = _shingles(text, shingle, least_words, seen)
                if sh is not None:
                    out.append((kind, key, xxhash.xxh3_128_digest(kind.encode() + sh.tobytes()), band_keys(kind, sh)))
            yield pd.DataFrame(out, columns=["kind", "id", "cls", "bands"])

    return run


def _sets(shingle: int, least_words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = WordHashes()
        for pdf in batches:
            out = []
            for kind, key, text in zip(pdf["kind"], pdf["id"], pdf["text"], strict=True):
                sh = _shingles(text, shingle, least_words, seen)
                if sh is not None:
                    digest = xxhash.xxh3_128_digest(kind.encode() + sh.tobytes())
                    out.append((kind, key, digest, sh.view(np.int64)))
            yield pd.DataFrame(out, columns=["kind", "id", "cls", "shingles"])

    return run


def _few(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it is small."""
    return F.broadcast(df) if df.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS else df


def class_links(classes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], threshold: float) -> DataFrame:
    """classes(kind, cls, rep, bands, in_train, in_held), one row a class of equal shingle sets; sets_of gives
    (kind, cls, shingles) of the classes it gets. Returns (kind, ca, cb) for every two different classes of one kind, ca in
    train and cb held out, whose exact Jaccard similarity reaches the threshold.

    Candidates share a MinHash band. Only numbers move: a bucket's number and eight bytes of a class. Buckets without both
    sides end there; a light one's pairs come from an equi-join. The classes of heavy ones go through a second, exact way:
    two sets that reach the threshold share one of their rarest shingles, (1 - threshold) of the set and one more, so sets
    meet by those. Frequent shingles, which make buckets heavy, join nothing, and nothing is capped. Shingle sets are built
    again from the texts of the candidates alone.
    """
    short = F.conv(F.hex(F.substring("cls", 1, 7)), 16, 10).cast("bigint").alias("c")
    side = (F.col("in_train").cast("int") + 2 * F.col("in_held").cast("int")).cast("tinyint").alias("side")
    bands = classes.select(short, side, F.explode("bands").alias("bucket"))
    train, held = F.col("side") % 2 == 1, F.col("side") >= 2
    sizes = bands.groupBy("bucket").agg(F.count_if(train).alias("nt"), F.count_if(held).alias("nh"), F.count("*").alias("n"))
    sizes = materialize(sizes.where("nt > 0 and nh > 0 and n > 1").select("bucket", (F.col("nt") * F.col("nh") <= LIGHT_PAIRS).alias("light")))
    shared = materialize(bands.join(_few(sizes), "bucket"))
    a = shared.where(train & F.col("light")).select("bucket", F.col("c").alias("xa"))
    b = shared.where(held & F.col("light")).select("bucket", F.col("c").alias("xb"))
    pairs = a.join(b, "bucket").where("xa <> xb").select("xa", "xb").distinct()
    heavy = shared.where(~F.col("light")).select("c").distinct()
    named = classes.select("kind", "cls", "rep", short, side)
    if not heavy.isEmpty():
        dense = materialize(sets_of(named.join(heavy, "c", "left_semi")).join(named.select("kind", "cls", "c", "side"), ["kind", "cls"]))
        pairs = pairs.unionByName(_by_rare_shingles(dense, threshold)).distinct()
    pairs = materialize(pairs)
    ends = pairs.select(F.explode(F.array("xa", "xb")).alias("c")).distinct()
    sets = materialize(sets_of(named.join(_few(materialize(ends)), "c", "left_semi")))
    full = sets.withColumn("c", short)
    return (
        pairs.join(full.select(F.col("c").alias("xa"), F.col("cls").alias("ca"), F.col("shingles").alias("sa"), "kind"), "xa")
        .join(full.select("kind", F.col("c").alias("xb"), F.col("cls").alias("cb"), F.col("shingles").alias("sb")), ["kind", "xb"])
        # sizes alone rule out most: the smaller set must be at least threshold times the larger
        .where(F.least(F.size("sa"), F.size("sb")) >= F.lit(threshold) * F.greatest(F.size("sa"), F.size("sb")))
        .withColumn("shared", F.size(F.array_intersect("sa", "sb")))
        .where((F.col("shared") >= F.lit(threshold) * (F.size("sa") + F.size("sb") - F.col("shared")) - 1e-9) & (F.col("ca") != F.col("cb")))
        .select("kind", "ca", "cb")
        .distinct()
    )


def _by_rare_shingles(dense: DataFrame, threshold: float) -> DataFrame:
    """(xa, xb) of the classes of dense(kind, c, side, shingles), xa in train and xb held out, that share one of their rarest
    shingles; all that reach the threshold do."""
    rows = dense.select("kind", "c", "side", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    often = rows.groupBy("kind", "s").agg(F.count("*").alias("df"))
    order = Window.partitionBy("kind", "c").orderBy("df", "s")
    rare = rows.join(often, ["kind", "s"]).withColumn("k", F.row_number().over(order))
    rare = materialize(rare.where(F.col("k") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1).select("kind", "s", "c", "side"))
    a, b = rare.where(F.col("side") % 2 == 1), rare.where(F.col("side") >= 2)
    both = a.select("kind", "s", F.col("c").alias("xa")).join(b.select("kind", "s", F.col("c").alias("xb")), ["kind", "s"])
    return both.where("xa <> xb").select("xa", "xb").distinct()


def record_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, id, in_train, in_held) of every resume and job that label rows name with a split."""
    rows = load(spark, sf_dir, "training_labels").select("resume_id", "job_id", clean_split("dataset_split").alias("s"))
    rows = rows.where(F.col("s").isin("train", "val", "test"))
    long = rows.select("s", F.explode(F.array(F.struct(F.lit("resume").alias("kind"), F.col("resume_id").alias("id")), F.struct(F.lit("job").alias("kind"), F.col("job_id").alias("id")))).alias("r"))
    long = long.select("r.kind", "r.id", "s").where("id is not null")
    return long.groupBy("kind", "id").agg(F.max(F.col("s") == "train").alias("in_train"), F.max(F.col("s") != "train").alias("in_held"))


def overlaps(texts: DataFrame, splits: DataFrame, shingle: int = 3, threshold: float = 0.7, least_words: int = 20) -> tuple[DataFrame, DataFrame]:
    """texts(kind, id, text), splits(kind, id, in_train, in_held) -> (members, links).

    members(kind, id, cls, in_train, in_held): records whose sets of word shingles are equal share a class. links(kind, ca,
    cb): two classes, the same or different, one with a train record, the other with a held-out one, whose Jaccard
    similarity is at least the threshold. Texts that are null, empty or have fewer than least_words words, and records
    without a split, are in neither; rows with the same id count once (that of the smallest class).

    Texts are read where they lie, and only signatures of some hundred bytes move.
    """
    texts = texts.select("kind", "id", "text").where("kind is not null and id is not null and text is not null")
    signed = materialize(texts.mapInPandas(_sign(shingle, least_words), "kind string, id string, cls binary, bands array<bigint>"))
    once = signed.groupBy("kind", "id").agg(F.min("cls").alias("cls"))
    members = materialize(once.join(splits, ["kind", "id"]).where("in_train or in_held"))
    flags = members.groupBy("kind", "cls").agg(F.min("id").alias("rep"), F.max("in_train").alias("in_train"), F.max("in_held").alias("in_held"))
    own = signed.select("kind", F.col("id").alias("rep"), "cls", "bands").dropDuplicates(["kind", "rep", "cls"])
    classes = materialize(flags.join(own, ["kind", "rep", "cls"]))

    def sets_of(some: DataFrame) -> DataFrame:
        asked = _few(materialize(some.select("kind", F.col("rep").alias("id"), F.col("cls").alias("_c"))))
        found = texts.join(asked, ["kind", "id"], "left_semi").mapInPandas(_sets(shingle, least_words), "kind string, id string, cls binary, shingles array<bigint>")
        return found.join(asked, ["kind", "id"]).where("cls = _c").select("kind", "cls", "shingles").dropDuplicates(["kind", "cls"])

    near = class_links(classes, sets_of, threshold)
    counts = members.groupBy("kind", "cls").agg(F.count("*").alias("n"), F.max("in_train").alias("t"), F.max("in_held").alias("h"))
    same = counts.where("n > 1 and t and h").select("kind", F.col("cls").alias("ca"), F.col("cls").alias("cb"))
    return members, materialize(near.unionByName(same))


def cross_split_pairs(texts: DataFrame, splits: DataFrame, shingle: int = 3, threshold: float = 0.7, least_words: int = 20) -> DataFrame:
    """(kind, id_a, id_b), id_a < id_b: two records of one kind, one in train, the other held out, that overlap; see
    overlaps(). A record in both parts pairs with either side but never with itself.

    The members of linked classes are paired in blocks: the train members that meet a class are dealt to as many tasks as
    PAIR_BLOCK asks for, so a text with many copies on both sides is no single task's work.
    """
    members, links = overlaps(texts, splits, shingle, threshold, least_words)
    train = members.where("in_train").select("kind", F.col("cls").alias("ca"), F.col("id").alias("t"))
    held = members.where("in_held").select("kind", F.col("cls").alias("cb"), F.col("id").alias("h"))
    met = links.join(train.groupBy("kind", "ca").agg(F.count("*").alias("n")), ["kind", "ca"]).groupBy("kind", "cb").agg(F.ceil(F.sum("n") / PAIR_BLOCK).cast("int").alias("parts"))
    met = materialize(met)
    left = links.join(train, ["kind", "ca"]).join(met, ["kind", "cb"]).withColumn("part", F.pmod(F.xxhash64("t"), F.col("parts")).cast("int"))
    right = held.join(met, ["kind", "cb"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    both = left.select("kind", "cb", "part", "t").join(right.select("kind", "cb", "part", "h"), ["kind", "cb", "part"]).where("t <> h")
    return both.select("kind", F.least("t", "h").alias("id_a"), F.greatest("t", "h").alias("id_b")).distinct()


def overlapping_records(texts: DataFrame, splits: DataFrame, shingle: int = 3, threshold: float = 0.7, least_words: int = 20) -> DataFrame:
    """(kind, id) of the records in some pair of cross_split_pairs, told from classes alone: no pair is built."""
    members, links = overlaps(texts, splits, shingle, threshold, least_words)
    counts = members.groupBy("kind", "cls").agg(F.count_if("in_train").alias("nt"), F.count_if("in_held").alias("nh"))
    far = links.where("ca <> cb")
    as_train = far.select("kind", F.col("ca").alias("cls"), F.lit(True).alias("lt")).distinct()
    as_held = far.select("kind", F.col("cb").alias("cls"), F.lit(True).alias("lh")).distinct()
    rows = members.join(counts, ["kind", "cls"]).join(as_train, ["kind", "cls"], "left").join(as_held, ["kind", "cls"], "left")
    others = lambda n, own: F.col(n) - F.col(own).cast("int") > 0
    hit = (F.col("in_train") & (F.col("lt").isNotNull() | others("nh", "in_held"))) | (F.col("in_held") & (F.col("lh").isNotNull() | others("nt", "in_train")))
    return rows.where(hit).select("kind", "id")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    resumes = load(spark, sf_dir, "resumes").select(F.lit("resume").alias("kind"), "id", F.col("raw_text").alias("text"))
    jobs = load(spark, sf_dir, "jobs").select(F.lit("job").alias("kind"), "id", F.col("raw_text").alias("text"))
    return resumes.unionByName(jobs)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = cross_split_pairs(_texts(spark, sf_dir), record_splits(spark, sf_dir))
    return pairs.withColumnRenamed("kind", "record_kind")


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping records counted per kind, dataset_split, label_source and (for jobs) jobs.source."""
    ends = overlapping_records(_texts(spark, sf_dir), record_splits(spark, sf_dir)).withColumnRenamed("kind", "record_kind")
    labels = load(spark, sf_dir, "training_labels").select("resume_id", "job_id", "label_source", clean_split("dataset_split").alias("dataset_split")).distinct()
    named = labels.select(F.lit("resume").alias("record_kind"), F.col("resume_id").alias("id"), "label_source", "dataset_split").unionByName(
        labels.select(F.lit("job").alias("record_kind"), F.col("job_id").alias("id"), "label_source", "dataset_split")
    )
    named = named.where("id is not null and dataset_split is not null").distinct()
    source = load(spark, sf_dir, "jobs").select(F.lit("job").alias("record_kind"), "id", F.col("source").alias("job_source")).dropDuplicates(["id"])
    rows = named.join(ends, ["record_kind", "id"]).join(source, ["record_kind", "id"], "left")
    return rows.groupBy("record_kind", "dataset_split", "label_source", "job_source").agg(F.countDistinct("id").alias("records"))


_PAIRS_SQL = """
with l as (select resume_id, job_id, lower(trim(dataset_split)) s from training_labels where lower(trim(dataset_split)) in ('train','val','test')),
u as (select 'resume' k, resume_id id, s from l union all select 'job', job_id, s from l),
f as (select k, id, bool_or(s = 'train') t, bool_or(s <> 'train') h from u where id is not null group by k, id),
x as (select 'resume' k, id, any_value(raw_text) x from resumes group by id union all select 'job', id, any_value(raw_text) from jobs group by id),
w as (select k, id, t, h, regexp_extract_all(lower(x), '[\\p{L}\\p{N}]+') w from x join f using (k, id) where x is not null),
g as (select k, id, t, h, list_distinct([w[i] || ' ' || w[i+1] || ' ' || w[i+2] for i in range(1, len(w) - 1)]) g from w where len(w) >= 20),
e as (select k, id, t, h, len(g) n, unnest(g) s from g),
p as (select a.k, a.id ta, b.id hb, any_value(a.n) na, any_value(b.n) nb, count(*) c from e a join e b on a.k = b.k and a.s = b.s and a.id <> b.id
      where a.t and b.h group by a.k, a.id, b.id)
select distinct k as record_kind, least(ta, hb) as id_a, greatest(ta, hb) as id_b from p where c >= 0.7 * (na + nb - c)
"""

QUERIES = {"p1_found": p1_found, "p1_report": p1_report}
_REPORT_SQL = f"""
with prs as ({_PAIRS_SQL}), ends as (select record_kind, id_a id from prs union select record_kind, id_b from prs),
lb as (select distinct resume_id, job_id, label_source, nullif(lower(trim(dataset_split)), '') dataset_split from training_labels),
nm as (select 'resume' record_kind, resume_id id, label_source, dataset_split from lb union select 'job', job_id, label_source, dataset_split from lb),
src as (select 'job' record_kind, id, any_value(source) job_source from jobs group by id)
select nm.record_kind, dataset_split, label_source, job_source, count(distinct nm.id) as records
from nm join ends on ends.record_kind = nm.record_kind and ends.id = nm.id left join src on src.record_kind = nm.record_kind and src.id = nm.id
where dataset_split is not null group by nm.record_kind, dataset_split, label_source, job_source
"""
ORACLE = {"p1_found": _PAIRS_SQL, "p1_report": _REPORT_SQL}
