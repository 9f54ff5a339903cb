"""Problem 7: items over a size limit are cut into overlapping pieces at natural boundaries, by byte range."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.llm.common import records
from loomwork.session import drop_path, materialize, temporary_path
from loomwork.tables import load

#: Strength of a cut after a character: space < sentence end < line break < blank line.
SPACE, SENTENCE, LINE, PARAGRAPH = 1, 2, 3, 4
_RANGE_SCHEMA = """kind string, id string, range_no long, chars long, first_gap long, last_gap long, longest long,
    pieces array<struct<start: long, stop: long, text: string>>"""


def cut_strengths(points: np.ndarray) -> np.ndarray:
    """For each code point the strength of a cut right behind it, 0 where none is natural."""
    newline = (points == 10) | (points == 13)
    blank = newline | (points == 32) | (points == 9)
    before = np.concatenate(([0], points[:-1]))
    ends = np.isin(before, (46, 33, 63, 0x3002, 0xFF01, 0xFF1F))  # . ! ? and their wide forms
    strength = blank.astype(np.int8)
    strength[blank & ends] = SENTENCE
    wide = np.isin(points, (0x3002, 0xFF01, 0xFF1F))  # wide marks end a sentence without a space behind them
    strength[wide] = SENTENCE
    strength[newline] = LINE
    # a line break whose previous break has only blanks between
    solid = np.where(~blank, np.arange(len(points)), -1)
    last_solid = np.maximum.accumulate(solid) if len(points) else solid
    at = np.flatnonzero(newline)
    if len(at) > 1:
        again = np.concatenate(([False], last_solid[at[1:]] < at[:-1]))
        pair = np.concatenate(([False], (points[at[1:]] == 10) & (points[at[:-1]] == 13) & (np.diff(at) == 1)))
        strength[at[again & ~pair]] = PARAGRAPH
    return strength


def chain(strength: np.ndarray, start: int, stop: int, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces [a, b) that cover start..stop: each at most limit long, each but the first starting overlap before the
    end of the one before. A cut falls behind the strongest boundary in the second half of the room, the last such."""
    pieces, a = [], start
    while stop - a > limit:
        low = max(a + limit // 2, a + overlap + 1)
        room = strength[low - 1 : a + limit]  # a cut at b is judged by the character b - 1
        best = int(room.max()) if len(room) else 0
        b = low + int(np.flatnonzero(room == best)[-1]) if best else a + limit
        pieces.append((a, b))
        a = b - overlap
    pieces.append((a, stop))
    return pieces


def _anchor(strength: np.ndarray, origin: int, limit: int) -> int:
    """Where the chain that belongs to a range starts: behind the first line end, else the first boundary, within half
    a limit of the range's origin; else at the origin. Both neighbours compute it from the same characters."""
    near = strength[origin : origin + limit // 2]
    for least in (LINE, SPACE):
        found = np.flatnonzero(near >= least)
        if len(found):
            return origin + int(found[0]) + 1
    return origin


def cut_range(data: bytes, lead: int, own: int, last: bool, limit: int, overlap: int) -> tuple | None:
    """data: the bytes of one range of `own` bytes with a halo, `lead` bytes of it before the range. Returns the code
    points that start in the range, the gap before its first and behind its last blank, its longest unbroken stretch
    and its pieces, positions counted from the range's first code point."""
    raw = np.frombuffer(data, np.uint8)
    starts = np.flatnonzero((raw & 0xC0) != 0x80)
    if not len(starts):
        return None
    text = data[starts[0] :].decode("utf-8", "ignore")
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    starts = starts[: len(points)]
    first, stop = int(np.searchsorted(starts, lead)), int(np.searchsorted(starts, lead + own))
    strength = cut_strengths(points)
    blank = np.isin(points[first:stop], (32, 9, 10, 13))
    at = np.flatnonzero(blank)
    n = stop - first
    if len(at):
        gaps = (int(at[0]), n - 1 - int(at[-1]), int(max(np.diff(at).max() - 1, 0)) if len(at) > 1 else 0)
    else:
        gaps = (-1, -1, n)
    begin = first if lead == 0 else _anchor(strength, first, limit)
    end = len(points) if last else _anchor(strength, stop, limit)
    if last:
        end = stop
    if begin >= end:
        return n, *gaps, []
    # consecutive chains overlap as consecutive pieces do: a later chain starts in the last piece of the one before
    start = begin - overlap if lead else begin
    return n, *gaps, [(a - first, b - first, text[a:b]) for a, b in chain(strength, start, end, limit, overlap)]


def _cut_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for row in pdf.itertuples(index=False):
            got = cut_range(bytes(row.data), row.lead, row.own, row.last, row.size_limit, row.overlap)
            if got is None:
                got = (0, -1, -1, 0, [])
            n, a, b, longest, pieces = got
            out.append((row.kind, row.id, row.range_no, n, a, b, longest, [{"start": x, "stop": y, "text": t} for x, y, t in pieces]))
        yield pd.DataFrame(out, columns=["kind", "id", "range_no", "chars", "first_gap", "last_gap", "longest", "pieces"])


def ranges_of(items: DataFrame, range_bytes: int = 1 << 18) -> DataFrame:
    """items(kind, id, text, size_limit, overlap) as rows of byte ranges, each with a halo of four limits at both
    sides (at most 4 bytes a character), so no worker ever holds more of an item."""
    halo = F.col("size_limit") * F.lit(4)
    size = F.octet_length("data")
    own = F.greatest(F.lit(range_bytes), F.col("size_limit") * F.lit(16))
    rows = items.select("kind", "id", "size_limit", "overlap", F.encode("text", "UTF-8").alias("data"))
    rows = rows.withColumn("range_no", F.explode(F.sequence(F.lit(0), ((size - 1) / own).cast("int"))))
    begin = F.col("range_no") * own
    lead = F.least(begin, halo)
    stop = F.least(begin + own, size)
    return rows.select(
        "kind",
        "id",
        "size_limit",
        "overlap",
        F.col("range_no").cast("long").alias("range_no"),
        F.substring(F.col("data"), (begin - lead + 1).cast("int"), (lead + (stop - begin) + halo).cast("int")).alias("data"),
        lead.cast("int").alias("lead"),
        (stop - begin).cast("int").alias("own"),
        (stop == size).alias("last"),
    )


def files_below(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """(URI, bytes) of the data files in a folder of any file system Hadoop knows."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [(s.getPath().toUri().toString(), s.getLen()) for s in system.listStatus(where) if s.isFile()]
    return sorted(f for f in found if not f[0].rsplit("/", 1)[1].startswith(("_", ".")))


def ranges_of_files(spark: SparkSession, files: list[tuple[str, int]], limit: int, range_bytes: int = 1 << 22) -> DataFrame:
    """The same for UTF-8 files of (URI or path, bytes): each task opens its file through Arrow's file systems (local,
    HDFS, object stores), and reads its range and the halo only."""
    own, halo = max(range_bytes, 16 * limit), 4 * limit
    plan = spark.createDataFrame(files, "id string, size long").withColumn(
        "range_no", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / own)))
    )

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                begin, stop = r.range_no * own, min(r.range_no * own + own, r.size)
                lead = min(begin, halo)
                system, path = fs.FileSystem.from_uri(r.id) if ":/" in r.id else (fs.LocalFileSystem(), r.id)
                with system.open_input_file(path) as f:
                    data = f.read_at(lead + (stop - begin) + halo, begin - lead)
                row = ("file", r.id, limit, limit // 10, r.range_no, data, lead, stop - begin, stop == r.size)
                yield pd.DataFrame([row], columns=["kind", "id", "size_limit", "overlap", "range_no", "data", "lead", "own", "last"])

    schema = "kind string, id string, size_limit int, overlap int, range_no long, data binary, lead int, own int, last boolean"
    return plan.where("size > 0").repartition(F.col("id"), F.col("range_no")).mapInPandas(read, schema)


def split_ranges(ranges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From byte ranges: (pieces, items).

    pieces(kind, id, piece_index, start, stop, text): numbered from 0, positions in code points of the item, each at
    most its limit long. items(kind, id, chars, longest): code points and the longest stretch without space, tab or
    line break. The boundary tables of the ranges are stitched by windows over a few numbers a range; texts move once.
    """
    work = ranges.mapInPandas(_cut_batches, _RANGE_SCHEMA)
    work = materialize(work)  # both results read it; its texts are cut once
    order = Window.partitionBy("kind", "id").orderBy("range_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    table = work.select("kind", "id", "range_no", "chars", "first_gap", "last_gap", "longest", F.size("pieces").alias("n"))
    stitched = (
        table.withColumn("base", F.coalesce(F.sum("chars").over(before), F.lit(0)))
        .withColumn("piece_base", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("last_blank", F.when(F.col("last_gap") >= 0, F.col("base") + F.col("chars") - 1 - F.col("last_gap")))
        .withColumn("open_since", F.coalesce(F.max("last_blank").over(before) + 1, F.lit(0)))
    )
    here = F.when(F.col("first_gap") >= 0, F.col("base") + F.col("first_gap")).otherwise(F.col("base") + F.col("chars"))
    tail = F.col("base") + F.col("chars") - F.coalesce(F.col("last_blank") + 1, F.col("open_since"))
    items = stitched.groupBy("kind", "id").agg(
        F.sum("chars").alias("chars"),
        F.max(F.greatest("longest", here - F.col("open_since"), tail)).alias("longest"),
    )
    bases = stitched.select("kind", "id", "range_no", "base", "piece_base")
    pieces = (
        work.select("kind", "id", "range_no", F.posexplode("pieces").alias("k", "piece"))
        .join(bases, ["kind", "id", "range_no"])
        .select(
            "kind",
            "id",
            (F.col("piece_base") + F.col("k")).alias("piece_index"),
            (F.col("base") + F.col("piece.start")).alias("start"),
            (F.col("base") + F.col("piece.stop")).alias("stop"),
            F.col("piece.text").alias("text"),
        )
    )
    return pieces, items


def split_items(items: DataFrame, range_bytes: int = 1 << 18) -> tuple[DataFrame, DataFrame]:
    """items(kind, id, text, size_limit, overlap); see split_ranges. Items within their limit, with null text or null
    id are left out; rows with the same kind and id count once."""
    big = items.where(F.octet_length("text") > F.col("size_limit"))  # no fewer bytes than characters
    big = big.where(F.length("text") > F.col("size_limit"))
    return split_ranges(ranges_of(records(big, ["kind", "id"], ["text", "size_limit", "overlap"]), range_bytes))


def _items(spark: SparkSession, sf_dir: str, resume_limit: int = 3000, chunk_limit: int = 400) -> DataFrame:
    def part(table: str, text: str, kind: str, limit: int) -> DataFrame:
        return load(spark, sf_dir, table).select(
            F.lit(kind).alias("kind"), "id", F.col(text).alias("text"), F.lit(limit).alias("size_limit"), F.lit(limit // 10).alias("overlap")
        )

    return part("resumes", "raw_text", "resume", resume_limit).unionByName(part("text_embeddings", "chunk_text", "chunk", chunk_limit))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, items = split_items(_items(spark, sf_dir))
    limit = F.when(F.col("kind") == "resume", 3000).otherwise(400)
    cases = F.array(F.when(F.col("chars") > limit, F.lit("oversize")), F.when(F.col("longest") > limit, F.lit("unbroken")))
    rows = items.select(F.col("kind").alias("item_kind"), F.col("id").alias("item_id"), F.explode(cases).alias("case_kind"))
    return rows.where(F.col("case_kind").isNotNull())


def p7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece with its text."""
    pieces, _ = split_items(_items(spark, sf_dir))
    return pieces.withColumnsRenamed({"kind": "item_kind", "id": "item_id", "text": "piece"})


def p7_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each item that is cut: its code points, where its pieces end, whether every piece keeps to the limit and whether each
    but the first starts a tenth of the limit before the end of the one before."""
    pieces, items = split_items(_items(spark, sf_dir))
    limit = F.when(F.col("kind") == "resume", 3000).otherwise(400)
    order = Window.partitionBy("kind", "id").orderBy("piece_index")
    rows = pieces.withColumn("before", F.lag("stop").over(order))
    fits = (F.length("text") <= limit) & (F.length("text") == F.col("stop") - F.col("start"))
    joins = F.when(F.col("piece_index") == 0, F.col("start") == 0).otherwise(F.col("before") - F.col("start") == limit / 10)
    per = rows.groupBy("kind", "id").agg(F.max("stop").alias("covered"), F.bool_and(fits).alias("fits"), F.bool_and(joins).alias("joins"))
    return items.join(per, ["kind", "id"]).select(F.col("kind").alias("item_kind"), F.col("id").alias("item_id"), "chars", "covered", "fits", "joins")


def p7_files(spark: SparkSession, sf_dir: str, limit: int = 3000, range_bytes: int = 1 << 20) -> DataFrame:
    """Giant files: the resumes written as text files into the shared folder, cut by byte range without loading a file.
    Every file is one item; start and stop are code points in it."""
    folder = temporary_path(spark, "files")
    load(spark, sf_dir, "resumes").select(F.col("raw_text").alias("value")).where("value is not null").write.text(folder)
    files = files_below(spark, folder)
    if not any(n for _, n in files):
        return spark.createDataFrame([], "file string, piece_index long, start long, stop long, piece string")
    pieces, _ = split_ranges(ranges_of_files(spark, files, limit, range_bytes))
    drop_path(spark, folder)  # the pieces are written
    return pieces.select(F.element_at(F.split("id", "/"), -1).alias("file"), "piece_index", "start", "stop", F.col("text").alias("piece"))


_ITEMS_SQL = """
with t as (select distinct 'resume' item_kind, id item_id, raw_text x, 3000 lim from resumes
           union all select distinct 'chunk', id, chunk_text, 400 from text_embeddings),
o as (select * from t where length(x) > lim),
w as (select item_kind, item_id, lim, unnest(regexp_extract_all(x, '[^ \\t\\n\\r]+')) run from o),
m as (select item_kind, item_id, max(length(run)) longest, any_value(lim) lim from w group by item_kind, item_id)
"""

QUERIES = {"p7_found": p7_found, "p7_pieces": p7_pieces, "p7_coverage": p7_coverage, "p7_files": p7_files}
ORACLE = {
    "p7_coverage": _ITEMS_SQL + "select item_kind, item_id, length(x) as chars, length(x) as covered, true as fits, true as joins from o",
    "p7_found": _ITEMS_SQL
    + """select item_kind, item_id, 'oversize' as case_kind from o
         union all select item_kind, item_id, 'unbroken' from m where longest > lim"""
}
