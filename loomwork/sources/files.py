"""Reading uploaded documents: text, DOCX and PDF, each as lines; parsers can be exchanged."""

from __future__ import annotations

import io
import re
import signal
import threading
import xml.etree.ElementTree as ElementTree
import zipfile
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import text as T
from loomwork.sources import pdf

#: Limits of an upload, of a part of a DOCX file and of the time a parser may take.
UPLOAD_BYTES, PART_BYTES, PARSE_SECONDS = 5 << 20, 20 << 20, 10
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
Parsed = list[tuple[str, float | None, bool, str | None]]


class ParseError(ValueError):
    """A document that can't be read; its text becomes the row's error."""


def parse_text(content: bytes) -> Parsed:
    lines = [(t.strip(), None, False, None) for t in content.decode("utf-8", "replace").splitlines()]
    lines = [x for x in lines if x[0]]
    if not lines:
        raise ParseError("no text")
    return lines


def check_docx(content: bytes) -> zipfile.ZipFile:
    """The opened archive, or an error if it is damaged, has a part beyond PART_BYTES or one that declares a document
    type or entities. Anything unclear is refused."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
        for part in archive.infolist():
            if part.file_size > PART_BYTES:
                raise ParseError(f"part too large: {part.filename}")
            if part.filename.endswith((".xml", ".rels")):
                data = archive.read(part)
                if len(data) > PART_BYTES or re.search(rb"<!\s*(?:DOCTYPE|ENTITY)", data, re.I):
                    raise ParseError(f"refused part: {part.filename}")
    except (zipfile.BadZipFile, RuntimeError, OSError, NotImplementedError) as e:
        raise ParseError(f"damaged archive: {e}") from e
    return archive


def parse_docx(content: bytes) -> Parsed:
    """Paragraphs with style name, size and weight; runs without them take those of the paragraph's style."""
    archive = check_docx(content)
    try:
        body = ElementTree.fromstring(archive.read("word/document.xml"))
        styles = ElementTree.fromstring(archive.read("word/styles.xml")) if "word/styles.xml" in archive.namelist() else None
    except (KeyError, ElementTree.ParseError) as e:
        raise ParseError(f"no document part: {e}") from e
    known: dict[str, tuple[str, float | None, bool]] = {}
    for s in styles.iter(f"{_W}style") if styles is not None else ():
        name = s.find(f"{_W}name")
        known[s.get(f"{_W}styleId", "")] = (name.get(f"{_W}val", "") if name is not None else "", _size(s), _bold(s))
    out: Parsed = []
    for p in body.iter(f"{_W}p"):
        text = "".join(t.text or "" for t in p.iter(f"{_W}t")).strip()
        if not text:
            continue
        ref = p.find(f"{_W}pPr/{_W}pStyle")
        style = known.get(ref.get(f"{_W}val", ""), (ref.get(f"{_W}val", ""), None, False)) if ref is not None else (None, None, False)
        sizes = [s for r in p.iter(f"{_W}r") if (s := _size(r)) is not None]
        out.append((text, max(sizes) if sizes else style[1], any(_bold(r) for r in p.iter(f"{_W}r")) or style[2], style[0]))
    if not out:
        raise ParseError("no text")
    return out


def _size(node: ElementTree.Element) -> float | None:
    at = node.find(f"{_W}rPr/{_W}sz")
    return float(at.get(f"{_W}val", "0")) / 2 if at is not None else None


def _bold(node: ElementTree.Element) -> bool:
    at = node.find(f"{_W}rPr/{_W}b")
    return at is not None and at.get(f"{_W}val", "1") not in ("0", "false")


def parse_pdf(content: bytes) -> Parsed:
    """Lines with font size and weight; other parsers can be passed to read_documents."""
    try:
        lines = pdf.layout(content)
    except pdf.PdfError as e:
        raise ParseError(f"cannot open: {e}") from e
    if not lines:
        raise ParseError("no text")
    return [(text, size, bold, None) for text, size, bold in lines]


PARSERS: dict[str, Callable[[bytes], Parsed]] = {"txt": parse_text, "docx": parse_docx, "pdf": parse_pdf}
MAGIC = {"pdf": b"%PDF-", "docx": b"PK\x03\x04"}


def parse_any(path: str, content: bytes, parsers: dict[str, Callable[[bytes], Parsed]] = PARSERS, seconds: float = PARSE_SECONDS) -> tuple[str | None, str | None, Parsed]:
    """(kind, error, lines) by the file's extension. A parser that takes longer than `seconds` is interrupted where this runs in
    a process's main thread, as it does in Spark's workers; elsewhere it is left behind."""
    tail = path.rpartition(".")[2].lower() if "." in path else ""
    if tail not in parsers:
        return None, f"unsupported type: {tail or 'none'}", []
    if not content.startswith(MAGIC.get(tail, b"")):
        return tail, "content does not match the type", []
    try:
        return tail, None, _within(seconds, parsers[tail], content)
    except Late:
        return tail, "timed out", []
    except ParseError as e:
        return tail, str(e), []
    except Exception as e:  # parsers fail in many ways on damaged files; one row's failure stops no other
        return tail, f"cannot open: {type(e).__name__}", []


def _within(seconds: float, parser: Callable[[bytes], Parsed], content: bytes) -> Parsed:
    if threading.current_thread() is threading.main_thread():

        def late(*_: object) -> None:
            raise Late

        before = signal.signal(signal.SIGALRM, late)
        signal.setitimer(signal.ITIMER_REAL, seconds)
        try:
            return parser(content)
        finally:
            signal.setitimer(signal.ITIMER_REAL, 0)
            signal.signal(signal.SIGALRM, before)
    pool = ThreadPoolExecutor(1)
    try:
        return pool.submit(parser, content).result(seconds)
    finally:
        pool.shutdown(wait=False, cancel_futures=True)


def parse_documents(contents: DataFrame, parsers: dict[str, Callable[[bytes], Parsed]] | None = None, most: int = UPLOAD_BYTES) -> DataFrame:
    """contents(path, length, content) -> (path, kind, error, lines). What is longer than `most` bytes comes back with an error; its
    content is not looked at, and where it comes from files it is never read, since the filter reaches the source."""
    chosen = parsers or PARSERS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                kind, error, lines = parse_any(path, bytes(content), chosen)
                rows.append((path, kind, error, [{"pos": k, "text": t, "font_size": s, "bold": b, "style_name": n} for k, (t, s, b, n) in enumerate(lines)]))
            yield pd.DataFrame(rows, columns=["path", "kind", "error", "lines"])

    schema = "path string, kind string, error string, lines array<struct<pos: long, text: string, font_size: double, bold: boolean, style_name: string>>"
    read = contents.where(F.col("length") <= most).select("path", "content").mapInPandas(run, schema)
    big = contents.where(F.col("length") > most).select("path", T.file_type("path").alias("kind"), F.lit("too large").alias("error"))
    return read.unionByName(big, allowMissingColumns=True)


def read_documents(spark: SparkSession, folder: str, parsers: dict[str, Callable[[bytes], Parsed]] | None = None, most: int = UPLOAD_BYTES) -> DataFrame:
    """(path, kind, error, lines) of every file in a folder; see parse_documents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return parse_documents(files.select("path", "length", "content"), parsers, most)


def document_lines(documents: DataFrame) -> DataFrame:
    """(doc, pos, text, font_size, bold, style_name) of the files that could be read."""
    return documents.where("error is null").select(F.col("path").alias("doc"), F.inline("lines"))
