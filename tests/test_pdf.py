"""PDF files are made here, operator by operator."""

import time
import zlib

import pytest

from loomwork.functions import text as T
from loomwork.operators import documents as D
from loomwork.sources import files, pdf


def make(content: bytes, packed: bool = True, fonts: bytes = b"", extra: tuple = (), filters: bytes = b"/FlateDecode") -> bytes:
    body = zlib.compress(content) if packed else content
    head = b"/Filter " + filters if packed else b""
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>",
        b"<< /Type /Pages /Kids [3 0 R] /Count 1 /Resources << /Font << /F1 5 0 R /F2 6 0 R " + fonts + b" >> /XObject << /X 7 0 R >> >> >>",
        b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>",
        b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(body), head, body),
        b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>",
        b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica-Bold >>",
        *extra,
    ]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, o) for k, o in enumerate(objects, 1)) + b"trailer << /Root 1 0 R >>\n%%EOF"


PAGE = rb"""BT /F2 20 Tf 50 750 Td (Jordan Ellis) Tj ET
BT /F1 10 Tf 50 730 Td (jordan@example.com) Tj 0 -14 TD [(Caf\351 ) -20 (\(x\)) -400 (y)] TJ T* (next) Tj ET
q 2 0 0 2 0 0 cm BT /F2 6.5 Tf 25 340 Td (WHY HIRE ME) Tj ET Q
BT /F1 10 Tf 1 0 0 1 50 640 Tm (- did one) Tj 1 0 0 1 130 640 Tm (thing) Tj ET"""


@pytest.mark.parametrize("packed", [True, False])
def test_lines_sizes_and_weight(packed):
    got = pdf.layout(make(PAGE, packed))
    assert got == [("Jordan Ellis", 20.0, True), ("jordan@example.com", 10.0, False), ("Café (x) y", 10.0, False), ("next", 10.0, False), ("WHY HIRE ME", 13.0, True), ("- did one thing", 10.0, False)]


def test_codes_forms_and_packed_objects():
    cmap = b"2 beginbfchar <0001> <0048> <0002> <00660069> endbfchar 1 beginbfrange <0010> <0012> <0061> endbfrange"
    wide = b"<< /Type /Font /Subtype /Type0 /BaseFont /X-Bold /ToUnicode 9 0 R /DescendantFonts [<< /DW 500 >>] >>"
    form = b"BT /F1 9 Tf 10 10 Td <41 42> Tj ET"
    inner = b"<< /Type /Font /Subtype /Type1 /BaseFont /Y /Encoding << /Differences [65 /eacute /bullet] >> >>"
    held = b"10 0 " + inner
    extra = (
        b"<< /Subtype /Form /Length %d >>\nstream\n%s\nendstream" % (len(form), form),
        wide,
        b"<< /Length %d >>\nstream\n%s\nendstream" % (len(cmap), cmap),
        b"<< >>",
        b"<< /Type /ObjStm /N 1 /First 5 /Length %d >>\nstream\n%s\nendstream" % (len(held), held.replace(b"10 0 ", b"12 0 ")),
    )
    page = b"BT /F3 12 Tf 5 700 Td <0001000200100012> Tj ET /X Do BI /W 1 ID \x00(Tj) EI BT /F4 8 Tf 5 500 Td (AB) Tj ET"
    got = pdf.layout(make(page, fonts=b"/F3 8 0 R /F4 12 0 R", extra=extra))
    assert got == [("Hfiac", 12.0, True), ("AB", 9.0, False), ("é•", 8.0, False)]


def test_refusals():
    for bad, why in ((b"hello", "no PDF"), (b"%PDF-1.4 nothing", "no pages"), (make(PAGE) + b"/Encrypt 9 0 R", "encrypted"), (make(PAGE).replace(zlib.compress(PAGE), b"x" * 40), "damaged")):
        with pytest.raises(pdf.PdfError, match=why):
            pdf.layout(bad)
    with pytest.raises(files.ParseError, match="no text"):
        files.parse_pdf(make(b"q Q"))


def test_a_bomb_is_refused(monkeypatch):
    monkeypatch.setattr(pdf, "MOST_BYTES", 5000)
    assert files.parse_any("a.pdf", make(PAGE + b" " * 100_000))[1] == "cannot open: unpacks to too much"
    assert len(pdf.layout(make(PAGE))) == 6


def test_damaged_files_are_rows_with_errors():
    import random

    rng, good = random.Random(3), make(PAGE, packed=False)
    for _ in range(150):
        bad = bytearray(good)
        for _ in range(rng.randint(1, 12)):
            bad[rng.randrange(9, len(bad))] = rng.randrange(256)
        kind, error, lines = files.parse_any("a.pdf", bytes(bad), seconds=5)
        assert kind == "pdf" and (error is None) == bool(lines)


def test_late_parsers_are_interrupted():
    ticks = []

    def slow(_: bytes):
        for k in range(100):
            time.sleep(0.02)
            ticks.append(k)

    assert files.parse_any("a.txt", b"x", {"txt": slow}, 0.1)[1] == "timed out"
    seen = len(ticks)
    time.sleep(0.2)
    assert len(ticks) == seen < 20


def test_pdf_headers_by_layout(spark, tmp_path):
    (tmp_path / "r.pdf").write_bytes(make(PAGE))
    lines = files.document_lines(files.read_documents(spark, str(tmp_path)))
    seg = D.segments(lines, T.RESUME_ALIASES)
    assert [r["is_header"] for r in seg.orderBy("pos").collect()] == [True, False, False, False, True, False]
    assert D.contact(seg).first()["name"] == "Jordan Ellis" and D.contact(seg).first()["email"] == "jordan@example.com"
