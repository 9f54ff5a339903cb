"""Labelled spans for training the tagger of personal information, and the shapes its findings are checked against."""

from __future__ import annotations

import re
from collections.abc import Iterable

TYPES = ("email", "phone", "identity", "address", "name")
_DOT = r"(?:\.|\s?[\[(]\s?dot\s?[\])]\s?|\sdot\s)"
_AT = r"(?:\s?@\s?|\s?[\[(]\s?at\s?[\])]\s?|\sat\s(?=[\w-]+(?:\.[\w-]+)*\s?[\[(]?\s?dot\b))"
EMAIL = re.compile(rf"(?<![\w.+-])[A-Za-z0-9][\w.+%-]*{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,}}(?![\w-])")
PHONE = re.compile(
    r"(?<![\w+/.-])(?:"
    r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ ]?\d{0,5}|\d{1,14})(?:[ .\-/]\d{2,6}){0,5}"  # +44 (0)1632 960730, +15885550108
    r"|00\d{2}(?:[ .-]\d{1,6}){2,5}"
    r"|0\d{2,4}/\d{5,9}"
    r"|0\d{3,4} \d{3} ?\d{3}"
    r"|\(\d{3}\) ?\d{3}[ .-]\d{4}"
    r"|\d{3}([.-])\d{3}\1\d{4}"
    r")(?![\w]|[-/.]\d)"
)
IDENTITY = re.compile(
    r"(?<![\w./-])(?:\d{6}-\d{4}|\d{3}\.\d{3}\.\d{3}-\d{2}|[A-Z]{1,2}\d{7,8}|\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}"
    r"|[A-Z]\d{2}[A-Z]{2}\d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]|[A-Z]{5}\d{6}[A-Z]{2})(?![\w]|[-/.]\d)"
)
_ID_LABEL = re.compile(
    r"(?:Personal ID|Tax ID|Passport|SSN|Identity card|ID card|Social security|NI|National insurance|Driving licence|Driver.s licen[cs]e)"
    r"(?:\s*(?:no|number|nr))?\.?\s*[:#]?\s*$",
    re.I,
)
_TOWN = r"(?:Port |Saint[- ]|St\. )?[A-ZÀ-Þ][\w'’]+(?:-[A-ZÀ-Þ][\w'’]+)*"
_WAY = r"(?:Road|Rd|Street|St|Lane|Ln|Avenue|Ave|Close|Drive|Dr|Court|Way|Terrace|Row|Square|Hill|Place)\b\.?"
_LETTER = r"[A-ZÀ-Þ]"
ADDRESS = re.compile(
    rf"(?<![\w])(?:(?:Flat \d{{1,3}}[A-Za-z]?,\s+)?\d{{1,4}}[A-Za-z]? (?:{_LETTER}[\w'’]+ ){{1,3}}{_WAY},\s+{_TOWN}(?: \d{{5}}\b)?"
    rf"|(?:{_LETTER}[\w-]*(?:allee|stra(?:ß|ss)e|str\.|weg|gasse|platz|ring|damm|ufer)|{_LETTER}[\w-]+ (?:Straße|Str\.|Weg|Platz|Allee)) \d{{1,4}}[a-z]?,\s+\d{{5}} {_TOWN}"
    rf"|(?:Am|An der|Im|In der|Auf der|Auf dem|Unter den|Zum|Zur|Beim) {_LETTER}[\w-]+ \d{{1,4}}[a-z]?,\s+\d{{5}} {_TOWN}"
    rf"|\d{{1,4}}(?: bis| ter)?,? (?:chemin|rue|avenue|place|boulevard|quai|impasse|allée|route|cours) (?:(?:des|du|de la|de|de l'|d') ?)?{_LETTER}[\w'’-]+(?: {_LETTER}[\w'’-]+)?,\s+\d{{5}} {_TOWN}"
    rf"|P\. ?O\. ?Box \d{{1,5}},\s+{_TOWN}(?: \d{{5}}\b)?|PO Box \d{{1,5}},\s+{_TOWN}(?: \d{{5}}\b)?)",
    re.I | re.U,
)
_PART = r"[A-ZÀ-Þ][\w'’]+"
#: A name as written: two to four parts, or the surname, a comma and the rest.
NAME = re.compile(rf"{_PART}(?:-{_PART})?,\s{_PART}(?:\s[A-ZÀ-Þ]\.)?|{_PART}(?:\s[A-ZÀ-Þ]\.)?(?:\s{_PART}(?:-{_PART})?){{1,2}}")
_ORGANISATION = re.compile(r"\s+(?:Partners|Group|Ltd|Inc|GmbH|LLC|Systems|Foods|Works|Street|Road|depot)\b")


def first_names(names: Iterable[str | None]) -> set[str]:
    """First parts of the full names known from profiles."""
    return {n.split()[0].lower() for n in names if n and len(n.split()) > 1}


def name_pattern(firsts: set[str]) -> re.Pattern:
    """Names that begin with, or after a surname and a comma end in, one of the given first names."""
    some = "|".join(sorted(map(re.escape, firsts), key=len, reverse=True)) or "(?!)"
    first = rf"(?i:{some})"
    last = r"[A-ZÀ-Þ](?:[a-zà-ÿ'’]+|[A-ZÀ-Þ'’]+)(?:-[A-ZÀ-Þ](?:[a-zà-ÿ'’]+|[A-ZÀ-Þ'’]+))?"
    return re.compile(rf"(?<![\w@.+-])(?:{last}, {first}(?: [A-ZÀ-Þ]\.)?|{first}(?: [A-ZÀ-Þ]\.)? {last})(?![\w@+]|-\w)")


def label(text: str, names: re.Pattern) -> list[tuple[int, int, str]]:
    """(start, stop, type) of the spans that rules can vouch for, without overlaps; the earlier type in TYPES wins."""
    spans: list[tuple[int, int, str]] = []

    def add(a: int, b: int, kind: str) -> None:
        if not any(a < y and x < b for x, y, _ in spans):
            spans.append((a, b, kind))

    for m in EMAIL.finditer(text):
        add(m.start(), m.end(), "email")
    for m in IDENTITY.finditer(text):
        if _ID_LABEL.search(text[max(0, m.start() - 40) : m.start()]):
            add(m.start(), m.end(), "identity")
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            add(m.start(), m.end(), "phone")
    for m in ADDRESS.finditer(text):
        add(m.start(), m.end(), "address")
    for m in names.finditer(text):
        if not _ORGANISATION.match(text, m.end()):
            add(m.start(), m.end(), "name")
    return sorted(spans)
