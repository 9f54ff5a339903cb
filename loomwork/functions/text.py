"""Row-local text functions. All are built from Spark's own expressions and stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that is stripped from lines, no-break space included; the patterns below it are fixed values.
BLANK = r"[\s\x{0b}\x{a0}]"
STRIP = rf"^{BLANK}+|{BLANK}+$"
LINE_BREAK = r"\r\n|\n|\r"
BULLET = r"^[-•*–—●·]\s*"
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.-]+"
PHONE = r"\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}"
URL = r"https?://\S+|www\.\S+"
CITY_STATE = r"\b[A-Z][a-zA-Z.]+(?:\s[A-Z][a-zA-Z.]+)*,\s*[A-Z]{2}\b"
EXPERIENCE_HEADER = r"^([^,]+),\s*([^,]+?)\s+(?:--|–|—)\s+(.+)$"
DATE_RANGE = r"(?i)^(.+?)\s+to\s+(.+)$"
DEGREE = r"^(Ph\.D\.|B\.S\.|M\.S\.|B\.A\.|M\.A\.|MBA|Bachelor'?s?|Master'?s?|Associate'?s?)\s+(.+)$"
YEAR = r"\b(?:19|20)\d{2}\b"
YEARS_ASKED = r"(\d+)\+?\s*years?"
NUMBER = r"\d+(?:\.\d+)?"
TERM = r"[\p{L}\p{N}][\p{L}\p{N}.+#-]*[\p{L}\p{N}+#]|[\p{L}\p{N}]"
MAX_HEADER_WORDS, HEADER_FONT_RATIO = 5, 1.15

#: Header phrasings of resumes. Fixed values.
RESUME_ALIASES = {
    "contact": ["contact", "contact information", "contact info", "personal information"],
    "summary": ["summary", "professional summary", "objective", "career objective", "profile", "about me"],
    "skills": ["skills", "technical skills", "core competencies", "technologies", "skills and tools", "highlights", "areas of expertise", "technical proficiencies"],
    "experience": ["experience", "work experience", "professional experience", "employment history", "work history", "relevant experience"],
    "projects": ["projects", "personal projects", "academic projects", "key projects", "selected projects"],
    "education": ["education", "academic background", "education and training"],
    "certifications": ["certifications", "certifications and licenses", "licenses", "licenses and certifications"],
    "awards": ["awards", "honors", "awards and honors", "honors and awards", "achievements"],
    "languages": ["languages"],
    "publications": ["publications"],
}
#: Header phrasings of job descriptions. Fixed values.
JOB_ALIASES = {
    "requirements": ["requirements", "required qualifications", "minimum qualifications", "basic qualifications", "qualifications", "must haves"],
    "preferred": ["preferred qualifications", "nice to have", "preferred skills", "bonus points", "good to have", "preferred", "pluses"],
    "responsibilities": ["responsibilities", "key responsibilities", "what you ll do", "duties", "role overview", "the role", "job duties"],
    "about": ["about us", "about the company", "company overview", "who we are", "about"],
    "benefits": ["benefits", "perks", "what we offer", "compensation and benefits"],
}
#: Headers that broken extraction glues to the text behind them. Fixed values.
GLUED_HEADERS = ["Professional Experience", "Professional Summary", "Employment History", "Technical Skills", "Work Experience", "Certifications", "Experience", "Highlights", "Education", "Objective", "Summary", "Skills"]
#: Cues in requirement lines and in titles, in the order they are tried. Fixed values.
PREFERRED_CUES = ["nice to have", "preferred", "strong plus", "a plus", "bonus", "good to have", "should have", "ideally"]
REQUIRED_CUES = ["must have", "must", "required", "requires", "you must", "minimum qualifications"]
SENIORITY_CUES = {
    "staff": ["staff", "principal", "distinguished"],
    "senior": ["senior", "sr."],
    "junior": ["junior", "jr.", "entry level", "entry-level", "associate"],
    "mid": ["mid-level", "mid level", "intermediate"],
}
SENIORITY_ORDER = {"junior": 0, "mid": 1, "senior": 2, "staff": 3}
#: Patterns of degree levels, highest first. Fixed values.
DEGREE_RANKS = [
    (r"(?i)\bph\.?d\.?\b", 4),
    (r"(?i)\bmaster'?s?\b|\bm\.?s\.?\b|\bm\.?a\.?\b|\bmba\b", 3),
    (r"(?i)\bbachelor'?s?\b|\bb\.?s\.?\b|\bb\.?a\.?\b", 2),
    (r"(?i)\bassociate'?s?\b", 1),
]


def strip(c: str | Column) -> Column:
    return F.regexp_replace(c, STRIP, "")


def first_match(c: str | Column, pattern: str, group: int = 0) -> Column:
    """The first match or null."""
    got = F.regexp_extract(c, pattern, group)
    return F.when(got != "", got)


def any_of(c: str | Column, cues: list[str]) -> Column:
    """Whether the lower-cased text contains one of the cues."""
    low = F.lower(c)
    out = F.lit(False)
    for cue in cues:
        out = out | low.contains(cue)
    return out


def normalize_header(c: str | Column) -> Column:
    text = F.regexp_replace(F.lower(c), "&", "and")
    return F.trim(F.regexp_replace(F.regexp_replace(text, "[^a-z0-9 ]", " "), " +", " "))


def alias_type(c: str | Column, aliases: dict[str, list[str]]) -> Column:
    """Section type of a header line or null; the table is a literal map, so no join is needed."""
    pairs = [F.lit(x) for kind, names in aliases.items() for name in names for x in (name, kind)]
    return F.try_element_at(F.create_map(*pairs), normalize_header(c))


def word_count(c: str | Column) -> Column:
    text = strip(c)
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, rf"{BLANK}+"))).cast("int")


def is_upper(c: str | Column) -> Column:
    return (F.upper(c) == c) & (F.lower(c) != c)


def looks_like_header(text: Column, style: Column | None = None, bold: Column | None = None, size: Column | None = None, body: Column | None = None) -> Column:
    """Short, and set apart by style, weight, size or capitals."""
    marked = is_upper(text)
    if style is not None:
        marked = marked | F.coalesce(F.lower(style).startswith("heading") | F.lower(style).startswith("title"), F.lit(False))
    if bold is not None:
        marked = marked | F.coalesce(bold, F.lit(False))
    if size is not None and body is not None:
        marked = marked | F.coalesce(size > body * HEADER_FONT_RATIO, F.lit(False))
    n = word_count(text)
    return marked & (n >= 1) & (n <= MAX_HEADER_WORDS)  # the cheap test first


def is_bullet(text: Column, style: Column | None = None) -> Column:
    listed = text.rlike(BULLET)
    return listed if style is None else listed | F.coalesce(F.lower(style).contains("list"), F.lit(False))


def strip_bullet(c: str | Column) -> Column:
    return strip(F.regexp_replace(c, BULLET, ""))


def unglue_headers(c: str | Column) -> Column:
    """A line break between a glued header and the capital letter behind it."""
    return F.regexp_replace(c, rf"\b({'|'.join(GLUED_HEADERS)})(?=[A-Z])", "$1\n")


def requirement_level(text: str | Column, section: str | Column) -> Column:
    section = F.col(section) if isinstance(section, str) else section
    return F.when(any_of(text, PREFERRED_CUES), "preferred").when(any_of(text, REQUIRED_CUES), "required").when(section == "preferred", "preferred").otherwise("required")


def seniority(title: str | Column) -> Column:
    title = F.coalesce(F.col(title) if isinstance(title, str) else title, F.lit(""))
    out = None
    for level, cues in SENIORITY_CUES.items():
        out = F.when(any_of(title, cues), level) if out is None else out.when(any_of(title, cues), level)
    return out.otherwise("unspecified")


def seniority_rank(level: Column) -> Column:
    pairs = [F.lit(x) for item in SENIORITY_ORDER.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), level)


def degree_rank(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    out = None
    for pattern, rank in DEGREE_RANKS:
        out = F.when(c.rlike(pattern), rank) if out is None else out.when(c.rlike(pattern), rank)
    return out


def normalize_term(c: str | Column) -> Column:
    """Trimmed, lower-cased, without a trailing version number, blanks squeezed."""
    text = F.regexp_replace(F.lower(strip(c)), rf"{BLANK}+v?\d+(\.\d+)*\+?$", "")
    return strip(F.regexp_replace(text, rf"{BLANK}+", " "))


def clean_name(c: str | Column, rename: dict[str, str] | None = None) -> Column:
    """A feed's name: renamed if it is in the table, else without a trailing 'software'."""
    text = strip(c)
    plain = strip(F.regexp_replace(text, r"(?i)\s+software$", ""))
    if not rename:
        return plain
    table = F.create_map(*[F.lit(x) for item in rename.items() for x in item])
    return F.coalesce(F.try_element_at(table, F.lower(text)), plain)


def category_key(c: str | Column, source: str) -> Column:
    return F.concat(F.lit(f"{source}:"), F.regexp_replace(F.lower(strip(c)), r"\s+", "_"))


def text_id(c: str | Column) -> Column:
    """The first 16 hexadecimal digits of the text's SHA-256."""
    return F.substring(F.sha2(F.col(c) if isinstance(c, str) else c, 256), 1, 16)


def numbers(c: str | Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(NUMBER), 0))


def numbers_within(claim: str | Column, evidence: str | Column) -> Column:
    """Whether every number of the claim occurs in the evidence."""
    return F.size(F.array_except(numbers(claim), numbers(evidence))) == 0


def required_years(c: str | Column) -> Column:
    return F.regexp_extract(c, YEARS_ASKED, 1).try_cast("int")


def file_type(c: str | Column) -> Column:
    """pdf, docx or txt by extension, null for others."""
    tail = F.lower(F.regexp_extract(c, r"\.([^.]+)$", 1))
    return F.when(tail.isin("pdf", "docx", "txt"), tail)


def magic_ok(kind: Column, content: Column) -> Column:
    """Whether binary content begins as its type must; types without a mark pass."""
    head = F.hex(F.substring(content, 1, 5))
    return F.when(kind == "pdf", head == "255044462D").when(kind == "docx", F.substring(head, 1, 8) == "504B0304").otherwise(F.lit(True))


def term_ngrams(c: str | Column, longest: int = 3) -> Column:
    """Distinct runs of one to `longest` terms, lower-cased, one blank between: what a scan for names looks up."""
    words = F.regexp_extract_all(F.lower(c), F.lit(TERM), 0)

    def runs(k: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (k - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, k), " "))

    return F.array_distinct(F.flatten(F.array(*[runs(k) for k in range(1, longest + 1)])))
