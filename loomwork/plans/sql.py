"""Pieces of ANSI SQL (as DuckDB reads it) that several checks share."""

from __future__ import annotations

from loomwork.functions import text as T


def q(text: str) -> str:
    return text.replace("'", "''")


def strip(c: str) -> str:
    return f"regexp_replace({c}, '{T.STRIP}', '', 'g')"


def bullet(c: str) -> str:
    return strip(f"regexp_replace({c}, '{T.BULLET}', '')")


def norm_header(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(replace(lower({c}), '&', 'and'), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"


def norm_term(c: str) -> str:
    return strip(f"regexp_replace(regexp_replace(lower({strip(c)}), '{T.BLANK}+v?\\d+(\\.\\d+)*\\+?$', '', 'g'), '{T.BLANK}+', ' ', 'g')")


def has_any(c: str, cues: list[str]) -> str:
    return "(" + " or ".join(f"contains(lower({c}), '{q(cue)}')" for cue in cues) + ")"


def header_like(c: str) -> str:
    return f"(len(regexp_split_to_array({strip(c)}, '{T.BLANK}+')) <= {T.MAX_HEADER_WORDS} and upper({c}) = {c} and lower({c}) <> {c})"


def seniority(c: str) -> str:
    return "case " + " ".join(f"when {has_any(f'coalesce({c}, {chr(39)}{chr(39)})', cues)} then '{k}'" for k, cues in T.SENIORITY_CUES.items()) + " else 'unspecified' end"


def degree(c: str) -> str:
    return "case " + " ".join(f"when regexp_matches({c}, '{q(p)}') then {r}" for p, r in T.DEGREE_RANKS) + " end"


def level(c: str, section: str) -> str:
    return f"case when {has_any(c, T.PREFERRED_CUES)} then 'preferred' when {has_any(c, T.REQUIRED_CUES)} then 'required' when {section} = 'preferred' then 'preferred' else 'required' end"


def resume_date(c: str, as_of: str) -> str:
    t = f"lower({strip(c)})"
    month = f"list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], regexp_extract({t}, '^([a-z]+)\\s+(\\d{{4}})$', 1)[1:3])"
    year = f"try_cast(regexp_extract({t}, '^([a-z]+)\\s+(\\d{{4}})$', 2) as int)"
    return f"""case when {t} in ('present','current') then date '{as_of}' when {month} > 0 and {year} > 0 then make_date({year}, cast({month} as int),
    1) when regexp_matches({t}, '^\\d{{4}}$') and {t} <> '0000' then make_date(try_cast({t} as int), 1, 1) end"""


def lines(table: str, key: str = "id", text: str = "raw_text", name: str = "lines") -> str:
    clean = f"list_filter(list_transform(regexp_split_to_array({text}, '{T.LINE_BREAK}'), lambda x: {strip('x')}), lambda x: x <> '')"
    return f"""{name}_a as (select {key} doc, {clean} a from {table} where {text} is not null), {name} as (select doc, unnest(range(len(a))) pos,
    unnest(a) \"text\" from {name}_a)"""


def aliases(table: dict[str, list[str]], name: str = "al") -> str:
    rows = ", ".join(f"('{n}', '{k}')" for k, names in table.items() for n in names)
    return f"{name}(name, kind) as (values {rows})"


def sections(table: dict[str, list[str]], src: str = "lines", name: str = "seg") -> str:
    """Segmented lines; src has doc, pos, text."""
    return f"""{aliases(table, name + '_al')},
{name}_h as (select doc, pos, "text", coalesce(x.kind, case when {header_like('"text"')} then 'other' end) k
    from {src} left join {name}_al x on x.name = {norm_header('"text"')}),
{name} as (select doc, pos, "text", k is not null is_header, count(k) over w seg_no,
    coalesce(last_value(k ignore nulls) over w, 'unlabeled') section_type,
    last_value(case when k is not null then "text" end ignore nulls) over w raw_header
    from {name}_h window w as (partition by doc order by pos rows between unbounded preceding and current row))"""


def resume_sections() -> str:
    return lines("resumes") + ", " + sections(T.RESUME_ALIASES)


def job_sections(name: str = "seg") -> str:
    return lines("jobs", name="jl") + ", " + sections(T.JOB_ALIASES, "jl", name)


def requirements(src: str = "seg", name: str = "req") -> str:
    t = bullet('"text"')
    return f"""{name} as (select doc, row_number() over (partition by doc order by pos) - 1 idx, t "text", {level('t', 'section_type')} as level
    from (select *, {t} t from {src} where section_type in ('requirements', 'preferred') and not is_header) where t <> '')"""


def ngrams(c: str, longest: int = 3) -> str:
    w = f"regexp_extract_all(lower({c}), '{T.TERM}')"
    parts = [f"list_transform(range(1, greatest(len({w}) - {k - 1}, 1) + 1), lambda i: array_to_string({w}[i:i+{k - 1}], ' '))" for k in range(1, longest + 1)]
    return f"list_distinct(list_concat({', '.join(parts)}))"


def entries(section: str, src: str = "seg", name: str = "ent") -> str:
    b = f"regexp_matches(\"text\", '{T.BULLET}')"
    return f"""{name}_l as (select doc, pos, "text", {b} b, sum(case when {b} then 0 else 1 end) over (partition by doc
    order by pos rows between unbounded preceding and current row) e
    from {src} where section_type = '{section}' and not is_header),
{name} as (select doc, e entry_no, max(case when not b then "text" end) as header,
    list({bullet('"text"')} order by pos) filter (b) as bullets from {name}_l where e > 0 group by doc, e)"""


def experience(name: str = "expr", src: str = "ent") -> str:
    m = f"regexp_matches(header, '{T.EXPERIENCE_HEADER}')"
    g = lambda k: strip(f"regexp_extract(header, '{T.EXPERIENCE_HEADER}', {k})")
    dates = g(3)
    r = f"regexp_matches({dates}, '{T.DATE_RANGE}')"
    d = lambda k: strip(f"regexp_extract({dates}, '{T.DATE_RANGE}', {k})")
    return f"""{name} as (select doc, entry_no, case when {m} then {g(1)} else {strip("regexp_split_to_array(header, ',')[1]")} end title,
    case when {m} then {g(2)} end organization, case when {m} and {r} then {d(1)} when {m} and {dates} <> '' then {dates} end start_date,
    case when {m} and {r} then {d(2)} end end_date, bullets from {src})"""
