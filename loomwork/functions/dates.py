"""Dates as resumes write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwork.functions.text import strip

#: First three letters of months. Fixed values.
MONTHS = {m: k for k, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}


def parse_resume_date(c: str | Column, as_of: str) -> Column:
    """Mon YYYY, YYYY, Present or Current (as_of, an ISO date); null for anything else."""
    text = F.lower(strip(c))
    months = F.create_map(*[F.lit(x) for item in MONTHS.items() for x in item])
    month = F.try_element_at(months, F.substring(F.regexp_extract(text, r"^([a-z]+)\s+(\d{4})$", 1), 1, 3))
    year = F.regexp_extract(text, r"^([a-z]+)\s+(\d{4})$", 2).try_cast("int")
    return (
        F.when(text.isin("present", "current"), F.lit(as_of).cast("date"))
        .when(month.isNotNull() & (year > 0), F.make_date(year, month, F.lit(1)))
        .when(text.rlike(r"^\d{4}$") & (text != "0000"), F.make_date(text.try_cast("int"), F.lit(1), F.lit(1)))
    )


def span_years(starts: Column, ends: Column) -> Column:
    """Aggregate: years from the earliest start to the latest end, at least 0, 0 if a side is missing."""
    days = F.datediff(F.max(ends), F.min(starts))
    return F.coalesce(F.greatest(days / F.lit(365.25), F.lit(0.0)), F.lit(0.0))
