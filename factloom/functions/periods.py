"""Reporting periods: canonical form and chronological sort key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import some

QUARTER = r"(?i)(?:Q([1-4])|([1-4])Q)\s*(?:FY|Fiscal)?\s*(?:20)?(\d{2})"
RANGE = r"\b20\d{2}-(\d{2})\b"
FISCAL = r"(?i)(?:FY|Fiscal\s*Year|Fiscal)\s*(?:20)?(\d{2})(?:-(\d{2}))?"
CALENDAR = r"(?i)(?:CY\s*)?(20\d{2})"


def normalize_period(raw: Column) -> Column:
    """`Qn FY20yy`, `FY20yy` or `CY20yy`, whichever form is found first in that order; else the trimmed input."""
    text = F.trim(raw)
    part = lambda pattern, group: F.regexp_extract(text, pattern, group)
    quarter = F.concat(part(QUARTER, 1), part(QUARTER, 2))
    return (
        F.when(raw.isNull() | (raw == ""), F.lit(None).cast("string"))
        .when(text.rlike(QUARTER), F.concat(F.lit("Q"), quarter, F.lit(" FY20"), part(QUARTER, 3)))
        .when(text.rlike(RANGE), F.concat(F.lit("FY20"), part(RANGE, 1)))
        .when(text.rlike(FISCAL), F.concat(F.lit("FY20"), F.coalesce(some(part(FISCAL, 2)), part(FISCAL, 1))))
        .when(text.rlike(CALENDAR), F.concat(F.lit("CY"), part(CALENDAR, 1)))
        .otherwise(text)
    )


def sort_key(period: Column) -> Column:
    """A string that sorts periods in time: fiscal years end in March, so their first three quarters lie in the year before."""
    text = F.upper(F.trim(period))
    quarter, fiscal, year = r"Q([1-4])\s*FY(?:20)?(\d{2})", r"FY(?:20)?(\d{2})", r"(?:CY)?(20\d{2})"
    number = F.regexp_extract(text, quarter, 1)
    ends = F.concat(F.lit("20"), F.regexp_extract(text, quarter, 2)).try_cast("int")
    month = F.element_at(F.create_map(*[F.lit(x) for x in ("1", "06", "2", "09", "3", "12", "4", "03")]), number)
    return (
        F.when(period.isNull() | (period == ""), "9999-99-99")
        .when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text)
        .when(text.rlike(quarter), F.concat((ends - (number != "4").cast("int")).cast("string"), F.lit("-"), month, F.lit("-Q"), number))
        .when(text.rlike(fiscal), F.concat(F.lit("20"), F.regexp_extract(text, fiscal, 1), F.lit("-04-FY")))
        .when(text.rlike(year), F.concat(F.regexp_extract(text, year, 1), F.lit("-12-CY")))
        .otherwise(F.concat(F.lit("9998-"), F.substring(text, 1, 10)))
    )
