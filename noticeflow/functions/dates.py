"""Date keys of notices. Notices carry dates as text in several spellings."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col

# Fixed value: year, month and day with an optional '-' or '.' between them.
DAY_PATTERN = r"^(\d{4})[-.]?(\d{2})[-.]?(\d{2})"
UNDATED = "undated"


def digits8(column: Column | str) -> Column:
    """First eight digits of a date text (yyyyMMdd)."""
    return F.substring(F.regexp_replace(F.coalesce(_col(column), F.lit("")), r"\D", ""), 1, 8)


def date_display(column: Column | str) -> Column:
    """yyyy-MM-dd, or '-' when the text holds fewer than eight digits."""
    key = digits8(column)
    shown = F.concat_ws("-", F.substring(key, 1, 4), F.substring(key, 5, 2), F.substring(key, 7, 2))
    return F.when(F.length(key) == 8, shown).otherwise(F.lit("-"))


def record_day(column: Column | str) -> Column:
    """Day a record is stored under, or 'undated'."""
    text = F.coalesce(_col(column), F.lit(""))
    parts = [F.regexp_extract(text, DAY_PATTERN, i) for i in (1, 2, 3)]
    return F.when(text.rlike(DAY_PATTERN), F.concat_ws("-", *parts)).otherwise(F.lit(UNDATED))


def days_between(begin: Column | str, end: Column | str) -> Column:
    """Number of days from begin to end, both included."""
    return F.datediff(_col(end), _col(begin)) + 1


def ymd(column: Column | str) -> Column:
    return F.date_format(_col(column), "yyyyMMdd")


def end_time(day: Column | str, now: datetime) -> Column:
    """hhmm at which a request for ``day`` ends: now for the current day, else 2359."""
    return F.when(_col(day) == F.lit(now.date()), F.lit(now.strftime("%H%M"))).otherwise(F.lit("2359"))


def check_range(begin: date | None, end: date | None, today: date | None = None) -> None:
    """Reject a missing, inverted or future date range."""
    if begin is None or end is None:
        raise ValueError("both begin and end are needed")
    if begin > end:
        raise ValueError("begin lies after end")
    if today is not None and end > today:
        raise ValueError("end lies in the future")
