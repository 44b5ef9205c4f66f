"""Dates of procurement portals, local weeks and display of times, as columns."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Asia/Manila"
MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"
_HEAD = "(^|[^0-9])"


def _pad(x: Column, n: int = 2) -> Column:
    return F.lpad(x, n, "0")


def portal_date(text: Column) -> Column:
    """The first ``d-Mon-yyyy`` anywhere in a text as a date; null if there is none or it isn't in the calendar."""
    return F.try_to_timestamp(F.regexp_extract(text, f"{_HEAD}([0-9]{{1,2}}-[A-Za-z]{{3}}-[0-9]{{4}})", 2), F.lit("d-MMM-yyyy")).cast("date")


def format_portal(day: Column) -> Column:
    """``d-Mon-yyyy`` without a leading zero."""
    return F.date_format(day, "d-MMM-yyyy")


def slash_date(text: Column) -> Column:
    """``d/m/yyyy`` at the start of a text, an optional clock after it, as a timestamp."""
    part = lambda i: F.regexp_extract(F.trim(text), r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})(\s+([0-9]{1,2}):([0-9]{2})\s*([AaPp])\.?[Mm]\.?)?$", i)
    hour = F.when(part(5) == "", F.lit(0)).otherwise(part(5).try_cast("int") % 12 + F.when(F.lower(part(7)) == "p", 12).otherwise(0))
    clock = F.concat(_pad(hour.cast("string")), F.lit(":"), F.when(part(6) == "", "00").otherwise(part(6)))
    iso = F.concat(part(3), F.lit("-"), _pad(part(2)), F.lit("-"), _pad(part(1)), F.lit(" "), clock)
    return F.when(part(3) != "", F.try_to_timestamp(iso, F.lit("yyyy-MM-dd HH:mm")))


def iso_day(text: Column) -> Column:
    """A strict ``yyyy-mm-dd`` as a date."""
    return F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))


def known_date(text: Column) -> Column:
    """A date in the portal's or the ISO form; slash dates are never guessed."""
    return F.coalesce(iso_day(text), portal_date(text))


def long_date(day: Column) -> Column:
    """``d Month yyyy``."""
    return F.date_format(day, "d MMMM yyyy")


def scan_window(now: Column, days_back: int = 3, zone: str = ZONE) -> tuple[Column, Column]:
    """D3: local today, and the day so many days before."""
    today = F.to_date(F.from_utc_timestamp(now.cast("timestamp"), zone))
    return F.date_sub(today, days_back), today


def custom_window(from_day: str | None, to_day: str | None) -> tuple[date, date]:
    """D3: a window given by two ISO days; both are needed, in order."""
    if not from_day or not to_day:
        raise ValueError("a window needs both of its days")
    window = date.fromisoformat(from_day), date.fromisoformat(to_day)
    if window[0] > window[1]:
        raise ValueError("a window ends before it starts")
    return window


def local_week(ts: Column, zone: str = ZONE) -> Column:
    """The Monday of the local week, as a date."""
    return F.date_trunc("week", F.from_utc_timestamp(ts.cast("timestamp"), zone)).cast("date")


def local_text(ts: Column, zone: str = ZONE) -> Column:
    """Local time as text."""
    return F.date_format(F.from_utc_timestamp(ts.cast("timestamp"), zone), "d MMM yyyy, HH:mm")


def duration_text(seconds: Column) -> Column:
    """Whole minutes and seconds; null for null or negative."""
    whole = F.floor(seconds).cast("long")
    minutes = F.floor(whole / 60).cast("long")
    return F.when(seconds >= 0, F.when(whole < 60, F.concat(whole.cast("string"), F.lit("s"))).otherwise(F.concat(minutes.cast("string"), F.lit("m "), (whole % 60).cast("string"), F.lit("s"))))


def window_text(from_day: Column, to_day: Column) -> Column:
    """A window of days, or its one day."""
    f, t = format_portal(from_day), format_portal(to_day)
    return F.when(f == t, f).otherwise(F.concat(f, F.lit(" to "), t))


def deadline_key(text: Column) -> Column:
    """One key for equal deadlines in different forms: ``yyyy-mm-dd`` and ``Thh:mm`` if a clock is there, else the lower-cased text.

    Forms: day-Mon-year, day/month/year, Month day, year. ``p.m.`` counts as pm.
    """
    flat = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    names = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
    dmy = lambda i: F.regexp_extract(flat, rf"([0-9]{{1,2}})-({names})[a-z]*-([0-9]{{4}})", i)
    slash = lambda i: F.regexp_extract(flat, r"([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})", i)
    long = lambda i: F.regexp_extract(flat, rf"({names})[a-z]* ([0-9]{{1,2}}),? ([0-9]{{4}})", i)
    month = lambda name: _pad(((F.instr(F.lit(MONTHS.lower()), name) + 2) / 3).cast("int").cast("string"))
    day = (
        F.when(dmy(3) != "", F.concat(dmy(3), F.lit("-"), month(dmy(2)), F.lit("-"), _pad(dmy(1))))
        .when(slash(3) != "", F.concat(slash(3), F.lit("-"), _pad(slash(2)), F.lit("-"), _pad(slash(1))))
        .when(long(3) != "", F.concat(long(3), F.lit("-"), month(long(1)), F.lit("-"), _pad(long(2))))
    )
    clock = lambda i: F.regexp_extract(flat, r"([0-9]{1,2}):([0-9]{2})\s*(a\.?m|p\.?m)?", i)
    hour = clock(1).try_cast("int")
    hour = F.when(F.substring(clock(3), 1, 1) == "p", hour % 12 + 12).when(F.substring(clock(3), 1, 1) == "a", hour % 12).otherwise(hour)
    time = F.when(clock(2) != "", F.concat(F.lit("t"), _pad(hour.cast("string")), F.lit(":"), clock(2))).otherwise(F.lit(""))
    return F.coalesce(F.upper(F.concat(day, time)), flat)
