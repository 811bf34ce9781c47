"""Dates and times as Column expressions. Unreadable input is null; nothing is guessed beyond the listed formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Months in references, and the years in which a reference's date is plausible.
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
REFERENCE_YEARS = (2015, 2040)


def _try(text: Column, pattern: str) -> Column:
    return F.try_to_date(text, pattern)


def iso_date(text: Column) -> Column:
    return F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), text.try_cast("date"))


def is_iso_date(text: Column) -> Column:
    return F.coalesce(iso_date(text).isNotNull(), F.lit(False))


def century(date: Column) -> Column:
    """Two-digit years from 69 on belong to the last century."""
    return F.when(F.year(date) >= 2069, F.add_months(date, -1200)).otherwise(date)


def to_date(text: Column) -> Column:
    t = F.trim(text)
    short = F.when(t.rlike("^[0-9]{1,2} [A-Za-z]{3} [0-9]{2}$"), century(_try(F.initcap(t), "d MMM yy")))
    long = F.when(t.rlike("^[0-9]{1,2} [A-Za-z]{3} [0-9]{4}$"), _try(F.initcap(t), "d MMM yyyy"))
    slashed = F.when(t.rlike("^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$"), _try(t, "yyyy/M/d"))
    dashed = F.when(t.rlike("^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$"), _try(t, "d-M-yyyy"))
    day_first = F.when(t.rlike("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"), _try(t, "d/M/yyyy"))
    return F.coalesce(iso_date(t), slashed, dashed, day_first, short, long)


def to_timestamp(text: Column) -> Column:
    """Metadata times: ISO and colon-separated dates with T or a blank, a D: prefix, compact ones; zone suffixes are dropped."""
    t = F.regexp_replace(F.regexp_replace(F.trim(text), "^D:", ""), r"(?:Z|[+-][0-9]{2}:?'?[0-9]{2}'?)$", "")
    forms = [("^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:]{8}$", "yyyy-MM-dd'T'HH:mm:ss"), ("^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9:]{8}$", "yyyy-MM-dd HH:mm:ss"), ("^[0-9]{4}:[0-9]{2}:[0-9]{2} [0-9:]{8}$", "yyyy:MM:dd HH:mm:ss"), ("^[0-9]{14}$", "yyyyMMddHHmmss"), ("^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "yyyy-MM-dd"), ("^[0-9]{4}:[0-9]{2}:[0-9]{2}$", "yyyy:MM:dd"), ("^[0-9]{8}$", "yyyyMMdd")]
    return F.coalesce(*(F.when(t.rlike(r), F.try_to_timestamp(t, F.lit(f))) for r, f in forms))


def certificate_time(text: Column) -> Column:
    t = F.trim(text)
    return F.coalesce(*(F.try_to_timestamp(t, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "MMM dd yyyy HH:mm:ss", "yyyy-MM-dd")))


def fuzzy_date(text: Column) -> Column:
    """to_date, and dates with points, full month names or the month first."""
    t = F.initcap(F.regexp_replace(F.trim(text), ",", ""))
    more = [("^[0-9]{1,2}\\.[0-9]{1,2}\\.[0-9]{4}$", "d.M.yyyy"), ("^[0-9]{1,2} [A-Z][a-z]{3,} [0-9]{4}$", "d MMMM yyyy"), ("^[A-Z][a-z]{2} [0-9]{1,2} [0-9]{4}$", "MMM d yyyy"), ("^[A-Z][a-z]{3,} [0-9]{1,2} [0-9]{4}$", "MMMM d yyyy"), ("^[0-9]{8}$", "yyyyMMdd"), ("^[0-9]{1,2}-[A-Z][a-z]{2}-[0-9]{4}$", "d-MMM-yyyy")]
    return F.coalesce(to_date(text), *(F.when(t.rlike(r), _try(t, f)) for r, f in more))


def yymmdd(text: Column, pivot: int = 30) -> Column:
    year = F.substring(text, 1, 2)
    full = F.concat(F.when(year.try_cast("int") <= pivot, F.lit("20")).otherwise(F.lit("19")), text)
    return F.when(text.rlike("^[0-9]{6}$"), _try(full, "yyyyMMdd"))


def is_within(d: Column, start: Column, end: Column, slack: int = 0) -> Column:
    return d.between(F.date_sub(start, slack), F.date_add(end, slack))


def reference_date(ref: Column) -> Column:
    """The first plausible date in a reference number: eight digits, year first, day first, then with a month's name."""

    def first(pattern: str, make) -> Column:
        found = F.transform(F.regexp_extract_all(ref, F.lit(pattern), F.lit(1)), make)
        return F.try_element_at(F.filter(found, lambda d: F.year(d).between(*REFERENCE_YEARS)), F.lit(1))

    dashed = lambda x: F.regexp_replace(x, "[/. ]", "-")
    return F.coalesce(
        first(r"(?<![0-9])([0-9]{8})(?![0-9])", lambda x: _try(x, "yyyyMMdd")),
        first(r"(?<![0-9])([0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2})(?![0-9])", lambda x: _try(dashed(x), "yyyy-M-d")),
        first(r"(?<![0-9])([0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4})(?![0-9])", lambda x: _try(dashed(x), "d-M-yyyy")),
        first(rf"(?i)(?<![0-9])([0-9]{{1,2}}[ \-](?:{MONTHS})[a-z]*[ \-](?:[0-9]{{4}}|[0-9]{{2}}))(?![0-9])", lambda x: _with_month(x)),
    )


def _with_month(x: Column) -> Column:
    short = F.initcap(F.regexp_replace(F.regexp_replace(x, "-", " "), "(?i) ([a-z]{3})[a-z]* ", " $1 "))
    return F.when(short.rlike("[0-9]{4}$"), _try(short, "d MMM yyyy")).otherwise(century(_try(short, "d MMM yy")))


def mentioned(date: Column, text: Column, reach: int = 20) -> Column:
    """Day and month (number or name) of the date lie within `reach` characters in the text; a year there must agree."""
    day, month = F.dayofmonth(date).cast("string"), F.month(date).cast("string")
    name = F.date_format(date, "MMM")
    month_form = F.concat(F.lit("(?:(?<![0-9])0?"), month, F.lit("(?![0-9])|"), name, F.lit(")"))
    day_form = F.concat(F.lit("(?<![0-9])0?"), day, F.lit("(?![0-9])"))
    gap = F.lit(f".{{0,{reach}}}?")
    both = F.concat(F.lit("(?is)(?:"), day_form, gap, month_form, F.lit("|"), month_form, gap, day_form, F.lit(")"))
    years = F.regexp_extract_all(text, F.lit("(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])"), F.lit(1))
    return F.rlike(text, both) & ((F.size(years) == 0) | F.array_contains(years, F.year(date).cast("string")))
