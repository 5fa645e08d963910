"""Dates written in several ways, as column builders; all in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Danish month names, in order; fixed. Any beginning of three letters or more stands for the month.
MONTHS = "januar februar marts april maj juni juli august september oktober november december".split()
#: English month names, by their first three letters; fixed.
ENGLISH = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def _month(word: Column, names: list[str]) -> Column:
    """1 to 12 of a month's name or a beginning of it."""
    got = F.lit(None).cast("int")
    for k, name in reversed(list(enumerate(names, 1))):
        got = F.when((F.length(word) >= 3) & F.lit(name).startswith(F.substr(word, F.lit(1), F.length(word))), k).otherwise(got)
    return got


def _day(year: Column, month: Column, day: Column) -> Column:
    """Midnight of a day, or NULL if there is no such day."""
    return F.try_to_timestamp(F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0")), F.lit("yyyy-MM-dd"))


def iso(text: Column) -> Column:
    """ISO 8601, with Z, an offset or neither (then UTC)."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"), F.try_to_timestamp(text))


def mail(text: Column) -> Column:
    """RFC 822, as in mails and HTTP headers."""
    form = r"(?i)^(?:[a-z]{3},\s*)?(\d{1,2}) ([a-z]{3})[a-z]* (\d{4}) (\d{2}:\d{2}(?::\d{2})?)\s*(GMT|UTC|[+-]\d{4})?"
    part = lambda k: F.regexp_extract(text, form, k)
    zone = F.when(part(5).rlike("^[+-]"), F.regexp_replace(part(5), r"^(...)(..)$", "$1:$2")).otherwise("+00:00")
    month = F.lpad(_month(F.lower(part(2)), ENGLISH).cast("string"), 2, "0")
    time = F.when(F.length(part(4)) == 5, F.concat(part(4), F.lit(":00"))).otherwise(part(4))
    return F.when(text.rlike(form), F.try_to_timestamp(F.concat(part(3), F.lit("-"), month, F.lit("-"), F.lpad(part(1), 2, "0"), F.lit("T"), time, zone)))


def danish(text: Column) -> Column:
    """'8. august 2025', 'opdateret d. 8. aug. 2025', anywhere in the text."""
    form = r"(?i)(\d{1,2})\.?\s*(jan\w*|feb\w*|mar\w*|apr\w*|maj|jun\w*|jul\w*|aug\w*|sep\w*|okt\w*|nov\w*|dec\w*)\.?\s*(\d{4})"
    part = lambda k: F.regexp_extract(text, form, k)
    return F.when(text.rlike(form), _day(part(3), _month(F.lower(part(2)), MONTHS), part(1)))


def numeric(text: Column) -> Column:
    """Day-month-year with - or /, year/month/day, and a time after an ISO day."""
    t = F.trim(text)
    got = [F.try_to_timestamp(F.when(t.rlike(form), t), F.lit(pattern)) for form, pattern in ((r"^\d{2}-\d{2}-\d{4}$", "dd-MM-yyyy"), (r"^\d{2}/\d{2}/\d{4}$", "dd/MM/yyyy"), (r"^\d{4}/\d{2}/\d{2}$", "yyyy/MM/dd"))]
    return F.coalesce(*got)


def any_date(text: Column) -> Column:
    """The first reading that gives a date: ISO, RFC 822, numeric, Danish words."""
    t = F.trim(text)
    return F.coalesce(iso(t), mail(t), numeric(t), danish(t))
