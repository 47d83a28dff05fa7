"""Dates as sites write them: ISO, numeric, four languages of month names, titles and URLs."""

from __future__ import annotations

import json

from pyspark.sql import Column, functions as F

from .text import strip_accents

# How far from today a date may lie, and month names (accents removed).
YEARS_BACK, YEARS_AHEAD = 1, 5
MONTHS = {
    1: ["jan", "january", "januar", "janvier"],
    2: ["feb", "february", "februar", "fevrier", "fev"],
    3: ["mar", "march", "marz", "maerz", "mars"],
    4: ["apr", "april", "avril", "abrell", "avr"],
    5: ["may", "mai", "mee"],
    6: ["jun", "june", "juni", "juin"],
    7: ["jul", "july", "juli", "juillet", "juil"],
    8: ["aug", "august", "aout"],
    9: ["sep", "sept", "september", "septembre"],
    10: ["oct", "october", "oktober", "octobre", "okt"],
    11: ["nov", "november", "novembre"],
    12: ["dec", "december", "dezember", "decembre", "dez"],
}
TITLE_END_DATE = (
    r"[|–—-]\s*(\d{1,2}[./-]\d{1,2}[./-]\d{4}|\d{1,2}\.?\s+[A-Za-zÀ-ÿ]{3,12}\.?\s+\d{4})"
    r"(?:\s+\d{1,2}[:.]\d{2})?\s*$"
)
TEXT_DATE = (
    r"(?iU)\b(\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{1,2}\s+(?:January|February|March|April|May|June|July|August"
    r"|September|October|November|December|Januar|Februar|März|Mai|Juni|Juli|Oktober|Dezember|janvier|février"
    r"|mars|avril|mai|juin|juillet|août|aout|septembre|octobre|novembre|décembre)\s+\d{4})\b"
)
CLOCK = r"(?U)\b(\d{1,2})[:h](\d{2})\b"
GRACE_DAYS = 3

_NAMES = {name: number for number, names in MONTHS.items() for name in names}
_NAME_PATTERN = "|".join(sorted(_NAMES, key=len, reverse=True))


def iso(c: Column) -> Column:
    """A date as YYYY-MM-DD text, for the edge of the system."""
    return c.cast("string")


def month_number(name: Column) -> Column:
    table = F.from_json(F.lit(json.dumps(_NAMES)), "map<string,int>")
    return F.element_at(table, strip_accents(F.lower(name)))


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once per row, however often the body uses it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), 0)


def safe_date(year: Column, month: Column, day: Column) -> Column:
    """The calendar date, or null when there is no such day."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), two(month), F.lit("-"), two(day)).try_cast("date")


def plausible_year(c: Column, today: Column) -> Column:
    return F.year(c).between(F.year(today) - YEARS_BACK, F.year(today) + YEARS_AHEAD)


def _group(text: Column, pattern: str, n: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, n), F.lit(""))


def _number(text: Column, pattern: str, n: int) -> Column:
    return _group(text, pattern, n).try_cast("int")


def _numbers(text: Column, pattern: str) -> Column:
    """The three numbers of a notation as struct(a, b, c); the pattern is run on its own match only."""
    return let(F.regexp_extract(text, pattern, 0), lambda hit: F.struct(*[
        _number(hit, pattern, i).alias(name) for i, name in enumerate("abc", start=1)]))


def _full_year(year: Column, today: Column) -> Column:
    """Two-digit years lie within fifty years of today."""
    near = F.year(today)
    return (F.when(year > 99, year).when(2000 + year >= near + 50, 1900 + year).otherwise(2000 + year))


# Fixed notations: ISO, day first, year first, day and month name, month name and day.
ISO_FORM = r"^(\d{4})-(\d{2})-(\d{2})(?:[T ]\d{2}.*)?$"
DAY_FIRST = r"(?<!\d)(\d{1,2})[./-](\d{1,2})[./-](\d{4}|\d{2})(?!\d)"
YEAR_FIRST = r"(?<!\d)(\d{4})[./-](\d{1,2})[./-](\d{1,2})(?!\d)"
DAY_NAME = rf"(?<![\da-z])(\d{{1,2}})(?:st|nd|rd|th|er)?\.?[\s-]*(?:de\s+)?({_NAME_PATTERN})\.?,?[\s-]*(\d{{4}})(?!\d)"
NAME_DAY = rf"(?<![a-z])({_NAME_PATTERN})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})(?!\d)"

# A text that is one full day-first date and nothing else, and what every notation has somewhere.
DAY_ONLY = r"^\d{2}[./-]\d{2}[./-][1-9]\d{3}$"
DATED = r"\d{4}|\d[./-]\d{1,2}[./-]\d{2}"


def read_date(text: Column, today: Column) -> Column:
    """The date a text states in any supported notation; a bare time is not a date. No year gate.

    Feeds mostly hold plain ISO and day-first dates: these are cut out by place, the search is for all others.
    """
    def read(t: Column) -> Column:
        plain = strip_accents(F.lower(t))
        part = lambda at, size: F.substring(t, at, size)
        of = lambda *parts: F.concat(parts[0], F.lit("-"), parts[1], F.lit("-"), parts[2]).try_cast("date")
        as_iso = F.when(t.rlike(ISO_FORM), part(1, 10).try_cast("date"))
        as_day = F.coalesce(of(part(7, 4), part(4, 2), part(1, 2)), of(part(7, 4), part(1, 2), part(4, 2)))
        # Day-first notation applies after a leading year too, wherever the last number can be a month.
        as_year_first = let(_numbers(t, YEAR_FIRST), lambda n: F.when(
            n["c"] <= 12, safe_date(n["a"], n["c"], n["b"])).otherwise(safe_date(n["a"], n["b"], n["c"])))
        # Day first; the other way round only when that is the one that exists.
        as_numeric = let(_numbers(t, DAY_FIRST), lambda n: let(_full_year(n["c"], today), lambda y: F.coalesce(
            safe_date(y, n["b"], n["a"]), safe_date(y, n["a"], n["b"]))))
        as_named = safe_date(_number(plain, DAY_NAME, 3), month_number(_group(plain, DAY_NAME, 2)),
                             _number(plain, DAY_NAME, 1))
        as_flipped = safe_date(_number(plain, NAME_DAY, 3), month_number(_group(plain, NAME_DAY, 1)),
                               _number(plain, NAME_DAY, 2))
        searched = F.coalesce(F.when(t.rlike(YEAR_FIRST), as_year_first), as_numeric, as_named, as_flipped)
        return F.coalesce(as_iso, F.when(t.rlike(DAY_ONLY), as_day).when(t.rlike(DATED), searched))

    return let(F.trim(text), read)


def to_iso_date(text: Column, today: Column) -> Column:
    """`read_date`, refused when the year is one nobody could have meant."""
    return let(read_date(text, today), lambda d: F.when(plausible_year(d, today), d))


def date_from_title(title: Column, today: Column) -> Column:
    """The date a title ends with after a separator."""
    return to_iso_date(_group(F.trim(title), TITLE_END_DATE, 1), today)


def date_from_url(url: Column) -> Column:
    """The date in a URL slug: y-m-d, then d-month-y, then d-m-y; an impossible day is null."""
    ymd = r"(20\d{2})[-/](\d{1,2})[-/](\d{1,2})"
    by_name = r"(?U)\b(\d{1,2})[-_ ]([a-zàâçéèêëîïôûùüÿñæœ]+)[-_ ](20\d{2})\b"
    dmy = r"(?U)\b(\d{1,2})[-/](\d{1,2})[-/](20\d{2})\b"

    def read(slug: Column) -> Column:
        month = let(_group(slug, by_name, 2), lambda name: F.coalesce(
            *[month_number(F.substring(name, 1, n)) for n in (5, 4, 3)]))
        named = let(month, lambda m: F.when(m.isNotNull(), F.struct(
            safe_date(_number(slug, by_name, 3), m, _number(slug, by_name, 1)).alias("day"))))
        return (
            F.when(slug.rlike(ymd), let(_numbers(slug, ymd), lambda n: safe_date(n["a"], n["b"], n["c"])))
            .otherwise(let(named, lambda hit: F.when(hit.isNotNull(), hit["day"]).otherwise(
                let(_numbers(slug, dmy), lambda n: safe_date(n["c"], n["b"], n["a"]))))))

    return let(F.lower(F.coalesce(F.try_url_decode(url), url)), read)


def time_range(text: Column) -> Column:
    """"14h30 - 16:15" -> "14:30 - 16:15"; the first two clock times, or "" for none."""
    hits = F.slice(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CLOCK), F.lit(0)), 1, 2)
    label = lambda hit: F.concat_ws(":", F.lpad(F.regexp_extract(hit, CLOCK, 1), 2, "0"),
                                    F.regexp_extract(hit, CLOCK, 2))
    return F.array_join(F.transform(hits, label), " - ")


def today_in(tz: str = "Europe/Luxembourg", moment: Column | None = None) -> Column:
    """The local calendar day at a moment, now by default. Operators take `today` as a parameter; this is for callers."""
    moment = F.current_timestamp() if moment is None else moment
    return F.to_date(F.convert_timezone(F.current_timezone(), F.lit(tz), moment.cast("timestamp_ntz")))


def still_current(start: Column, end: Column, today: Column) -> Column:
    """Not finished: a stated end not yet passed, or no end and a start within the grace days."""
    return (end >= today) | (end.isNull() & (start >= F.date_sub(today, GRACE_DAYS)))


def relevant_from(start: Column, today: Column) -> Column:
    return F.greatest(start, today)


def date_note(start: Column, end: Column, today: Column) -> Column:
    """struct(kind, date): none, runsUntil the stated end, or startedOn when the end is not known."""
    kind = F.when(start >= today, "none").when(end >= today, "runsUntil").otherwise("startedOn")
    day = F.when(start >= today, F.lit(None).cast("date")).when(end >= today, end).otherwise(start)
    return F.struct(kind.alias("kind"), day.alias("date"))


def _weekday(c: Column) -> Column:
    """Monday 0 … Sunday 6."""
    return F.weekday(c)


def date_window(option: Column, today: Column) -> Column:
    """struct(date_from, date_to) of a date chip; an open chip gives two nulls."""
    to_saturday = F.when(_weekday(today) == 6, F.lit(-1)).otherwise(5 - _weekday(today))
    saturday = F.date_add(today, to_saturday.cast("int"))
    start = (F.when(option.isin("Today", "Next 7 days"), today)
             .when(option == "This weekend", F.greatest(saturday, today)))
    end = (F.when(option == "Today", today)
           .when(option == "This weekend", F.date_add(saturday, 1))
           .when(option == "Next 7 days", F.date_add(today, 7)))
    return F.struct(start.alias("date_from"), end.alias("date_to"))
