"""Dates in words, urls and titles; opening hours."""

from datetime import date, datetime

from pyspark.sql import functions as F

from vicinage.functions import dates, opening


def today():
    return F.lit("2026-09-28").cast("date")


def test_written_dates(ask):
    cases = {
        "2026-07-06": date(2026, 7, 6), "2026-07-06T19:30:00Z": date(2026, 7, 6), "06/07/2026": date(2026, 7, 6), "24.06.2026": date(2026, 6, 24),
        "10/24/2026 12:00:00 AM": date(2026, 10, 24), "24. Juni 2026": date(2026, 6, 24), "24 juin 2026": date(2026, 6, 24), "5. Mäerz 2026": date(2026, 3, 5),
        "12 août 2026": date(2026, 8, 12), "Freideg, 3. Abrëll 2026 um 20:00": date(2026, 4, 3), "June 24, 2026": date(2026, 6, 24), "13:15": None,
        "2926-09-26": None, "31.02.2026": None, "gläich": None, "4 Sept 2026": date(2026, 9, 4), "1.1.27": date(2027, 1, 1), "2026/07/06": date(2026, 6, 7),
    }
    assert dict(zip(cases, ask(list(cases), "t string", dates.to_iso_date(F.col("t"), today())))) == cases


def test_dates_in_titles(ask):
    cases = {"Le coin des mini monstres | 24.10.2026 13:15": date(2026, 10, 24), "Lunchtime at Mudam – 4 Sept 2026": date(2026, 9, 4),
             "Sommersaison (21/03/2026 – 15/10/2026)": None, "24.10.2026": None}
    assert dict(zip(cases, ask(list(cases), "t string", dates.date_from_title(F.col("t"), today())))) == cases


def test_dates_in_urls(ask):
    cases = {"https://x.lu/28-aug-2026": date(2026, 8, 28), "https://x.lu/8-ao%C3%BBt-2026": date(2026, 8, 8), "https://x.lu/2026/08/28/fest": date(2026, 8, 28),
             "https://x.lu/28-08-2026": date(2026, 8, 28), "https://x.lu/2026-02-31": None, "https://x.lu/fest": None, "https://x.lu/2-xyz-2026": None}
    assert dict(zip(cases, ask(list(cases), "t string", dates.date_from_url(F.col("t"))))) == cases


def test_not_finished(ask):
    d = date.fromisoformat
    rows = [(d("2026-08-31"), d("2026-10-31")), (d("2026-09-01"), d("2026-09-27")), (d("2026-09-25"), None), (d("2026-09-24"), None), (d("2026-10-01"), None)]
    got = ask(rows, "s date, e date", dates.still_current(F.col("s"), F.col("e"), today()))
    assert [bool(g) for g in got] == [True, False, True, False, True]


def test_opening_hours(ask):
    mon = datetime(2026, 9, 28)
    at = lambda day, hour, minute=0: mon.replace(day=28 + day if day < 3 else 28, hour=hour, minute=minute)
    cases = [("Mo-Fr 09:00-18:00", at(0, 9), "open"), ("Mo-Fr 09:00-18:00", at(0, 18), "closed"), ("24/7", at(0, 3), "open"), ("PH off", at(0, 3), "unknown"),
             ("Mo-Su 10:00-18:00; Mo off", at(0, 12), "closed"), ("Su-Tu 10:00-12:00", at(1, 11), "open"), ("We 10:00-12:00", at(1, 11), "closed"),
             ("22:00-02:00", at(0, 1), "open"), ("09:00-12:00,14:00-18:00", at(0, 13), "closed"), ("Mo 25:00-26:00", at(0, 9), "unknown"),
             ("", at(0, 9), "unknown"), (None, at(0, 9), "unknown"), ("Mo-Fr 09:00-18:00; nach Absprache", at(0, 9), "unknown"), ("mo-FR 9:00-18:00", at(0, 10), "open")]
    got = ask([(a, b) for a, b, _ in cases], "v string, m timestamp", opening.is_open_at(F.col("v"), F.col("m")))
    assert got == [c for _, _, c in cases]
    # The early hours of a span past midnight: on the day it is written for, or carried to the next.
    night = [("Mo 22:00-02:00", at(0, 1)), ("Mo 22:00-02:00", at(1, 1))]
    assert ask(night, "v string, m timestamp", opening.is_open_at(F.col("v"), F.col("m"))) == ["open", "closed"]
    assert ask(night, "v string, m timestamp", opening.is_open_at(F.col("v"), F.col("m"), carry_overnight=True)) == ["closed", "open"]
