"""Opening-hours notation: open, closed or unknown at a moment."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .dates import let

# Notation that is not evaluated, and the labels.
UNSUPPORTED = (r"(?i)\b(PH|SH|easter|sunrise|sunset|dawn|dusk|week\s+\d)\b|\d{4}|\bJan|\bFeb|\bMar|\bApr|\bMay"
               r"|\bJun|\bJul|\bAug|\bSep|\bOct|\bNov|\bDec")
DAYS = ["mo", "tu", "we", "th", "fr", "sa", "su"]
LABELS = {
    "open": {"en": "Open now", "de": "Jetzt geöffnet", "fr": "Ouvert", "lb": "Elo op"},
    "closed": {"en": "Closed", "de": "Geschlossen", "fr": "Fermé", "lb": "Zou"},
}
OFF_RULE = r"(?i)^(.*?)\s+(off|closed)$"
DAY_RULE = r"^([A-Za-z]{2}[A-Za-z,\s-]*?)\s+([\d:,\s-]+)$"
DAY_RANGE = r"^([A-Za-z]{2})\s*-\s*([A-Za-z]{2})$"
SPAN = r"^(\d{1,2}):(\d{2})\s*-\s*(\d{1,2}):(\d{2})$"


def _day(name: Column) -> Column:
    """1-based weekday of a two-letter name, 0 when it is not one."""
    return F.array_position(F.array(*[F.lit(d) for d in DAYS]), F.lower(F.trim(name)))


def _day_part(part: Column, day: Column, before: Column) -> Column:
    """struct(valid, covers, eve): "Fr-Mo" wraps around the week."""
    both = lambda d: F.struct(d.alias("first"), d.alias("last"))
    ends = let(F.trim(part), lambda p: F.when(p.rlike(DAY_RANGE), F.struct(
        _day(F.regexp_extract(p, DAY_RANGE, 1)).alias("first"), _day(F.regexp_extract(p, DAY_RANGE, 2)).alias("last"))
    ).otherwise(let(_day(p), both)))
    within = lambda e, d: F.pmod(d + 1 - e["first"], F.lit(7)) <= F.pmod(e["last"] - e["first"], F.lit(7))
    return let(ends, lambda e: F.struct(((e["first"] > 0) & (e["last"] > 0)).alias("valid"),
                                        within(e, day).alias("covers"), within(e, before).alias("eve")))


def _span_part(part: Column, minute: Column) -> Column:
    """struct(valid, inside, carried): `carried` is the part of an overnight span after midnight."""
    numbers = let(F.trim(part), lambda p: F.struct(p.rlike(SPAN).alias("fits"), *[
        F.regexp_extract(p, SPAN, i).try_cast("int").alias(name) for i, name in enumerate("abcd", start=1)]))
    span = let(numbers, lambda n: F.struct(
        (n["fits"] & (n["a"] <= 24) & (n["c"] <= 24) & (n["b"] <= 59) & (n["d"] <= 59)).alias("fine"),
        (n["a"] * 60 + n["b"]).alias("start"), (n["c"] * 60 + n["d"]).alias("end")))
    overnight = lambda s: s["start"] > s["end"]
    return let(span, lambda s: F.struct(
        F.coalesce(s["fine"], F.lit(False)).alias("valid"),
        F.when(overnight(s), minute >= s["start"]).otherwise((minute >= s["start"]) & (minute < s["end"])).alias("inside"),
        (overnight(s) & (minute < s["end"])).alias("carried")))


def is_open_at(value: Column, moment: Column, carry_overnight: bool = False) -> Column:
    """"open", "closed" or "unknown"; later rules override earlier ones.

    A span past midnight counts its early hours on the day it is written for; with
    `carry_overnight` they count on the following day instead.
    """
    asked = F.struct(F.trim(F.coalesce(value, F.lit(""))).alias("text"), F.weekday(moment).alias("day"),
                     F.pmod(F.weekday(moment) - 1, F.lit(7)).alias("before"),
                     (F.hour(moment) * 60 + F.minute(moment)).alias("minute"))
    return let(asked, lambda a: _state(a["text"], a["day"], a["before"], a["minute"], carry_overnight))


def _state(text: Column, today: Column, before: Column, minute: Column, carry_overnight: bool) -> Column:
    def parse(rule: Column) -> Column:
        kind = let(rule.rlike(OFF_RULE), lambda off: F.struct(off.alias("off"), (~off & rule.rlike(DAY_RULE)).alias("dayed")))
        texts = let(kind, lambda k: F.struct(
            k["off"].alias("off"),
            F.when(k["off"], F.regexp_extract(rule, OFF_RULE, 1)).when(k["dayed"], F.regexp_extract(rule, DAY_RULE, 1)).alias("days"),
            F.when(k["dayed"], F.regexp_extract(rule, DAY_RULE, 2)).otherwise(rule).alias("spans")))
        read = let(texts, lambda t: F.struct(
            t["off"].alias("off"), t["days"].isNull().alias("everyday"),
            F.transform(F.split(t["days"], ","), lambda p: _day_part(p, today, before)).alias("days"),
            F.transform(F.split(t["spans"], ","), lambda p: _span_part(p, minute)).alias("spans")))
        return let(read, lambda r: F.struct(
            ((r["everyday"] | F.forall(r["days"], lambda d: d["valid"]))
             & (r["off"] | F.forall(r["spans"], lambda s: s["valid"]))).alias("valid"),
            (r["everyday"] | F.exists(r["days"], lambda d: d["covers"])).alias("today"),
            (r["everyday"] | F.exists(r["days"], lambda d: d["eve"])).alias("eve"),
            r["off"].alias("off"),
            F.exists(r["spans"], lambda s: s["inside"]).alias("inside"),
            F.exists(r["spans"], lambda s: s["carried"]).alias("carried"),
        ))

    rules = F.transform(F.filter(F.transform(F.split(text, ";"), lambda r: F.trim(r)), lambda r: F.length(r) > 0), parse)

    def apply(state: Column, rule: Column) -> Column:
        same_day = rule["inside"] if carry_overnight else (rule["inside"] | rule["carried"])
        opened = rule["today"] & same_day
        if carry_overnight:
            opened = opened | (rule["eve"] & rule["carried"])
        return (F.when(rule["today"] & rule["off"], F.lit("closed"))
                .when(~rule["off"] & opened, F.lit("open")).otherwise(state))

    evaluated = lambda read: F.when(
        (F.size(read) > 0) & F.forall(read, lambda r: r["valid"]), F.aggregate(read, F.lit("closed"), apply)).otherwise(F.lit("unknown"))
    return (
        F.when(text == "", F.lit("unknown"))
        .when(text == "24/7", F.lit("open"))
        .when(text.rlike(UNSUPPORTED), F.lit("unknown"))
        .otherwise(let(rules, evaluated))
    )


def open_label(value: Column, lang: str, moment: Column) -> Column:
    """The printed state, or null when it is not known."""
    return let(is_open_at(value, moment), lambda state: F.when(state == "open", F.lit(LABELS["open"][lang])).when(
        state == "closed", F.lit(LABELS["closed"][lang])))
