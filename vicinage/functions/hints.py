"""What a text says about age, price, category and safety."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..config import vocabulary as V

# Java patterns: U makes \w, \b and case folding Unicode-aware.
_IU = "(?iU)"


def joined(*parts: Column) -> Column:
    """All stated parts as one text; empty and missing parts leave no gap."""
    return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])


def all_languages(*fields: Column) -> Column:
    """Every language of every localized field as one text."""
    return joined(*[f[lang] for f in fields for lang in ("en", "de", "fr")])


def assess(*parts: Column) -> Column:
    """struct(reason, matched) when the text must not be shown, else null."""
    allowed = _IU + r"(?<!\w)(?:" + "|".join(V.ALLOWED) + r")(?!\w)"
    explicit = _IU + r"(?<!\w)(?:" + "|".join(V.EXPLICIT) + r")(?!\w)"
    masked = F.regexp_replace(joined(*parts), allowed, " ")
    hit = F.regexp_extract(masked, explicit, 0)
    return F.when(F.length(hit) > 0, F.struct(F.lit("explicit").alias("reason"), hit.alias("matched")))


def categorise(text: Column, default: Column | None = None) -> Column:
    """At most two categories: a specific default wins, else the text's signals in order, else the default."""
    fallback = F.array(*[F.lit(x) for x in V.CATEGORY_FALLBACK])
    found = F.slice(F.array_compact(F.array(*[
        F.when(text.rlike(_IU + V.CATEGORY_SIGNALS[name]), F.lit(name)) for name in V.CATEGORY_ORDER])), 1, 2)
    if default is None:
        return F.when(F.size(found) > 0, found).otherwise(fallback)
    generic = F.array(*[F.lit(x) for x in V.GENERIC_CATEGORIES])
    stated = F.when(F.size(default) > 0, default).otherwise(fallback)
    chosen = F.size(F.array_except(stated, generic)) > 0
    return F.when(chosen, stated).when(F.size(found) > 0, found).otherwise(stated)


def _number(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, _IU + pattern, group).try_cast("int")


def read_age(text: Column) -> Column:
    """struct(age_min, age_max, source): a stated range, lower bound or upper bound; else unknown.

    Anniversaries are masked first; a reversed range says nothing at all.
    """
    masked = F.regexp_replace(text, _IU + V.NOT_AN_AGE, " ")
    low = F.coalesce(_number(masked, V.AGE_RANGE, 1), _number(masked, V.AGE_RANGE, 3))
    high = F.coalesce(_number(masked, V.AGE_RANGE, 2), _number(masked, V.AGE_RANGE, 4))
    start, stop = _number(masked, V.AGE_FROM, 1), _number(masked, V.AGE_UP_TO, 1)
    none = F.lit(None).cast("int")
    hint = lambda a, b, source: F.struct(a.alias("age_min"), b.alias("age_max"), F.lit(source).alias("source"))
    return (
        F.when(low.isNotNull() & (low <= high), hint(low, high, "event"))
        .when(low.isNotNull(), hint(none, none, "unknown"))
        .when(start.isNotNull(), hint(start, none, "event"))
        .when(stop.isNotNull(), hint(none, stop, "event"))
        .otherwise(hint(none, none, "unknown"))
    )


def read_price(text: Column) -> Column:
    """struct(adult, is_free, source): free admission, else the first amount that is an entrance fee.

    Each amount is judged with the text before and after it, so the text is walked once by
    amounts: piece, amount, piece, amount, ..., keeping the position of each amount.
    """
    amount = _IU + V.AMOUNT
    before, after = V.FEE_CONTEXT
    text = F.coalesce(text, F.lit(""))
    amounts = F.regexp_extract_all(text, F.lit(amount), F.lit(0))
    pieces = F.slice(F.split(text, amount, -1), F.lit(1), F.size(amounts))
    number = r"(\d{1,3})(?:[.,](\d{1,2}))?"

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["piece"])
        end = start + F.length(pair["amount"])
        from_ = F.greatest(start - before, F.lit(0))
        window = F.substring(text, from_ + 1, end + after - from_)
        value = F.concat_ws(".", F.regexp_extract(pair["amount"], number, 1),
                            F.rpad(F.regexp_extract(pair["amount"], number, 2), 2, "0")).try_cast("double")
        fits = (value > 0) & (value <= V.MAX_FEE) & ~window.rlike(_IU + V.NOT_A_FEE)
        return F.struct(end.alias("at"), F.coalesce(state["fee"], F.when(fits, value)).alias("fee"))

    start_state = F.struct(F.lit(0).alias("at"), F.lit(None).cast("double").alias("fee"))
    pairs = F.zip_with(pieces, amounts, lambda p, a: F.struct(p.alias("piece"), a.alias("amount")))
    fee = F.when(F.size(amounts) > 0, F.aggregate(pairs, start_state, step)["fee"])
    hint = lambda adult, free, source: F.struct(
        adult.alias("adult"), F.lit(free).alias("is_free"), F.lit(source).alias("source"))
    return (
        F.when(text.rlike(_IU + V.FREE_ADMISSION), hint(F.lit(0.0), True, "event"))
        .when(fee.isNotNull(), hint(fee, False, "event"))
        .otherwise(hint(F.lit(None).cast("double"), False, "unknown"))
    )


def price_label(adult: Column, is_free: Column) -> Column:
    return (F.when(is_free, F.lit(V.FREE_LABEL))
            .when(adult.isNotNull(), F.format_string("%.2f €", adult))
            .otherwise(F.lit(V.UNKNOWN_PRICE_LABEL)))


def age_label(age_min: Column, age_max: Column, stated: Column) -> Column:
    """The printed range, or "" when nobody stated one."""
    return (F.when(~stated, F.lit(""))
            .when((age_min <= 0) & (age_max >= 99), F.lit("0-99"))
            .otherwise(F.concat_ws("-", age_min.cast("string"), age_max.cast("string"))))


def stated_age_label(age_min: Column, age_max: Column) -> Column:
    """"4-10", "ab 4" or "bis 10" of a hint with open ends."""
    return (F.when(age_min.isNotNull() & age_max.isNotNull(), F.concat_ws("-", age_min, age_max))
            .when(age_min.isNotNull(), F.concat(F.lit("ab "), age_min.cast("string")))
            .when(age_max.isNotNull(), F.concat(F.lit("bis "), age_max.cast("string"))))


def parse_age_range(text: Column) -> Column:
    """Curated notation "2-12", "3+", "alle" as struct(age_min, age_max); anything else is 0-99."""
    t = F.coalesce(text, F.lit(""))
    low = F.regexp_extract(t, r"^\s*(\d+)\s*-\s*(\d+)", 1).try_cast("int")
    high = F.regexp_extract(t, r"^\s*(\d+)\s*-\s*(\d+)", 2).try_cast("int")
    plus = F.regexp_extract(t, r"^\s*(\d+)\s*\+", 1).try_cast("int")
    pair = lambda a, b: F.struct(a.alias("age_min"), b.alias("age_max"))
    return (F.when(low.isNotNull(), pair(low, high))
            .when(plus.isNotNull(), pair(plus, F.lit(99)))
            .otherwise(pair(F.lit(0), F.lit(99))))


def age_window(chip: Column) -> Column:
    """Age chip "4-6" as struct(age_min, age_max); open chips give nulls."""
    form = r"^(\d{1,2})-(\d{1,2})$"
    t = F.trim(chip)
    return F.struct(F.regexp_extract(t, form, 1).try_cast("int").alias("age_min"),
                    F.regexp_extract(t, form, 2).try_cast("int").alias("age_max"))


def radius_window(chip: Column, located: Column) -> Column:
    """Distance chip "10 km" as struct(radius_km, needs_location); a radius needs a position."""
    km = F.regexp_extract(F.trim(chip), r"(?i)^(\d{1,3})\s*km$", 1).try_cast("int")
    return F.struct(F.when(located, km).alias("radius_km"), (km.isNotNull() & ~located).alias("needs_location"))


def booking_total(adults: Column, children: Column, price_adult: Column, price_child: Column) -> Column:
    """Null unless both prices are known."""
    return adults * price_adult + children * price_child
