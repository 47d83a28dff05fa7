"""How well a listing suits a profile."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..config import profiles as P
from ..config.regions import NEIGHBOURS


def _array_map(table: dict[str, list[str]]) -> Column:
    return F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))])


def has_profile(persona: Column) -> Column:
    return F.coalesce(~persona.isin("skipped", ""), F.lit(False))


def neighbour_cantons(preferred: Column, neighbours: dict[str, list[str]] = NEIGHBOURS) -> Column:
    """All cantons that border a preferred one."""
    table = _array_map(neighbours)
    none = F.array().cast("array<string>")
    return F.array_distinct(F.flatten(F.transform(
        preferred, lambda p: F.coalesce(F.try_element_at(table, p), none))))


def canton_affinity(canton: Column, preferred: Column, near: Column) -> Column:
    """3 at home, 1 next door, -0.5 elsewhere; 0 without a preference."""
    return (
        F.when(F.coalesce(F.size(preferred), F.lit(0)) <= 0, F.lit(0.0))
        .when(F.array_contains(preferred, canton), F.lit(P.POINTS["home_canton"]))
        .when(F.array_contains(near, canton), F.lit(P.POINTS["near_canton"]))
        .otherwise(F.lit(P.POINTS["far_canton"]))
    )


def interest_points(interests: Column, category: Column) -> Column:
    table = _array_map(P.INTEREST_CATEGORIES)
    hits = F.filter(interests, lambda i: F.coalesce(
        F.arrays_overlap(F.try_element_at(table, i), category), F.lit(False)))
    return F.greatest(F.coalesce(F.size(hits), F.lit(0)), F.lit(0)) * F.lit(P.POINTS["interest"])


def group_bounds(group: Column) -> Column:
    """Child age group "4-8" or "15+" as struct(low, high); an open top is 18."""
    plain = F.replace(group, F.lit("+"), F.lit(""))
    low = F.coalesce(F.regexp_extract(plain, r"^(\d+)", 1).try_cast("int"), F.lit(0))
    high = F.nullif(F.regexp_extract(plain, r"-(\d+)", 1).try_cast("int"), F.lit(0))
    return F.struct(low.alias("low"), F.coalesce(high, F.lit(18)).alias("high"))


def age_points(persona: Column, groups: Column, age_min: Column, age_max: Column) -> Column:
    met = F.filter(groups, lambda g: (age_max >= group_bounds(g)["low"]) & (age_min <= group_bounds(g)["high"]))
    count = F.greatest(F.coalesce(F.size(met), F.lit(0)), F.lit(0))
    return F.when(persona == "family", count * F.lit(P.POINTS["age_group"])).otherwise(F.lit(0.0))


def budget_points(budget: Column, price: Column) -> Column:
    """An unknown price is neutral: it is neither free nor too dear."""
    points = F.lit(0.0)
    for name, limit in P.BUDGET_LIMITS.items():
        within = F.lit(True) if limit is None else price <= limit
        inside = F.lit(P.POINTS["in_budget"])
        if name == "free":
            inside = F.when(price == 0, F.lit(P.POINTS["free_wanted"])).otherwise(inside)
        points = F.when(budget == name, F.when(price.isNull(), F.lit(0.0)).when(within, inside)
                        .otherwise(F.lit(P.POINTS["over_budget"]))).otherwise(points)
    return points


def match_score(profile: dict[str, Column], listing: dict[str, Column]) -> Column:
    """Sum of the parts, 0 for a skipped profile.

    `profile`: persona, interests, child_age_groups, preferred_cantons, near_cantons, budget;
    `listing`: category, age_min, age_max, canton, price_adult.
    """
    total = (
        interest_points(profile["interests"], listing["category"])
        + age_points(profile["persona"], profile["child_age_groups"], listing["age_min"], listing["age_max"])
        + canton_affinity(listing["canton"], profile["preferred_cantons"], profile["near_cantons"])
        + budget_points(profile["budget"], listing["price_adult"])
    )
    return F.when(has_profile(profile["persona"]), total).otherwise(F.lit(0.0))


def needs_to_filters(persona: Column, needs: Column) -> Column:
    """struct(wheelchair, sensory, free_parking) to switch on for a profile."""
    wanted = lambda name: F.coalesce(has_profile(persona) & F.array_contains(needs, name), F.lit(False))
    return F.struct(*[wanted(need).alias(flag) for need, flag in P.NEED_FILTERS.items()])


def title_words(title: Column) -> Column:
    """Significant words of a title: accent-free, five characters and up, no stopwords."""
    from .text import strip_accents

    plain = F.regexp_replace(strip_accents(F.lower(F.coalesce(title, F.lit("")))), r"[^a-z0-9\s]", " ")
    words = F.filter(F.split(plain, r"\s+"), lambda w: (F.length(w) >= P.TITLE_WORD_LENGTH)
                     & ~w.isin(P.TITLE_STOPWORDS))
    return F.array_distinct(words)
