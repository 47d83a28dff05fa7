"""Map-element tags: filters as predicates, classification, admission, scoring, names, ages."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, functions as F

from ..config import taxonomy as T
from .geo import EXTRACT_BOX, in_box

CLAUSE = re.compile(r'\["([^"]+)"(?:(!?[=~])"([^"]*)")?\]')


def tag(tags: Column, key: str) -> Column:
    return F.try_element_at(tags, F.lit(key))


def _clause(tags: Column, key: str, op: str, value: str) -> Column:
    actual = tag(tags, key)
    false = F.lit(False)
    if not op:
        return actual.isNotNull()
    if op == "=":
        return F.coalesce(actual == value, false)
    if op == "!=":
        return F.coalesce(actual != value, F.lit(True))
    found = F.coalesce(actual.rlike(value), false)
    return found if op == "~" else ~found


def filter_predicate(fragment: str, tags: Column) -> Column:
    """One tag-filter fragment as a predicate; a clause that cannot be read is never met."""
    clauses = CLAUSE.findall(fragment)
    if not clauses or CLAUSE.sub("", fragment).strip():
        return F.lit(False)
    return reduce(lambda a, b: a & b, [_clause(tags, *c) for c in clauses])


def matches(kind: str, tags: Column) -> Column:
    return reduce(lambda a, b: a | b, [filter_predicate(f, tags) for f in T.KINDS[kind][3]])


def has_name(tags: Column) -> Column:
    return F.coalesce(*[F.nullif(tag(tags, k), F.lit("")) for k in T.NAME_KEYS]).isNotNull()


def admits(kind: str, tags: Column, lat: Column, lng: Column,
           osm_type: Column | None = None, area: Column | None = None) -> Column:
    """Access, name, country, shape and size gates of a kind."""
    options = T.KINDS[kind][4]
    closed = ["private", "no"] + ([] if options.get("allow_customers") else ["customers"])
    ok = ~F.coalesce(tag(tags, "access").isin(closed), F.lit(False))
    if options.get("require_name"):
        ok = ok & has_name(tags)
    south, north, west, east = EXTRACT_BOX
    near = in_box(lat, lng, (south - 0.2, north + 0.2, west - 0.2, east + 0.2))
    ok = ok & F.coalesce(near, F.lit(True))
    if options.get("relations_only") and osm_type is not None:
        ok = ok & (osm_type == "relation")
    if options.get("min_area_m2") and area is not None:
        ok = ok & (F.coalesce(area, F.lit(0.0)) >= options["min_area_m2"])
    return ok


def classify(tags: Column, lat: Column, lng: Column,
             osm_type: Column | None = None, area: Column | None = None) -> Column:
    """The first kind, in taxonomy order, that matches and admits; null when none does.

    Single-clause filters are looked up by "key=value" for all tags of an element at once; only the
    filters with several clauses are spelled out. The gates then drop ranks, and the lowest one left wins.
    """
    kinds = list(T.KINDS)
    single: dict[str, list[int]] = {}
    several = []
    for rank, kind in enumerate(kinds, start=1):
        for fragment in T.KINDS[kind][3]:
            clauses = CLAUSE.findall(fragment)
            if len(clauses) == 1 and clauses[0][1] == "=":
                single.setdefault(f"{clauses[0][0]}={clauses[0][2]}", []).append(rank)
            else:
                several.append(F.when(filter_predicate(fragment, tags), F.lit(rank)))
    table = F.from_json(F.lit(json.dumps(single)), "map<string,array<int>>")
    looked_up = F.flatten(F.transform(F.map_entries(tags), lambda e: F.coalesce(
        F.try_element_at(table, F.concat(e["key"], F.lit("="), e["value"])), F.array().cast("array<int>"))))
    ranks = F.concat(looked_up, F.array_compact(F.array(*several)))

    having = lambda option: [r for r, k in enumerate(kinds, start=1) if T.KINDS[k][4].get(option)]
    access = F.coalesce(tag(tags, "access"), F.lit(""))
    named = has_name(tags)
    south, north, west, east = EXTRACT_BOX
    near = F.coalesce(in_box(lat, lng, (south - 0.2, north + 0.2, west - 0.2, east + 0.2)), F.lit(True))

    def admitted(rank: Column) -> Column:
        ok = (access != "customers") | rank.isin(having("allow_customers"))
        ok = ok & (named | ~rank.isin(having("require_name")))
        if osm_type is not None:
            ok = ok & ((osm_type == "relation") | ~rank.isin(having("relations_only")))
        if area is not None:
            for kind, spec in T.KINDS.items():
                if spec[4].get("min_area_m2"):
                    ok = ok & ((F.coalesce(area, F.lit(0.0)) >= spec[4]["min_area_m2"])
                               | (rank != kinds.index(kind) + 1))
        return ok

    open_ = near & ~access.isin("private", "no")
    first = F.array_min(F.filter(ranks, admitted))
    names = F.from_json(F.lit(json.dumps(kinds)), "array<string>")
    return F.when(open_, F.try_element_at(names, first))


def by_kind(kind: Column, values: dict, default: object = None) -> Column:
    """Constant lookup by kind."""
    kind_of_value = "int" if isinstance(next(iter(values.values())), int) else "string"
    table = F.from_json(F.lit(json.dumps(values)), f"map<string,{kind_of_value}>")
    return F.coalesce(F.try_element_at(table, kind), F.lit(default).cast(kind_of_value))


def group_of(kind: Column) -> Column:
    return by_kind(kind, {k: v[0] for k, v in T.KINDS.items()})


def label_of(kind: Column, lang: str = "de") -> Column:
    at = ("lb", "de", "fr", "en").index(lang)
    return by_kind(kind, {k: v[2][at] for k, v in T.KINDS.items()})


def layer_of(kind: Column) -> Column:
    return (F.when(kind.isin(T.LAYERS["hiking"]), "hiking").when(kind.isin(T.LAYERS["cycling"]), "cycling")
            .otherwise("other"))


def family_score(tags: Column, kind: Column) -> Column:
    """Base score of the kind plus the points its tags earn, held within 0-100."""
    base = by_kind(kind, {k: v[1] for k, v in T.KINDS.items()})
    earned = F.lit(0)
    for key, pattern, points in T.SCORE_RULES:
        value = tag(tags, key)
        met = value.isNotNull() if pattern is None else F.coalesce(value.rlike("(?i)" + pattern), F.lit(False))
        earned = earned + F.when(met, F.lit(points)).otherwise(F.lit(0))
    return F.greatest(F.lit(0), F.least(F.lit(100), base + earned))


def pick_name(tags: Column, fallback: Column) -> Column:
    return F.coalesce(*[F.trim(F.nullif(tag(tags, k), F.lit(""))) for k in T.NAME_KEYS], fallback)


def localised_tag(tags: Column, prefix: str, fallback: Column | None = None) -> Column:
    """struct(lb, de, fr, en) of a tag family; English also takes the bare key. `fallback` fills gaps."""
    stated = {lang: F.nullif(tag(tags, f"{prefix}:{lang}"), F.lit("")) for lang in ("lb", "de", "fr", "en")}
    stated["en"] = F.coalesce(stated["en"], F.nullif(tag(tags, prefix), F.lit("")))
    last = F.lit("") if fallback is None else fallback
    return F.struct(*[F.coalesce(v, last).alias(k) for k, v in stated.items()])


def age_range(tags: Column, kind: Column) -> Column:
    """struct(age_min, age_max): stated tags win (open top is 14), else the kind's usual ages."""
    low = F.coalesce(tag(tags, "min_age").try_cast("int"), F.lit(0))
    high = F.coalesce(tag(tags, "max_age").try_cast("int"), F.lit(0))
    usual_low = by_kind(kind, {k: v[0] for k, v in T.AGE_DEFAULTS.items()}, 0)
    usual_high = by_kind(kind, {k: v[1] for k, v in T.AGE_DEFAULTS.items()}, 99)
    stated = (low != 0) | (high != 0)
    top = F.when(high == 0, F.lit(14)).otherwise(high)
    return F.struct(F.when(stated, low).otherwise(usual_low).alias("age_min"),
                    F.when(stated, top).otherwise(usual_high).alias("age_max"))


def amenities(tags: Column) -> dict[str, Column]:
    """Flags and contact texts a place row carries."""
    text = lambda *keys: F.coalesce(*[F.nullif(tag(tags, k), F.lit("")) for k in keys], F.lit(""))
    among = lambda key, *values: F.coalesce(tag(tags, key).isin(*values), F.lit(False))
    return {
        "website_url": text("website", "contact:website"), "phone": text("phone", "contact:phone"),
        "opening_hours": text("opening_hours"), "wikidata": text("wikidata"), "fee": tag(tags, "fee"),
        "wheelchair": among("wheelchair", "yes", "designated"),
        "toilets": among("toilets", "yes") | among("amenity", "toilets"),
        "drinking_water": among("drinking_water", "yes"), "shade": among("shade", "yes", "partial"),
    }


def venue_kind(tags: Column) -> Column:
    """struct(rank, label) of the best venue kind the tags name; null for none."""
    return F.coalesce(*[
        F.when(tag(tags, key) == value, F.struct(F.lit(i).alias("rank"), F.lit(label).alias("label")))
        for i, (key, value, label) in enumerate(T.VENUE_KINDS)])
