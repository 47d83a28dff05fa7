"""Candidates to listings: clean, refuse, read hints, place, label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import regions as R
from ..functions import hints, text as tx
from ..operators.towns import canonical_towns
from ..session import with_once


def build_listings(candidates: DataFrame, sources: DataFrame, communes: DataFrame, now: Column,
                   compat: bool = True) -> tuple[DataFrame, DataFrame]:
    """(listings, refused). `candidates`: the feed columns; `sources`: (source_id, name, *_default).

    Section pages and explicit content are refused with a reason. Age, price and category come from
    the listing's own text first; a source default is only a starting point. With `compat` any
    default age counts as stated by the source, otherwise only one that narrows 0-99 does.
    """
    defaults = sources.select(
        "source_id", F.col("name").alias("source_name"), "canton_default", "town_default", "category_default",
        "age_min_default", "age_max_default")
    rows = candidates.join(defaults, "source_id", "left")
    site = tx.site_identity(F.coalesce("source_name", F.lit("")))
    cleaned = tx.normalise_text(F.col("title"))
    rows = with_once(rows, _title=cleaned, _site=site)
    rows = with_once(rows, _section=tx.is_not_an_event(F.col("_title"), F.col("_site")),
                     _name=tx.strip_site_tail(F.col("_title"), F.col("_site")))
    prose = tx.normalise_text(tx.strip_page_builder(F.coalesce("description", F.lit(""))))
    rows = with_once(rows, _prose=F.coalesce(tx.some_text(prose), F.col("_name")))
    rows = with_once(rows, _verdict=hints.assess(F.col("_name"), F.col("_prose")),
                     _text=hints.joined(F.col("_name"), F.col("_prose")))
    reason = F.when(F.col("_section"), "not an event").when(F.col("_verdict").isNotNull(), F.col("_verdict.reason"))
    rows = rows.withColumn("_reason", reason)
    refused = rows.filter(F.col("_reason").isNotNull()).select(
        "source_id", "external_id", F.col("_reason").alias("reason"), F.col("_verdict.matched").alias("matched"))

    good = with_once(
        rows.filter(F.col("_reason").isNull()), _age=hints.read_age(F.col("_text")), _price=hints.read_price(F.col("_text")),
        _town=F.coalesce(tx.some_text(F.col("town")), tx.some_text(F.col("town_default")), F.lit(R.DEFAULT_TOWN)))
    good = canonical_towns(good, communes, town="_town", canton="canton_default", out="_town")
    stated = F.col("_age.source") == "event"
    low, high = F.col("age_min_default"), F.col("age_max_default")
    if compat:
        from_source = (F.coalesce(low, F.lit(0)) != 0) | (F.coalesce(high, F.lit(0)) != 0)
    else:
        from_source = (F.coalesce(low, F.lit(0)) > 0) | (F.coalesce(high, F.lit(99)) < 99)
    free, adult = F.col("_price.is_free"), F.col("_price.adult")
    culture = F.array(F.lit("Culture"))
    key = F.concat_ws("\u0001", F.col("source_id").cast("string"), "external_id")
    listings = good.select(
        F.sha2(key, 256).alias("id"), tx.localized(F.col("_name")).alias("title"),
        tx.localized(tx.short_text(F.col("_prose"))).alias("short"), tx.localized(F.col("_prose")).alias("description"),
        F.lit("Event").alias("type"), F.coalesce(tx.some_text(F.col("canton_default")), F.lit(R.DEFAULT_CANTON)).alias("canton"),
        F.col("_town").alias("town"),
        hints.categorise(F.col("_text"), F.coalesce("category_default", culture)).alias("category"),
        F.when(stated, F.coalesce("_age.age_min", F.lit(0))).otherwise(F.coalesce(low, F.lit(0))).alias("age_min"),
        F.when(stated, F.coalesce("_age.age_max", F.lit(99))).otherwise(F.coalesce(high, F.lit(99))).alias("age_max"),
        F.when(stated, "event").when(from_source, "source").otherwise("unknown").alias("age_source"),
        "start_date", "end_date", "time", adult.alias("price_adult"), F.when(free, adult).alias("price_child"),
        free.alias("price_free"), F.col("_price.source").alias("price_source"),
        tx.localized(hints.price_label(adult, free)).alias("price_label"),
        tx.localized(F.lit("See venue")).alias("accessibility"), tx.localized(F.lit("Any weather")).alias("weather_fit"),
        "image", "lat", "lng", F.lit("source_default").alias("geocode_precision"), F.lit("source").alias("geocode_source"),
        F.lit(False).alias("bookable"), F.lit(True).alias("published"), F.lit(4.5).alias("rating"),
        F.lit(False).alias("featured"), F.lit(None).cast("date").alias("featured_until"), F.lit(0).cast("bigint").alias("view_count"),
        F.col("source_id").cast("string").alias("source_id"), "source_name", "external_id",
        now.alias("created_at"), now.alias("updated_at"),
    )
    return listings, refused
