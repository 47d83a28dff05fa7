"""Discovery results to the source registry, and the switch for sources proven to work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config.taxonomy import VENUE_CATEGORIES
from ..functions import urls
from ..operators.spatial import nearest
from ..operators.towns import match_commune
from ..operators.venues import uncovered

COMMUNE_CATEGORIES = ["Culture", "Festivals"]


def _categories(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _home(website: Column, example: Column) -> Column:
    return F.concat(F.lit("https://"), urls.netloc(F.coalesce(F.nullif(website, F.lit("")), example)), F.lit("/"))


def commune_sources(accepted: DataFrame, communes: DataFrame) -> DataFrame:
    """Registry rows for accepted commune sites that name one commune; the rest are left out."""
    matched = match_commune(accepted, communes, "Gemeinde").filter(F.col("commune").isNotNull())
    c = communes.select(F.col("name").alias("commune"), "canton", "lat", "lng")
    site, example = F.col("Website"), F.col("Beispiel-URL")
    return matched.join(c, "commune").select(
        F.concat("commune", F.lit(" (Gemeng) — Events")).alias("name"), F.lit("json_ld").alias("kind"),
        urls.events_section_url(site, example).alias("url"), F.col("canton").alias("canton_default"),
        F.col("commune").alias("town_default"), _categories(COMMUNE_CATEGORIES).alias("category_default"),
        F.lit(0).alias("age_min_default"), F.lit(99).alias("age_max_default"), F.col("lat").alias("lat_default"),
        F.col("lng").alias("lng_default"), F.lit("commune").alias("geocode_precision_default"),
        _home(site, example).alias("homepage"))


def venue_sources(accepted: DataFrame, commune_sites: DataFrame, communes: DataFrame) -> DataFrame:
    """Registry rows for located venues no commune source serves, filed under the nearest commune.

    `accepted`: (Name, Art, Website, Beispiel-URL, lat, lng); `communes` has a unique commune_id.
    """
    site = F.coalesce(F.nullif(F.col("Website"), F.lit("")), F.col("Beispiel-URL"))
    own = uncovered(accepted.withColumn("website", site), commune_sites.withColumn("website", site))
    located = own.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    at = nearest(located, communes, "commune_id").select("lat", "lng", "commune_id")
    c = communes.select("commune_id", F.col("name").alias("commune"), "canton")
    kinds = F.create_map(*[x for k, v in VENUE_CATEGORIES.items() for x in (F.lit(k), _categories(v))])
    return located.join(at, ["lat", "lng"]).join(c, "commune_id").select(
        F.concat("Name", F.lit(" ("), "Art", F.lit(")")).alias("name"), F.lit("json_ld").alias("kind"),
        F.col("Beispiel-URL").alias("url"), F.col("canton").alias("canton_default"), F.col("commune").alias("town_default"),
        F.coalesce(F.try_element_at(kinds, F.col("Art")), _categories(["Culture"])).alias("category_default"),
        F.lit(0).alias("age_min_default"), F.lit(99).alias("age_max_default"), F.col("lat").alias("lat_default"),
        F.col("lng").alias("lng_default"), F.lit("venue").alias("geocode_precision_default"),
        F.concat(F.lit("https://"), urls.domain(site), F.lit("/")).alias("homepage"))


def activation(sources: DataFrame, proven: DataFrame) -> DataFrame:
    """(name, outcome, active, max_pages): what switching on the proven sources would do.

    Names match exactly. `proven`: (name, max_pages or null); `sources`: (name, active, max_pages).
    """
    stored = sources.select("name", F.col("active").alias("_on"), F.col("max_pages").alias("_pages"), F.lit(True).alias("_here"))
    both = proven.join(stored, "name", "left")
    off = ~F.coalesce("_on", F.lit(False))
    budget = F.col("max_pages").isNotNull() & ~F.col("max_pages").eqNullSafe(F.col("_pages"))
    outcome = F.when(F.col("_here").isNull(), "missing").when(off | budget, "change").otherwise("already")
    return both.select("name", outcome.alias("outcome"), F.col("_here").isNotNull().alias("active"),
                       F.coalesce("max_pages", "_pages").alias("max_pages"))


def apply_activation(sources: DataFrame, plan: DataFrame) -> DataFrame:
    changes = plan.filter(F.col("outcome") == "change").select("name", F.lit(True).alias("_on"), F.col("max_pages").alias("_pages"))
    return sources.join(changes, "name", "left").withColumns({
        "active": F.coalesce("_on", "active"), "max_pages": F.coalesce("_pages", "max_pages")}).drop("_on", "_pages")
