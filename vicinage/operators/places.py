"""Map elements to the places table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import tags as tagging, text as tx
from ..session import with_once
from .ranking import first_per
from .spatial import assign_region


def classify(elements: DataFrame) -> DataFrame:
    """Elements with the first kind that matches and admits them; the rest fall away."""
    area = F.col("area_m2") if "area_m2" in elements.columns else None
    kind = tagging.classify(F.col("tags"), F.col("lat"), F.col("lng"), F.col("osm_type"), area)
    return with_once(elements, kind=kind).filter(F.col("kind").isNotNull())


def to_places(classified: DataFrame) -> DataFrame:
    """Classified elements as place rows: names, scores, ages, amenities."""
    t, kind = F.col("tags"), F.col("kind")
    name = tagging.pick_name(t, tagging.label_of(kind, "de"))
    ages = tagging.age_range(t, kind)
    letter = F.substring("osm_type", 1, 1)
    return classified.select(
        F.concat(F.lit("osm:"), "osm_type", F.lit("/"), F.col("osm_id").cast("string")).alias("id"),
        F.concat(tx.slugify(name), F.lit("-"), letter, F.col("osm_id").cast("string")).alias("slug"),
        kind, tagging.group_of(kind).alias("group"), name.alias("name"),
        tagging.localised_tag(t, "name", name).alias("title"), tagging.localised_tag(t, "description").alias("description"),
        F.bround("lat", 6).alias("lat"), F.bround("lng", 6).alias("lng"),
        ages["age_min"].alias("age_min"), ages["age_max"].alias("age_max"),
        tagging.family_score(t, kind).alias("family_score"),
        F.lit("osm").alias("source"), "osm_type", "osm_id", t.alias("tags_raw"),
        *[c.alias(k) for k, c in tagging.amenities(t).items()],
        tagging.has_name(t).alias("named"),
    )


def with_commune(places: DataFrame, regions: DataFrame, size: float = 0.05) -> DataFrame:
    """Commune by outline; unnamed places are called "label, commune"."""
    out = assign_region(places, regions, size=size, out="commune") \
        .withColumn("commune", F.coalesce("commune", F.lit("")))
    renamed = F.when(~F.col("named") & (F.col("commune") != ""),
                     F.concat("name", F.lit(", "), "commune")).otherwise(F.col("name"))
    return out.withColumn("name", renamed)


def dedupe_places(places: DataFrame, sequence: str = "osm_id") -> DataFrame:
    """One place per kind, lower-case name and rounded position; the best score wins, then the first.

    Rows without a position are only the same as themselves.
    """
    located = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    keyed = places.withColumns({
        "_name": F.when(located, F.lower("name")).otherwise(F.col("id").cast("string")),
        "_lat": F.bround("lat", 4), "_lng": F.bround("lng", 4)})
    return first_per(keyed, ["kind", "_name", "_lat", "_lng"], [F.col("family_score").desc(), sequence]) \
        .drop("_name", "_lat", "_lng")


def build_places(elements: DataFrame, regions: DataFrame) -> DataFrame:
    """The whole build: classify, normalise, locate, dedupe."""
    return dedupe_places(with_commune(to_places(classify(elements)), regions))


def route_ways(relations: DataFrame, ways: DataFrame) -> DataFrame:
    """Members of routes with their position and the way's shape: (route_id, pos, way_id, points)."""
    members = relations.select("route_id", F.posexplode("members").alias("pos", "way_id"))
    return members.join(ways, "way_id")
