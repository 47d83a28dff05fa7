"""Venues with a website: kinds, one per domain, those not yet covered."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import tags as tagging, urls
from ..functions.tags import tag
from .ranking import first_per


def venues(elements: DataFrame) -> DataFrame:
    """Elements of a venue kind that publish a website, with the kind's rank and label."""
    t = F.col("tags")
    site = F.trim(F.coalesce(F.nullif(tag(t, "website"), F.lit("")), tag(t, "contact:website"), F.lit("")))
    name = F.trim(F.coalesce(*[F.nullif(tag(t, k), F.lit("")) for k in ("name", "name:lb", "name:fr")], F.lit("")))
    found = elements.select("osm_id", "osm_type", "lat", "lng", site.alias("website"), name.alias("name"),
                            tagging.venue_kind(t).alias("_kind"))
    # A relation has no point of its own.
    point = lambda c: F.when(F.col("osm_type") != "relation", F.col(c))
    return found.filter(F.col("website").startswith("http") & F.col("_kind").isNotNull()).select(
        "osm_id", "osm_type", point("lat").alias("lat"), point("lng").alias("lng"), "website", "name",
        F.col("_kind.rank").alias("kind_rank"), F.col("_kind.label").alias("kind"))


def one_per_domain(df: DataFrame) -> DataFrame:
    """One venue per website domain: the best kind, then one with a name, then the first seen."""
    keyed = df.withColumn("domain", urls.domain(F.col("website"))).filter(F.col("domain") != "")
    return first_per(keyed, ["domain"], ["kind_rank", (F.col("name") == "").cast("int"), "osm_id"])


def uncovered(df: DataFrame, candidates: DataFrame) -> DataFrame:
    """Venues whose domain no accepted candidate source serves yet."""
    taken = candidates.select(urls.domain(F.col("website")).alias("domain")).filter(F.col("domain") != "").distinct()
    return df.withColumn("domain", urls.domain(F.col("website"))).join(taken, "domain", "left_anti")
