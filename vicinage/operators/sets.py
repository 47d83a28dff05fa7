"""Unions, differences and order-keeping distinct."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .ranking import first_per


def union_feeds(*feeds: DataFrame) -> DataFrame:
    """All feed kinds as one listing table; a kind may lack columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds)


def others(df: DataFrame, picked: DataFrame, key: str = "id") -> DataFrame:
    """Everything not picked."""
    return df.join(picked.select(key).distinct(), key, "left_anti")


def for_audit(listings: DataFrame, places: DataFrame, listing_text: list[str], place_text: list[str]) -> DataFrame:
    """Both stores as (collection, id, text) for one safety pass."""
    text = lambda cols: F.concat_ws(" ", *[F.nullif(F.col(c).cast("string"), F.lit("")) for c in cols])
    a = listings.select(F.lit("listings").alias("collection"), F.col("id").cast("string").alias("id"),
                        text(listing_text).alias("text"))
    b = places.select(F.lit("places").alias("collection"), F.col("id").cast("string").alias("id"),
                      text(place_text).alias("text"))
    return a.unionByName(b)


def distinct_in_order(df: DataFrame, keys: list[str], position: str = "position") -> DataFrame:
    """Each key once, at its first position."""
    return first_per(df, keys, [position])


def spellings(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct, sorted spelling set from single and array columns."""
    arrays = [F.col(c) if df.schema[c].dataType.typeName() == "array" else F.array(c) for c in columns]
    merged = F.filter(F.array_distinct(F.array_compact(F.concat(*arrays))), lambda s: F.length(F.trim(s)) > 0)
    return df.withColumn("names", F.array_sort(merged))
