"""Kinds of sources behind one interface.

A kind is a function of (payloads, sources, today) that gives the candidate columns. `payloads`: (payload_id, source_id,
url, payload), a stored feed or page per row; `sources`: one row per source, with its kind, its defaults and, for listing
pages, its selectors as JSON.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..config.regions import DEFAULT_TOWN, SOURCE_CENTRE
from ..operators.filters import day
from ..operators.sets import union_feeds
from ..session import cut, kept
from . import feeds
from .curated import curated_details
from .sinks import upsert

Reader = Callable[[DataFrame, DataFrame, object], DataFrame]


def pages_of(payloads: DataFrame) -> DataFrame:
    """Payloads that are pages, as the page readers take them."""
    return payloads.select(F.col("payload_id").alias("page_id"), "source_id", "url", F.col("payload").alias("html"))


def read_json_ld(payloads: DataFrame, sources: DataFrame, today) -> DataFrame:
    return feeds.from_json_ld(pages_of(payloads), sources, today)


def read_listing_pages(payloads: DataFrame, sources: DataFrame, today) -> DataFrame:
    """Listing pages by their sources' selectors: one pass per different set of selectors, of which the registry has a few."""
    told = sources.filter(F.col("selectors").isNotNull())
    found = []
    for row in told.select("selectors").distinct().orderBy("selectors").collect():
        mine = told.filter(F.col("selectors") == row["selectors"])
        pages = pages_of(payloads).join(mine.select("source_id"), "source_id", "left_semi")
        found.append(feeds.from_listing_blocks(pages, sources, json.loads(row["selectors"]), today).select(*feeds.CANDIDATE))
    nothing = lambda: feeds.from_listing_blocks(pages_of(payloads.limit(0)), sources, {"item": "a", "title": "a", "date": "a"}, today)
    return union_feeds(*found) if found else nothing().select(*feeds.CANDIDATE)


def read_sitemap_pages(payloads: DataFrame, sources: DataFrame, today) -> DataFrame:
    """Pages that a sitemap names: their Event nodes; of pages without any, what OpenGraph says."""
    pages = pages_of(payloads)
    nodes = cut(feeds.json_ld_events(pages))         # pages are searched once, for what they state and for which state nothing
    stated = feeds.from_json_ld(pages, sources, today, nodes).select(*feeds.CANDIDATE)
    bare = pages.join(nodes.select("page_id").distinct(), "page_id", "left_anti")
    lite = feeds.from_open_graph(bare, today).join(bare.select("page_id", "source_id"), "page_id")
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    lite = feeds.with_source_defaults(lite, sources).select(
        "source_id", "external_id", "title", "description", "start_date", F.lit(None).cast("date").alias("end_date"), F.lit("").alias("time"),
        F.coalesce(some("town_default"), F.lit(DEFAULT_TOWN)).alias("town"), F.coalesce("lat_default", F.lit(SOURCE_CENTRE[0])).alias("lat"),
        F.coalesce("lng_default", F.lit(SOURCE_CENTRE[1])).alias("lng"), F.coalesce(some("image"), F.col("image_default"), F.lit("")).alias("image"))
    return union_feeds(stated, lite)


def curated_reader(prefix: str, communes: DataFrame) -> Reader:
    """Reader of curated detail pages, each a place that is open from today on; known again by the last part of its address."""
    def read(payloads: DataFrame, sources: DataFrame, today) -> DataFrame:
        pages = pages_of(payloads)
        found = curated_details(pages, communes).join(pages.select("page_id", "source_id"), "page_id")
        slug = F.regexp_extract(F.col("url"), r"([^/]*)/*$", 1)
        none = F.lit(None)
        return found.select(
            "source_id", F.concat(F.lit(prefix + ":"), slug).alias("external_id"), "title", "description", day(today).alias("start_date"),
            none.cast("date").alias("end_date"), F.lit("").alias("time"),
            F.coalesce(F.nullif("commune", F.lit("")), F.col("canton")).alias("town"), "lat", "lng", "image")
    return read


def readers(communes: DataFrame) -> dict[str, Reader]:
    """Every kind of source and its reader."""
    return {
        "ical": feeds.from_ical, "data_public_lu": feeds.from_open_data_json, "json_ld": read_json_ld, "html_scraper": read_listing_pages,
        "sitemap": read_sitemap_pages, "kids_in_lux": curated_reader("kids-in-lux", communes),
        "visit_luxembourg": curated_reader("visit-luxembourg", communes),
    }


def read_all(payloads: DataFrame, sources: DataFrame, today, communes: DataFrame) -> DataFrame:
    """(kind, candidate columns) of all payloads, each read by the kind of its source; sources of unknown kinds give none.

    Payloads are made and told their kind once, and written, each kind in files of its own.
    """
    known = readers(communes)
    kinds = kept(sources.filter(F.col("kind").isin(*known)))
    named = kinds.select("source_id", "kind").distinct()
    told = kept(payloads.join(named, "source_id"), "kind")
    parts = []
    for kind, read in known.items():
        own = told.filter(F.col("kind") == kind).drop("kind")
        parts.append(read(own, kinds.filter(F.col("kind") == kind), today).select(F.lit(kind).alias("kind"), *feeds.CANDIDATE))
    return union_feeds(*parts)


def refresh_curated(target: DataFrame, built: DataFrame) -> DataFrame:
    """The listing table after a curated source was read again: known pages take all that is new but keep their id and first
    day in the table, unknown ones are added. With `_written` as `upsert` gives it."""
    order: list[Column] = [F.col("start_date"), F.col("id")]
    return upsert(target, built, "external_id", insert_only=("id", "created_at"), order=order)
