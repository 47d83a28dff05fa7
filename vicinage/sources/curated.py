"""Curated detail pages: title, commune, canton and position of one place per page."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import regions as R
from ..functions import geo, urls
from ..operators.towns import towns_in_text
from .feeds import meta, raw_meta


def curated_details(pages: DataFrame, communes: DataFrame,
                    cantons: dict[str, tuple[float, float]] = R.CANTON_CENTRES) -> DataFrame:
    """(page_id, url, title, description, image, commune, canton, lat, lng, precision).

    The commune stands in the title's brackets (the last known part, else the last part), else
    anywhere in the title. The position is the page's own map pin, else the commune's, the
    canton's, the country's. `communes`: (name, names, canton, lat, lng).
    """
    html = F.col("html")
    image = F.coalesce(raw_meta(html, "og:image:secure_url"), raw_meta(html, "og:image"), F.lit(""))
    rows = pages.select(
        "page_id", "url", F.trim(F.coalesce(meta(html, "og:title"), F.lit(""))).alias("_raw"),
        F.coalesce(meta(html, "og:description"), F.lit("")).alias("description"), image.alias("image"),
        urls.map_embed_point(html, geo.COUNTRY_BOX).alias("_pin")).filter(F.col("_raw") != "")
    inside = F.split(F.regexp_extract("_raw", r"\(([^)]+)\)", 1), "[-–—/,]")
    parts = F.filter(F.transform(inside, lambda p: F.trim(p)), lambda p: F.length(p) > 0)
    rows = rows.withColumns({"_parts": parts, "title": F.trim(F.regexp_replace("_raw", r"\s*\([^)]*\)\s*$", ""))})
    known = communes.groupBy("name").agg(F.min("canton").alias("_canton"), F.min_by("lat", "canton").alias("_lat"),
                                         F.min_by("lng", "canton").alias("_lng"))
    placed = (rows.select("page_id", F.posexplode("_parts").alias("_at", "name")).join(known.select("name"), "name")
              .groupBy("page_id").agg(F.max_by("name", "_at").alias("_bracket")))
    bare = rows.filter(F.size("_parts") == 0)
    named = towns_in_text(bare, communes, "page_id", "_raw").withColumnRenamed("town", "_named")
    found = rows.join(placed, "page_id", "left").join(named, "page_id", "left").withColumn(
        "commune", F.coalesce("_bracket", F.try_element_at("_parts", F.lit(-1)), "_named", F.lit("")))
    located = found.join(known.withColumnRenamed("name", "commune"), "commune", "left")
    centre = lambda i: F.try_element_at(F.create_map(*[
        x for k, v in cantons.items() for x in (F.lit(k), F.lit(v[i]))]), F.col("_canton"))
    precision = (F.when(F.col("_pin").isNotNull(), "address").when(F.col("_lat").isNotNull(), "commune").otherwise("fallback"))
    return located.select(
        "page_id", "url", "title", "description", "image", "commune", F.coalesce("_canton", F.lit("")).alias("canton"),
        F.coalesce("_pin.lat", "_lat", centre(0), F.lit(R.PLACEHOLDER_CENTRE[0])).alias("lat"),
        F.coalesce("_pin.lng", "_lng", centre(1), F.lit(R.PLACEHOLDER_CENTRE[1])).alias("lng"), precision.alias("precision"))
