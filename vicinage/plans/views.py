"""The tables the checks run on: the driver's parquet files and the views derived from them.

Each view is one SQL text used by both engines, so an oracle can restate it. `Tables` gives the
same views to Spark, plus the typed forms (arrays, structs, tag maps) the operators take.
"""

from __future__ import annotations

import os
import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

NAMES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
         "embeddings", "pages", "benchmark", "labels", "conversations"]

# The fixed clock and centre of the checks.
TODAY = "1998-06-15"
CENTRE = (49.75, 6.10)

_D = "CAST({} AS DOUBLE)".format

VIEWS = {
    "listings_v": f"""
SELECT o.o_orderkey AS id, c.c_name AS title_en, concat(c.c_name, ' ', o.o_orderpriority) AS title_de,
  c.c_name AS title_fr, o.o_orderpriority AS short_en,
  CASE o.o_orderkey % 4 WHEN 0 THEN 'Event' WHEN 1 THEN 'Indoor' WHEN 2 THEN 'Outdoor' ELSE 'Educational' END AS type,
  n.n_name AS canton, concat(n.n_name, ' Stadt') AS town,
  CASE o.o_custkey % 4 WHEN 0 THEN 'Culture' WHEN 1 THEN 'Nature' WHEN 2 THEN 'Water' ELSE 'Playgrounds' END
    AS category_1,
  CASE WHEN o.o_orderkey % 5 = 0 THEN 'Festivals' END AS category_2,
  CASE WHEN o.o_orderkey % 11 <> 0 THEN CAST(o.o_orderkey % 10 AS INT) END AS age_min,
  CASE WHEN o.o_orderkey % 13 <> 0 THEN CAST(o.o_orderkey % 10 + o.o_custkey % 12 AS INT) END AS age_max,
  CAST(o.o_orderdate AS DATE) AS start_date,
  CASE WHEN o.o_orderkey % 5 <> 0 THEN CAST(o.o_orderdate AS DATE) + CAST(o.o_orderkey % 40 AS INT) END AS end_date,
  CASE o.o_orderkey % 4 WHEN 1 THEN NULL WHEN 2 THEN {_D('0')}
    ELSE {_D('o.o_orderkey % 60')} + {_D('0.5')} END AS price_adult,
  CASE WHEN o.o_orderkey % 17 = 0 THEN NULL WHEN o.o_orderkey % 19 = 0 THEN {_D('0')}
    ELSE {_D('49.45')} + {_D('o.o_orderkey * 7919 % 1000')} * {_D('0.0007')} END AS lat,
  CASE WHEN o.o_orderkey % 17 = 0 THEN NULL WHEN o.o_orderkey % 19 = 0 THEN {_D('0')}
    ELSE {_D('5.75')} + {_D('o.o_orderkey * 6101 % 1000')} * {_D('0.0008')} END AS lng,
  o.o_orderstatus = 'P' AS featured, o.o_orderkey % 10 <> 3 AS published, o.o_orderkey * 31 % 997 AS view_count,
  o.o_orderkey % 3 = 0 AS wheelchair, o.o_orderkey % 6 = 0 AS sensory_friendly, o.o_orderkey % 2 = 0 AS free_parking,
  o.o_custkey % 50 AS source_id, concat('x', CAST(o.o_orderkey % 9000 AS VARCHAR(20))) AS external_id
FROM {{orders}} o JOIN {{customer}} c ON o.o_custkey = c.c_custkey JOIN {{nation}} n ON c.c_nationkey = n.n_nationkey""",
    "places_v": f"""
SELECT p_partkey AS osm_id, CASE p_partkey % 3 WHEN 0 THEN 'node' WHEN 1 THEN 'way' ELSE 'relation' END AS osm_type,
  CASE WHEN p_partkey % 5 <> 0 THEN p_name END AS tag_name,
  CASE p_size % 6 WHEN 0 THEN 'playground' WHEN 1 THEN 'park' WHEN 2 THEN 'water_park' WHEN 3 THEN 'swimming_pool'
    WHEN 4 THEN 'garden' END AS tag_leisure,
  CASE p_partkey % 9 WHEN 0 THEN 'private' WHEN 1 THEN 'customers' END AS tag_access,
  CASE p_partkey % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS tag_wheelchair,
  CASE p_partkey % 7 WHEN 0 THEN 'no' WHEN 1 THEN 'yes' END AS tag_fee,
  CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE {_D('49.45')} + {_D('p_size % 25')} * {_D('0.02')} END AS lat,
  CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE {_D('5.75')} + {_D('p_partkey % 10')} * {_D('0.08')} END AS lng
FROM {{part}}""",
    "pings_v": """
SELECT event_id % 500 AS listing_id, user_id, ts FROM {events}
UNION ALL SELECT event_id % 500, user_id, ts + INTERVAL '10' SECOND FROM {events}""",
    "regions_v": f"""
SELECT n_nationkey AS region_id, n_name AS name,
  {_D('5.75')} + {_D('n_nationkey % 5')} * {_D('0.16')} AS minx,
  {_D('49.45')} + {_D('(n_nationkey - n_nationkey % 5) / 5')} * {_D('0.14')} AS miny
FROM {{nation}}""",
    "routes_v": f"""
SELECT l_orderkey AS route_id, l_linenumber AS seq,
  {_D('49.5')} + {_D('l_partkey % 500')} * {_D('0.001')} AS lat,
  {_D('5.8')} + {_D('l_suppkey % 100')} * {_D('0.005')} AS lng, l_partkey, l_suppkey FROM {{lineitem}}""",
    "communes_v": f"""
SELECT p_name AS name, concat('Com-', p_name) AS name_alt, min(p_partkey) AS commune_id,
  concat('NATION_', CAST(min(p_partkey) % 25 AS VARCHAR(9))) AS canton,
  {_D('49.45')} + {_D('min(p_partkey) * 37 % 100')} * {_D('0.007')} AS lat,
  {_D('5.75')} + {_D('min(p_partkey) * 53 % 100')} * {_D('0.008')} AS lng
FROM {{part}} GROUP BY p_name""",
    "profiles_v": """
SELECT c_custkey AS user_id, CASE c_custkey % 5 WHEN 0 THEN 'skipped' WHEN 1 THEN 'family' ELSE 'couple' END AS persona,
  CASE c_custkey % 3 WHEN 0 THEN 'nature' WHEN 1 THEN 'playgrounds' ELSE 'culture' END AS interest_1,
  n_name AS preferred_canton,
  CASE c_custkey % 4 WHEN 0 THEN 'free' WHEN 1 THEN 'cheap' WHEN 2 THEN 'medium' ELSE 'any' END AS budget
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "hint_texts_v": """
SELECT p_partkey AS id, p_size, concat(p_name, CASE p_partkey % 6
  WHEN 0 THEN concat(' ab ', CAST(p_size % 17 AS VARCHAR(9)), ' Joer')
  WHEN 1 THEN concat(' ', CAST(p_size % 9 AS VARCHAR(9)), '-', CAST(p_size % 9 + 4 AS VARCHAR(9)), ' ans')
  WHEN 2 THEN concat(' ', CAST(p_size AS VARCHAR(9)), ' Joer Jubiläum')
  WHEN 3 THEN concat(' Eintritt frei, Workshop ', CAST(p_size AS VARCHAR(9)), ' €')
  WHEN 4 THEN concat(' Entrée ', CAST(p_size AS VARCHAR(9)), ',50 €')
  ELSE ' 14h30 - 16:15' END) AS text FROM {part}""",
}


def with_views(sql: str) -> str:
    """An oracle query with the fixture views it names put in front as CTEs."""
    body = sql.strip()
    used = [name for name in VIEWS if re.search(rf"\b{name}\b", body)]
    if not used:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].format(**{t: t for t in NAMES})})" for n in used)
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(head):
            return f"{head}{ctes},\n{body[len(head):]}"
    return f"WITH {ctes}\n{body}"


class Tables:
    """The driver's tables and the fixture views, lazily, for one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def path(self, name: str) -> str:
        return os.path.join(self.folder, f"{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in NAMES:
            return self.spark.read.parquet(self.path(name))
        if name in VIEWS:
            text = VIEWS[name]
            used = {t: getattr(self, t) for t in NAMES if "{" + t + "}" in text}
            return self.spark.sql(text, **used)
        raise AttributeError(name)

    @cached_property
    def listings(self) -> DataFrame:
        """listings_v as typed listings."""
        v = self.listings_v
        text = lambda en, de, fr: F.struct(en.alias("en"), de.alias("de"), fr.alias("fr"))
        return v.select(
            F.col("id").cast("string").alias("id"), F.col("id").alias("key"),
            text(F.col("title_en"), F.col("title_de"), F.col("title_fr")).alias("title"),
            text(F.col("short_en"), F.lit(""), F.lit("")).alias("short"),
            text(F.col("short_en"), F.lit(""), F.lit("")).alias("description"),
            "type", "canton", "town",
            F.array_compact(F.array("category_1", "category_2")).alias("category"),
            "age_min", "age_max", "start_date", "end_date", F.lit("").alias("time"), "price_adult",
            F.when(F.col("price_adult") == 0, F.lit(0.0)).alias("price_child"),
            F.coalesce(F.col("price_adult") == 0, F.lit(False)).alias("price_free"),
            F.when(F.col("price_adult").isNull(), "unknown").otherwise("event").alias("price_source"),
            F.lit("source").alias("age_source"), F.lit("").alias("image"), "lat", "lng", "featured", "published",
            F.lit(4.5).alias("rating"), "view_count", F.col("source_id").cast("string").alias("source_id"),
            F.concat(F.lit("source "), F.col("source_id")).alias("source_name"), "external_id",
            F.col("wheelchair").alias("accessibility_wheelchair"), "sensory_friendly", "free_parking",
        )

    @cached_property
    def elements(self) -> DataFrame:
        """places_v as map elements: tags = the non-null tag_* columns."""
        v = self.places_v
        keys = [c for c in v.columns if c.startswith("tag_")]
        tags = F.map_from_entries(F.array_compact(F.array(*[
            F.when(F.col(k).isNotNull(), F.struct(F.lit(k[4:]).alias("key"), F.col(k).alias("value")))
            for k in keys])))
        return v.select("osm_id", "osm_type", tags.alias("tags"), "lat", "lng",
                        F.lit(None).cast("double").alias("area_m2"))

    @cached_property
    def regions(self) -> DataFrame:
        """regions_v as (region_id, name, bounds, rings)."""
        v = self.regions_v
        corner = lambda dx, dy: F.struct((F.col("miny") + dy).alias("lat"), (F.col("minx") + dx).alias("lng"))
        ring = F.array(corner(0.0, 0.0), corner(0.16, 0.0), corner(0.16, 0.14), corner(0.0, 0.14))
        return v.select("region_id", "name", F.col("miny").alias("south"), (F.col("miny") + 0.14).alias("north"),
                        F.col("minx").alias("west"), (F.col("minx") + 0.16).alias("east"),
                        F.array(ring).alias("rings"))

    @cached_property
    def communes(self) -> DataFrame:
        """communes_v with its spelling list."""
        return self.communes_v.select("commune_id", "name", F.array("name", "name_alt").alias("names"),
                                      "canton", "lat", "lng")

    @cached_property
    def profiles(self) -> DataFrame:
        """profiles_v with the answer arrays."""
        v = self.profiles_v
        return v.select(
            "user_id", "persona", F.array("interest_1").alias("interests"),
            F.when(F.col("persona") == "family", F.array(F.lit("4-8"), F.lit("15+")))
            .otherwise(F.array().cast("array<string>")).alias("child_age_groups"),
            F.array("preferred_canton").alias("preferred_cantons"), "budget",
            F.array(F.lit("wheelchair")).alias("needs"))

    @cached_property
    def routes(self) -> DataFrame:
        """routes_v as one polyline per route with its bounds."""
        from ..operators.routes import polylines, with_bounds

        return with_bounds(polylines(
            self.routes_v, "route_id", ["seq", "l_partkey", "l_suppkey"]))
