"""Classification and venues."""

from pyspark.sql import functions as F

from ...operators import places as pl, venues as ops
from .base import check
from .filters import SCORED, scored_places


@check("j12_classify", f"""
WITH {SCORED} SELECT id, kind, grp AS "group", name, family_score, CASE kind WHEN 'playground' THEN 12 WHEN 'water_playground' THEN 10
  ELSE 99 END AS age_max, coalesce(tag_wheelchair = 'yes', false) AS wheelchair, tag_name IS NOT NULL AS named FROM scored""")
def classify(t):
    return scored_places(t).select("id", "kind", "group", "name", "family_score", "age_max", "wheelchair", "named")


VENUE = """v AS (SELECT page_id AS osm_id, CASE page_id % 5 WHEN 0 THEN 'Kino' WHEN 1 THEN 'Musée' WHEN 2 THEN 'Burg' WHEN 3 THEN 'Theater' END AS kind,
    CASE page_id % 5 WHEN 0 THEN 6 WHEN 1 THEN 0 WHEN 2 THEN 12 WHEN 3 THEN 2 END AS kind_rank,
    CASE WHEN page_id % 3 = 0 THEN '' ELSE 'Venue ' || page_id END AS name, url AS website,
    regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '^www[.]', '') AS domain FROM pages WHERE page_id % 5 < 4)"""


def elements(t):
    """Pages as map elements with a website."""
    k = F.col("page_id")
    entry = lambda key, value: F.struct(F.lit(key).alias("key"), value.alias("value"))
    tags = F.map_from_entries(F.array_compact(F.array(
        F.when(k % 5 == 0, entry("amenity", F.lit("cinema"))).when(k % 5 == 1, entry("tourism", F.lit("museum")))
        .when(k % 5 == 2, entry("historic", F.lit("castle"))).when(k % 5 == 3, entry("amenity", F.lit("theatre")))
        .otherwise(entry("shop", F.lit("farm"))),
        F.when(k % 5 == 1, entry("historic", F.lit("castle"))),
        F.when(k % 3 != 0, entry("name", F.concat(F.lit("Venue "), k.cast("string")))),
        F.when(k % 2 == 0, entry("website", F.col("url"))).otherwise(entry("contact:website", F.col("url"))))))
    return t.pages.select(k.alias("osm_id"), F.when(k % 4 == 3, "relation").otherwise("node").alias("osm_type"),
                          tags.alias("tags"), F.lit(49.6).alias("lat"), F.lit(6.1).alias("lng"))


@check("j13_venues", f"""
WITH {VENUE} SELECT osm_id, kind, kind_rank, name, website, CASE WHEN osm_id % 4 <> 3 THEN 49.6::DOUBLE END AS lat FROM v""")
def venues(t):
    return ops.venues(elements(t)).select("osm_id", "kind", "kind_rank", "name", "website", "lat")


@check("j14_uncovered", f"""
WITH {VENUE} SELECT osm_id FROM v WHERE domain NOT IN (SELECT domain FROM v WHERE osm_id % 10 = 0)""")
def uncovered(t):
    found = ops.venues(elements(t))
    return ops.uncovered(found, found.filter("osm_id % 10 = 0")).select("osm_id")


@check("w02_one_per_domain", f"""
WITH {VENUE} SELECT domain, osm_id FROM v
QUALIFY row_number() OVER (PARTITION BY domain ORDER BY kind_rank, CASE WHEN name = '' THEN 1 ELSE 0 END, osm_id) = 1""")
def per_domain(t):
    return ops.one_per_domain(ops.venues(elements(t))).select("domain", "osm_id")


REGION_HIT = "lat >= miny AND lat < miny + 0.14 AND lng >= minx AND lng < minx + 0.16"
COMMUNE_OF = f"""located AS (SELECT s.*, r.name AS commune FROM scored s LEFT JOIN (SELECT lat AS la, lng AS ln, min_by(name, region_id) AS name
    FROM (SELECT DISTINCT lat, lng FROM scored WHERE lat IS NOT NULL) JOIN regions_v ON {REGION_HIT} GROUP BY lat, lng) r
  ON s.lat = r.la AND s.lng = r.ln)"""


@check("f38_commune_suffix", f"""
WITH {SCORED}, {COMMUNE_OF} SELECT id, CASE WHEN tag_name IS NULL AND commune IS NOT NULL THEN name || ', ' || commune ELSE name END AS name,
  coalesce(commune, '') AS commune FROM located""")
def suffix(t):
    return pl.with_commune(scored_places(t), t.regions).select("id", "name", "commune")


@check("s13_build_places", f"""
WITH {SCORED}, {COMMUNE_OF}, n AS (SELECT *, CASE WHEN tag_name IS NULL AND commune IS NOT NULL THEN name || ', ' || commune ELSE name END AS nm FROM located)
SELECT id, nm AS name FROM n
QUALIFY row_number() OVER (PARTITION BY kind, CASE WHEN lat IS NULL THEN id ELSE lower(nm) END, round(lat, 4), round(lng, 4)
  ORDER BY family_score DESC, osm_id) = 1""")
def build(t):
    return pl.build_places(t.elements, t.regions).select("id", "name")


@check("j11_route_ways", """
WITH m AS (SELECT l_orderkey AS route_id, l_partkey AS way_id,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos FROM lineitem)
SELECT route_id, pos, way_id, p_size AS points FROM m JOIN part ON way_id = p_partkey""")
def ways(t):
    ordered = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    relations = t.lineitem.groupBy(F.col("l_orderkey").alias("route_id")).agg(
        F.transform(ordered, lambda m: m["l_partkey"]).alias("members"))
    shapes = t.part.select(F.col("p_partkey").alias("way_id"), F.col("p_size").alias("points"))
    return pl.route_ways(relations, shapes).select("route_id", F.col("pos").cast("bigint").alias("pos"), "way_id", "points")


@check("f07_place_slug", f"""
WITH {SCORED} SELECT id, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '-' || substr(osm_type, 1, 1)
  || CAST(osm_id AS VARCHAR) AS slug FROM scored""")
def slugs(t):
    return scored_places(t).select("id", "slug")
