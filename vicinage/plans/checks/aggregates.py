"""Counts, tallies, centres, set operations."""

from pyspark.sql import functions as F

from ...functions import text as tx
from ...operators import aggregates as ops, places as pl, sets
from ..views import TODAY
from .base import check
from .filters import ID, LOCATED, SCORED, scored_places


@check("a01_overview", """
SELECT count(*) AS total, count(*) FILTER (WHERE published) AS published, count(*) FILTER (WHERE NOT published) AS drafts,
  count(*) FILTER (WHERE published AND featured) AS featured, CAST(sum(view_count) AS BIGINT) AS total_views FROM listings_v""")
def overview(t):
    return ops.overview(t.listings)


@check("a02_top_listings", """
SELECT CAST(id AS VARCHAR) AS id, view_count FROM listings_v WHERE published ORDER BY view_count DESC, CAST(id AS VARCHAR) LIMIT 5""")
def top(t):
    return ops.top_listings(t.listings).select("id", "view_count")


@check("a03_featured_revenue", """
SELECT count(*) AS featured, count(*) * 49 AS projected FROM listings_v WHERE published AND featured""")
def revenue(t):
    return ops.revenue(t.listings)


@check("a03_plan_revenue", """
SELECT CASE event_id % 3 WHEN 0 THEN '1month' WHEN 1 THEN '3months' ELSE '6months' END AS plan, count(*) AS n,
  CAST(sum(CASE event_id % 3 WHEN 0 THEN 4900 WHEN 1 THEN 12900 ELSE 22900 END) AS BIGINT) AS cents
FROM events WHERE event_type = 'purchase' GROUP BY plan""")
def plans(t):
    key = F.col("event_id")
    plan = F.when(key % 3 == 0, "1month").when(key % 3 == 1, "3months").otherwise("6months")
    return ops.plan_revenue(t.events.filter("event_type = 'purchase'").select(plan.alias("plan")))


@check("a04_by_kind", f"WITH {SCORED} SELECT kind, count(*) AS n FROM scored GROUP BY kind")
def by_kind(t):
    return ops.by_kind(pl.classify(t.elements))


@check("a05_by_canton", "SELECT canton, count(*) AS n FROM listings_v GROUP BY canton")
def by_canton(t):
    return ops.by_canton(t.listings)


@check("a06_category_shift", """
WITH c AS (SELECT category_1 AS category, 1 AS b, 0 AS a FROM listings_v
  UNION ALL SELECT category_2, 1, 0 FROM listings_v WHERE category_2 IS NOT NULL
  UNION ALL SELECT CASE WHEN id % 2 = 0 THEN 'Culture' ELSE category_1 END, 0, 1 FROM listings_v)
SELECT category, CAST(sum(b) AS BIGINT) AS before, CAST(sum(a) AS BIGINT) AS after FROM c GROUP BY category""")
def shift(t):
    new = F.when(F.col("key") % 2 == 0, F.array(F.lit("Culture"))).otherwise(F.slice("category", 1, 1))
    return ops.category_shift(t.listings.withColumn("new", new), "category", "new")


@check("a06_unknown_categories", "SELECT 'Festivals' AS category, count(*) AS n FROM listings_v WHERE category_2 IS NOT NULL")
def unknown(t):
    return ops.unknown_categories(t.listings, "category", ["Culture", "Nature", "Water", "Playgrounds"])


@check("a07_moves", """
SELECT town AS old, replace(town, ' Stadt', '') AS new, count(*) AS n FROM listings_v GROUP BY town""")
def moves(t):
    rows = t.listings.select(F.col("town").alias("old"), tx.strip_town_suffix(F.col("town")).alias("new"))
    return ops.moves(rows.filter("old <> new"))


@check("a08_commune_centres", f"""
WITH {SCORED}, taken AS (SELECT *, osm_id % 40 AS commune FROM scored WHERE lat IS NOT NULL)
SELECT CAST(commune AS VARCHAR) AS commune, round(avg(lat), 6) AS lat, round(avg(lng), 6) AS lng, count(*) AS n
FROM taken GROUP BY commune HAVING count(*) >= 5""")
def centres(t):
    places = scored_places(t).withColumn("commune", (F.col("osm_id") % 40).cast("string"))
    return ops.commune_centres(places).select(
        "commune", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), "n")


@check("a09_vertex_means", """
SELECT route_id, round(avg(lat), 6) AS lat, round(avg(lng), 6) AS lng, count(*) AS n FROM routes_v GROUP BY route_id""")
def means(t):
    return ops.vertex_means(t.routes_v, "route_id").select(
        "route_id", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), "n")


@check("a11_route_bounds", """
SELECT route_id, min(lat) AS bbox_south, max(lat) AS bbox_north, min(lng) AS bbox_west, max(lng) AS bbox_east
FROM routes_v GROUP BY route_id""")
def bounds(t):
    return t.routes.select("route_id", "bbox_south", "bbox_north", "bbox_west", "bbox_east")


SNAPSHOT = f"""count(*) AS total, count(*) FILTER (WHERE published AND start_date >= DATE '{TODAY}') AS upcoming,
  count(*) FILTER (WHERE NOT coalesce({LOCATED}, false)) AS unlocated"""


@check("a12_snapshot", f"SELECT {SNAPSHOT} FROM listings_v")
def snapshot(t):
    return ops.snapshot(t.listings, TODAY)


@check("a12_snapshot_delta", f"""
WITH a AS (SELECT {SNAPSHOT} FROM listings_v WHERE id % 3 <> 0), b AS (SELECT {SNAPSHOT} FROM listings_v)
SELECT b.total - a.total AS total, b.upcoming - a.upcoming AS upcoming, b.unlocated - a.unlocated AS unlocated FROM a, b""")
def delta(t):
    before = ops.snapshot(t.listings.filter(F.col("key") % 3 != 0), TODAY)
    return ops.snapshot_delta(before, ops.snapshot(t.listings, TODAY))


@check("a13_run_report", """
SELECT user_id AS source_id, count(*) FILTER (WHERE event_type = 'view') AS inserted,
  count(*) FILTER (WHERE event_type = 'click') AS skipped, count(*) FILTER (WHERE event_type = 'error') AS blocked,
  count(*) FILTER (WHERE event_type IN ('view', 'click', 'error')) AS seen,
  CASE WHEN count(*) FILTER (WHERE event_type IN ('view', 'click', 'error')) > 0 THEN 'ok' ELSE 'no_events' END AS status
FROM events GROUP BY user_id""")
def report(t):
    e = F.col("event_type")
    outcome = F.when(e == "view", "inserted").when(e == "click", "skipped").when(e == "error", "blocked").otherwise("none")
    return ops.run_report(t.events.select(F.col("user_id").alias("source_id"), outcome.alias("outcome")))


@check("a14_discovery_tally", """
SELECT CASE page_id % 4 WHEN 0 THEN 'KANDIDAT' WHEN 1 THEN 'GESPERRT' WHEN 2 THEN 'FEHLER' ELSE 'NICHTS GEFUNDEN' END AS status,
  count(*) AS n FROM pages GROUP BY status""")
def tally(t):
    key = F.col("page_id")
    s = F.when(key % 4 == 0, "KANDIDAT").when(key % 4 == 1, "GESPERRT").when(key % 4 == 2, "FEHLER").otherwise("NICHTS GEFUNDEN")
    return ops.count_by(t.pages.select(s.alias("status")), "status")


@check("a15_geocode_counts", """
SELECT CASE WHEN lat IS NULL THEN 'fallback' WHEN lat = 0 THEN 'places' ELSE 'addresses' END AS source, count(*) AS n
FROM listings_v GROUP BY source""")
def geocoded(t):
    lat = F.col("lat")
    s = F.when(lat.isNull(), "fallback").when(lat == 0, "places").otherwise("addresses")
    return ops.count_by(t.listings.select(s.alias("source")), "source")


@check("a16_stock_hosts", """
SELECT CASE page_id % 3 WHEN 0 THEN 'images.pexels.com' ELSE 'eu.placehold.co' END AS host, count(*) AS n
FROM pages WHERE page_id % 3 < 2 GROUP BY host""")
def hosts(t):
    key = F.col("page_id")
    image = (F.when(key % 3 == 0, "https://images.pexels.com/1.jpg").when(key % 3 == 1, "http://EU.placehold.co/2.png")
             .otherwise(F.col("url")))
    return ops.stock_hosts(t.pages.select(image.alias("image")))


@check("a17_language_coverage", """
SELECT lang, count(*) FILTER (WHERE doc_id % 3 <> 0 AND trim(text) <> '') AS filled, count(*) AS n,
  round(count(*) FILTER (WHERE doc_id % 3 <> 0 AND trim(text) <> '') / count(*), 4) AS share FROM documents GROUP BY lang""")
def coverage(t):
    docs = t.documents.select("lang", F.when(F.col("doc_id") % 3 != 0, F.col("text")).otherwise(F.lit(" ")).alias("lb"))
    return ops.language_coverage(docs, ["lang"], "lb")


@check("a18_co_located", f"""
WITH s AS (SELECT {ID}, round(lat, 5) AS spot_lat, round(lng, 5) AS spot_lng FROM listings_v WHERE {LOCATED}),
g AS (SELECT spot_lat, spot_lng, count(*) AS at_spot, min(id) AS first_id FROM s GROUP BY spot_lat, spot_lng HAVING count(*) > 1)
SELECT id, at_spot, first_id FROM s JOIN g USING (spot_lat, spot_lng)""")
def spots(t):
    return ops.co_located(t.listings, ["id"]).select("id", "at_spot", "first_id")


@check("a19_ingest_report", f"""
WITH {SCORED}, k AS (SELECT *, row_number() OVER (PARTITION BY kind, CASE WHEN lat IS NULL THEN id ELSE lower(name) END,
    round(lat, 4), round(lng, 4) ORDER BY family_score DESC, osm_id) = 1 AS kept FROM scored)
SELECT kind, count(*) AS raw, count(*) FILTER (WHERE kept) AS deduped, count(*) FILTER (WHERE kept AND osm_id % 2 = 0) AS upserted,
  count(*) FILTER (WHERE kept AND osm_id % 2 = 1) AS skipped, CAST(0 AS BIGINT) AS errors
FROM k GROUP BY ROLLUP (kind)""")
def ingest(t):
    all_ = scored_places(t)
    kept = pl.dedupe_places(all_).select("id", F.lit(True).alias("kept"))
    rows = all_.join(kept, "id", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    even = F.col("osm_id") % 2 == 0
    return ops.ingest_report(rows.withColumns({
        "written": F.col("kept") & even, "skipped": F.col("kept") & ~even, "failed": F.lit(False)}))


@check("a20_view_counts", "SELECT listing_id, count(*) AS views FROM pings_v GROUP BY listing_id")
def views(t):
    return ops.view_counts(t.pings_v)


@check("u02_others", f"SELECT {ID} FROM listings_v WHERE NOT (published AND featured)")
def others(t):
    return sets.others(t.listings, t.listings.filter("published AND featured")).select("id")


@check("u03_union_for_audit", f"""
SELECT 'listings' AS collection, CAST(id AS VARCHAR) AS id, concat_ws(' ', title_en, town) AS text FROM listings_v
UNION ALL SELECT 'places', CAST(osm_id AS VARCHAR), coalesce(tag_name, '') FROM places_v""")
def audit(t):
    listings = t.listings.select("id", F.col("title.en").alias("title"), "town")
    places = t.places_v.select(F.col("osm_id").alias("id"), F.col("tag_name").alias("name"))
    return sets.for_audit(listings, places, ["title", "town"], ["name"])


@check("u05_shares_token", """
SELECT p_partkey AS id, list_has_any(list_filter(string_split(lower(p_name), ' '), lambda w: length(w) >= 4),
  list_filter(string_split(lower(replace(p_type, '-', ' ')) || ' gear bolt', ' '), lambda w: length(w) >= 4)) AS answers FROM part""")
def shares(t):
    return t.part.select(F.col("p_partkey").alias("id"), tx.shares_token(
        F.col("p_name"), F.concat("p_type", F.lit(" Gëar-Bolt"))).alias("answers"))


@check("u06_spellings", """
SELECT p_partkey AS id, array_to_string(list_sort(list_distinct([p_name, p_brand, p_name])), '|') AS names FROM part""")
def spellings(t):
    rows = t.part.select(F.col("p_partkey").alias("id"), "p_name", F.array("p_brand", "p_name").alias("more"), F.lit("").alias("none"))
    return sets.spellings(rows, ["p_name", "more", "none"]).select("id", F.array_join("names", "|").alias("names"))
