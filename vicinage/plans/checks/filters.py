"""Projections and filters."""

from datetime import datetime

from pyspark.sql import functions as F

from ...functions import dates, geo, hints, tags as tagging, text as tx, urls
from ...functions.dates import iso
from ...operators import filters as ops, places as pl
from ..views import CENTRE, TODAY
from .base import check

LAT, LNG = CENTRE
LAND = f"CAST({LAT} AS DOUBLE)"
ID = "CAST(id AS VARCHAR) AS id"
NOT_DONE = f"(end_date >= DATE '{TODAY}' OR (end_date IS NULL AND start_date >= DATE '{TODAY}' - 3))"
HAVERSINE = """12742.0 * asin(sqrt(least(1.0, pow(sin(radians({b} - {a}) / 2), 2)
  + pow(sin(radians({d} - {c}) / 2), 2) * cos(radians({a})) * cos(radians({b})))))"""


def haversine_sql(a: str, c: str, b: str = "lat", d: str = "lng") -> str:
    return HAVERSINE.format(a=a, b=b, c=c, d=d)


DIST = haversine_sql(str(LAT), str(LNG))
LOCATED = "lat IS NOT NULL AND lng IS NOT NULL AND NOT (lat = 0 AND lng = 0)"


@check("p01_summary_projection", f"""
SELECT {ID}, title_en, type, canton, town, concat_ws('|', category_1, category_2) AS category,
  coalesce(age_min, 0) AS age_min, coalesce(age_max, 99) AS age_max, CAST(start_date AS VARCHAR) AS start_date,
  CAST(end_date AS VARCHAR) AS end_date, price_adult, lat, lng, featured, published, view_count
FROM listings_v""")
def summary(t):
    s = ops.summary(t.listings)
    return s.select("id", F.col("title.en").alias("title_en"), "type", "canton", "town",
                    F.array_join("category", "|").alias("category"), "age_min", "age_max",
                    iso(F.col("start_date")).alias("start_date"), iso(F.col("end_date")).alias("end_date"),
                    "price_adult", "lat", "lng", "featured", "published", "view_count")


@check("p02_place_projection", "SELECT concat('osm:', osm_type, '/', CAST(osm_id AS VARCHAR)) AS id, lat, lng FROM places_v")
def place_rows(t):
    rows = t.elements.withColumnRenamed("tags", "tags_raw").withColumn(
        "id", F.concat(F.lit("osm:"), "osm_type", F.lit("/"), F.col("osm_id").cast("string")))
    return ops.place_rows(rows).select("id", "lat", "lng")


@check("p03_quarantine", """
WITH p AS (SELECT CAST(id AS VARCHAR) AS id, concat_ws('; ', CASE WHEN lat IS NULL THEN 'lat missing' END,
    CASE WHEN lng IS NULL THEN 'lng missing' END, CASE WHEN category_1 = 'Water' THEN 'type not known' END,
    CASE WHEN category_1 IN ('Water', 'Nature') THEN 'end_date before start_date' END) AS problems FROM listings_v)
SELECT id, problems FROM p WHERE problems <> ''""")
def quarantine(t):
    """Some listings get an unknown type, some end before they start, some have four problems."""
    first = F.try_element_at("category", F.lit(1))
    water, early = first == "Water", first.isin("Water", "Nature")
    spoilt = t.listings.withColumns({"type": F.when(water, "Nope").otherwise(F.col("type")),
                                     "end_date": F.when(early, F.date_sub("start_date", 1)).otherwise(F.col("end_date"))})
    return ops.split_valid(spoilt)[1].select("id", F.array_join("problems", "; ").alias("problems"))


@check("p04_published", "SELECT CAST(id AS VARCHAR) AS id FROM listings_v WHERE published")
def published(t):
    return ops.published(t.listings).select("id")


@check("p05_filter_listings", f"""
SELECT {ID}, round({DIST}, 6) AS distance_km FROM listings_v
WHERE published AND category_1 IN ('Culture', 'Nature') AND coalesce(age_min, 0) <= 8 AND coalesce(age_max, 99) >= 4
  AND {NOT_DONE} AND {LOCATED} AND {DIST} <= 25""")
def composite(t):
    return ops.filter_listings(
        t.listings, today=TODAY, category=["Culture", "Nature"], age_min=4, age_max=8, upcoming=True,
        near=CENTRE, radius_km=25).select("id", F.round("distance_km", 6).alias("distance_km"))


@check("p06_category_any_of", """
SELECT CAST(id AS VARCHAR) AS id FROM listings_v WHERE published AND (category_1 = 'Water' OR category_2 = 'Festivals')""")
def category(t):
    return ops.filter_listings(t.listings, today=TODAY, category=["Water", "Festivals"]).select("id")


@check("p07_age_overlap", """
SELECT CAST(id AS VARCHAR) AS id FROM listings_v WHERE coalesce(age_min, 0) <= 6 AND coalesce(age_max, 99) >= 4""")
def ages(t):
    return t.listings.filter(ops.age_overlaps(4, 6)).select("id")


@check("p08_needs_narrow", """
SELECT CAST(id AS VARCHAR) AS id FROM listings_v WHERE wheelchair AND free_parking""")
def needs(t):
    return t.listings.filter(ops.needs(wheelchair=True, sensory=False, free_parking=True)).select("id")


@check("p09_still_current", f"SELECT {ID} FROM listings_v WHERE {NOT_DONE}")
def current(t):
    return t.listings.filter(ops.still_current(TODAY)).select("id")


@check("p10_local_today", """
SELECT event_id, strftime(CAST(timezone('Europe/Luxembourg', timezone('UTC', ts)) AS DATE), '%Y-%m-%d') AS local_day FROM events""")
def local_day(t):
    return t.events.select("event_id", iso(dates.today_in(moment=F.col("ts"))).alias("local_day"))


@check("p11_date_window", """
SELECT DISTINCT CAST(d AS VARCHAR) AS day, o.option,
  CAST(CASE o.option WHEN 'Today' THEN d WHEN 'Next 7 days' THEN d
    WHEN 'This weekend' THEN CASE WHEN isodow(d) >= 6 THEN d ELSE d + CAST(6 - isodow(d) AS INT) END END AS VARCHAR) AS date_from,
  CAST(CASE o.option WHEN 'Today' THEN d WHEN 'Next 7 days' THEN d + 7
    WHEN 'This weekend' THEN d + CAST(7 - isodow(d) AS INT) END AS VARCHAR) AS date_to
FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders),
  (VALUES ('Today'), ('This weekend'), ('Next 7 days'), ('Any date')) o(option)""")
def window(t):
    days = t.orders.select(F.to_date("o_orderdate").alias("d")).distinct()
    options = F.explode(F.array(*[F.lit(o) for o in ("Today", "This weekend", "Next 7 days", "Any date")]))
    w = days.withColumn("option", options).withColumn("w", dates.date_window(F.col("option"), F.col("d")))
    return w.select(iso(F.col("d")).alias("day"), "option", iso(F.col("w.date_from")).alias("date_from"),
                    iso(F.col("w.date_to")).alias("date_to"))


@check("p12_calendar_window", """
SELECT DISTINCT CAST(d AS VARCHAR) AS day,
  CAST(CASE WHEN isodow(d) >= 6 THEN d ELSE d + CAST(6 - isodow(d) AS INT) END AS VARCHAR) AS weekend_from,
  CAST(d + CAST(7 - isodow(d) AS INT) AS VARCHAR) AS weekend_to, CAST(d + 7 AS VARCHAR) AS week_to,
  CAST(last_day(d) AS VARCHAR) AS month_to
FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders)""")
def calendar(t):
    d = F.col("d")
    days = t.orders.select(F.to_date("o_orderdate").alias("d")).distinct()
    return days.select(
        iso(d).alias("day"), iso(ops.calendar_window("weekend", d)["date_from"]).alias("weekend_from"),
        iso(ops.calendar_window("weekend", d)["date_to"]).alias("weekend_to"),
        iso(ops.calendar_window("week", d)["date_to"]).alias("week_to"),
        iso(ops.calendar_window("month", d)["date_to"]).alias("month_to"))


@check("p13_chip_windows", """
SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_size % 9 END AS age_min,
  CASE WHEN p_partkey % 3 = 0 THEN p_size % 9 + 4 END AS age_max,
  CASE WHEN p_partkey % 3 = 1 AND p_partkey % 2 = 0 THEN p_size END AS radius_km,
  p_partkey % 3 = 1 AND p_partkey % 2 = 1 AS needs_location
FROM part""")
def chips(t):
    key, size = F.col("p_partkey"), F.col("p_size")
    chip = (F.when(key % 3 == 0, F.concat((size % 9).cast("string"), F.lit("-"), (size % 9 + 4).cast("string")))
            .when(key % 3 == 1, F.concat(size.cast("string"), F.lit(" km"))).otherwise(F.lit("All")))
    rows = t.part.select(key.alias("id"), hints.age_window(chip).alias("a"),
                         hints.radius_window(chip, key % 2 == 0).alias("r"))
    return rows.select("id", "a.age_min", "a.age_max", "r.radius_km", "r.needs_location")


@check("p14_search", """
SELECT CAST(id AS VARCHAR) AS id FROM listings_v
WHERE lower(title_en) LIKE '%0012%' OR lower(title_de) LIKE '%0012%' OR lower(short_en) LIKE '%0012%' OR lower(town) LIKE '%0012%'""")
def search(t):
    return t.listings.filter(ops.search(" 0012 ")).select("id")


@check("p14_search_documents", "SELECT doc_id FROM documents WHERE contains(lower(text), 'tion th')")
def search_documents(t):
    return t.documents.filter(F.contains(F.lower("text"), F.lit("tion th"))).select("doc_id")


PLACE_KIND = """CASE
  WHEN tag_access IN ('private') THEN NULL
  WHEN tag_leisure = 'playground' AND coalesce(tag_access, '') <> 'customers' THEN 'playground'
  WHEN tag_leisure IN ('swimming_pool', 'water_park') AND tag_name IS NOT NULL THEN 'swimming'
  WHEN tag_leisure = 'water_park' AND coalesce(tag_access, '') <> 'customers' THEN 'water_playground'
  WHEN tag_leisure IN ('park', 'garden') AND coalesce(tag_access, '') <> 'customers' THEN 'park' END"""
# Score of a place: base of its kind, then name +5, wheelchair +4, fee no +3 / yes -3, closed access -40.
PLACE_SCORE = """greatest(0, least(100, CASE kind WHEN 'playground' THEN 90 WHEN 'swimming' THEN 85
  WHEN 'water_playground' THEN 88 ELSE 70 END
  + CASE WHEN tag_name IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN tag_wheelchair = 'yes' THEN 4 ELSE 0 END
  + CASE tag_fee WHEN 'no' THEN 3 WHEN 'yes' THEN -3 ELSE 0 END
  + CASE WHEN tag_access IN ('private', 'customers') THEN -40 ELSE 0 END))"""
# places_v classified and scored.
SCORED = f"""scored AS (SELECT * REPLACE (round(lat, 6) AS lat, round(lng, 6) AS lng), concat('osm:', osm_type, '/', CAST(osm_id AS VARCHAR)) AS id, {PLACE_SCORE} AS family_score,
    CASE kind WHEN 'playground' THEN 'play' WHEN 'water_playground' THEN 'play' WHEN 'swimming' THEN 'sport'
      ELSE 'nature' END AS grp,
    coalesce(tag_name, CASE kind WHEN 'playground' THEN 'Spielplatz' WHEN 'swimming' THEN 'Schwimmbad / Freibad'
      WHEN 'water_playground' THEN 'Wasserspielplatz' ELSE 'Park / Garten' END) AS name
  FROM (SELECT *, {PLACE_KIND} AS kind FROM places_v) WHERE kind IS NOT NULL)"""


def scored_places(t):
    return pl.to_places(pl.classify(t.elements))


@check("p15_filter_places", f"WITH {SCORED} SELECT id, kind, family_score FROM scored WHERE family_score >= 80 AND grp = 'play'")
def filter_places(t):
    return ops.filter_places(scored_places(t), min_score=80, group="play").select("id", "kind", "family_score")


BOX = f"""lat BETWEEN {LAT} - 15 / 111.0 AND {LAT} + 15 / 111.0
  AND lng BETWEEN {LNG} - 15 / (111.0 * cos(radians({LAT}))) AND {LNG} + 15 / (111.0 * cos(radians({LAT})))"""


@check("p16_bounding_box", f"SELECT osm_id FROM places_v WHERE {BOX}")
def box(t):
    return t.elements.filter(geo.in_box(F.col("lat"), F.col("lng"), geo.bounding_box(LAT, LNG, 15))).select("osm_id")


ROUTE_BOXES = """boxes AS (SELECT route_id, min(lat) AS s, max(lat) AS n, min(lng) AS w, max(lng) AS e
  FROM routes_v GROUP BY route_id)"""


@check("p17_point_or_line_prefilter", f"""
WITH {ROUTE_BOXES} SELECT route_id FROM boxes
WHERE s <= 49.6 + 2 / 111.0 AND n >= 49.6 - 2 / 111.0
  AND w <= 5.82 + 2 / (111.0 * cos(radians(49.6))) AND e >= 5.82 - 2 / (111.0 * cos(radians(49.6)))""")
def line_prefilter(t):
    routes = t.routes.withColumns({"lat": F.lit(None).cast("double"), "lng": F.lit(None).cast("double")})
    return ops.near_prefilter(routes, 49.6, 5.82, 2).select("route_id")


@check("p18_within_radius", f"SELECT {ID}, round({DIST}, 6) AS distance_km FROM listings_v WHERE {LOCATED} AND {DIST} <= 10")
def circle(t):
    return ops.within_radius(t.listings, LAT, LNG, 10).select("id", F.round("distance_km", 6).alias("distance_km"))


@check("p19_within_view", f"""
SELECT {ID} FROM listings_v WHERE NOT ({LOCATED}) OR {DIST} <= 12""")
def view(t):
    return ops.within_view(t.listings, CENTRE, 12, zoom=11).select("id")


@check("p20_layer", f"WITH {SCORED} SELECT id, 'other' AS layer FROM scored")
def layer(t):
    return ops.filter_places(scored_places(t), layer="other").select("id", tagging.layer_of(F.col("kind")).alias("layer"))


@check("p21_pending_geocode", f"""
WITH g AS (SELECT CAST(id AS VARCHAR) AS id, lat,
    CASE id % 5 WHEN 0 THEN 'address' WHEN 1 THEN 'canton' WHEN 2 THEN 'source_default' WHEN 3 THEN 'street' END AS p,
    CASE WHEN id % 7 <> 0 THEN CAST(start_date AS TIMESTAMP) END AS tried FROM listings_v)
SELECT id, strftime(tried, '%Y-%m-%d') AS tried FROM g
WHERE (lat IS NULL OR lat = 0 OR p IS NULL OR p IN ('', 'canton', 'commune', 'fallback', 'source_default'))
  AND (tried IS NULL OR tried < TIMESTAMP '{TODAY} 00:00:00' - INTERVAL 7 DAY)
ORDER BY tried NULLS FIRST, id LIMIT 150""")
def pending(t):
    key = F.col("key")
    rows = t.listings.withColumns({
        "geocode_precision": F.when(key % 5 == 0, "address").when(key % 5 == 1, "canton")
        .when(key % 5 == 2, "source_default").when(key % 5 == 3, "street"),
        "geocoded_at": F.when(key % 7 != 0, F.col("start_date").cast("timestamp"))})
    out = ops.pending_geocode(rows, datetime.fromisoformat(TODAY), batch=150)
    return out.select("id", F.date_format("geocoded_at", "yyyy-MM-dd").alias("tried"))


@check("p22_section_titles", """
SELECT p_partkey AS id, p_partkey % 4 <> 3 AS section FROM part""")
def sections(t):
    key = F.col("p_partkey")
    title = (F.when(key % 4 == 0, F.lit("Archives des Actualités - Kaerjeng"))
             .when(key % 4 == 1, F.lit("AGENDA | Gemeng Réiser")).when(key % 4 == 2, F.lit(" News "))
             .otherwise(F.concat(F.lit("News vun "), "p_name")))
    return t.part.select(key.alias("id"), tx.is_not_an_event(title, F.lit("Kaerjeng")).alias("section"))


PAGE_URL = """CASE page_id % 6 WHEN 0 THEN 'https://a.example/events/' WHEN 1 THEN 'https://a.example/fr/agenda/fest-' || page_id
  WHEN 2 THEN 'https://a.example/photo-events/' || page_id WHEN 3 THEN 'https://a.example/évènements/x' ELSE url END"""


def page_urls(t):
    key = F.col("page_id")
    url = (F.when(key % 6 == 0, F.lit("https://a.example/events/"))
           .when(key % 6 == 1, F.concat(F.lit("https://a.example/fr/agenda/fest-"), key.cast("string")))
           .when(key % 6 == 2, F.concat(F.lit("https://a.example/photo-events/"), key.cast("string")))
           .when(key % 6 == 3, F.lit("https://a.example/évènements/x")).otherwise(F.col("url")))
    return t.pages.select("page_id", url.alias("url"))


@check("p23_eventish_urls", """
SELECT page_id, page_id % 6 IN (0, 1, 3) AS sitemap, page_id % 6 IN (0, 1) AS anchor,
  page_id % 6 IN (0, 1) AS discovery, page_id % 6 = 1 AS single FROM pages""")
def eventish(t):
    u = F.col("url")
    return page_urls(t).select("page_id", urls.eventish(u).alias("sitemap"), urls.eventish(u, "anchor").alias("anchor"),
                               urls.discoverable(u).alias("discovery"), urls.has_slug(u).alias("single"))


@check("p24_stock_photos", """
SELECT page_id, page_id % 4 IN (0, 1) AS stock, page_id % 4 >= 2 AS own FROM pages""")
def stock(t):
    key = F.col("page_id")
    image = (F.when(key % 4 == 0, F.lit("https://images.unsplash.com/p?x=1"))
             .when(key % 4 == 1, F.lit("HTTPS://eu.cdn.pixabay.com/p.jpg"))
             .when(key % 4 == 2, F.lit("https://notpicsum.photos/p.jpg")).otherwise(F.col("url")))
    return t.pages.select("page_id", urls.is_stock(image).alias("stock"), urls.has_own_photo(image).alias("own"))


@check("p25_freshness", f"""
SELECT {ID} FROM listings_v WHERE start_date BETWEEN DATE '{TODAY}' - 1 AND DATE '{TODAY}' + 365""")
def fresh(t):
    return ops.fresh(t.listings, TODAY, horizon_days=365).select("id")


@check("p26_saved", """
SELECT CAST(id AS VARCHAR) AS id FROM listings_v
WHERE type <> 'Event' AND id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)""")
def saved(t):
    ids = t.lineitem.filter("l_quantity > 45").select(F.col("l_orderkey").cast("string").alias("id"))
    return ops.saved(t.listings, ids, "Places").select("id")


@check("p27_by_id", "SELECT CAST(id AS VARCHAR) AS id, title_en FROM listings_v WHERE id = 42 AND published")
def by_id(t):
    return ops.get(t.listings, "42").select("id", F.col("title.en").alias("title_en"))


@check("p28_admission_gates", """
SELECT osm_id, coalesce(tag_access, '') NOT IN ('private', 'customers') AS playground,
  coalesce(tag_access, '') <> 'private' AND tag_name IS NOT NULL AS swimming FROM places_v""")
def gates(t):
    args = (F.col("tags"), F.col("lat"), F.col("lng"), F.col("osm_type"))
    return t.elements.select("osm_id", tagging.admits("playground", *args).alias("playground"),
                             tagging.admits("swimming", *args).alias("swimming"))


@check("p29_plausible_point", """
SELECT CAST(id AS VARCHAR) AS id, coalesce(lat BETWEEN 49.40 AND 50.20 AND lng BETWEEN 5.70 AND 6.55, false) AS ok FROM listings_v""")
def plausible(t):
    return t.listings.select("id", geo.plausible(F.col("lat"), F.col("lng")).alias("ok"))


@check("p30_taxonomy", f"""
WITH {SCORED} SELECT kind, grp AS "group", min(CASE kind WHEN 'playground' THEN 90 WHEN 'swimming' THEN 85
  WHEN 'water_playground' THEN 88 ELSE 70 END) AS base_score, count(*) AS places FROM scored GROUP BY kind, grp""")
def taxonomy(t):
    kinds = ops.taxonomy(t.spark).select("kind", "group", "base_score")
    used = pl.classify(t.elements).groupBy("kind").agg(F.count("*").alias("places"))
    return kinds.join(used, "kind").select("kind", "group", "base_score", "places")
