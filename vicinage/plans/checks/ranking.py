"""Orders, pages, windows."""

from pyspark.sql import functions as F

from ...functions import dates
from ...functions.dates import iso
from ...operators import filters as flt, places as pl, ranking as ops
from ..views import CENTRE, TODAY
from .base import check
from .filters import DIST, ID, LAT, LNG, LOCATED, SCORED, scored_places

RELEVANT = f"greatest(start_date, DATE '{TODAY}')"
UPCOMING = f"published AND (end_date >= DATE '{TODAY}' OR (end_date IS NULL AND start_date >= DATE '{TODAY}' - 3))"


@check("o01_relevance_order", f"""
SELECT {ID}, featured, CAST({RELEVANT} AS VARCHAR) AS relevant FROM listings_v WHERE {UPCOMING}
ORDER BY featured DESC, {RELEVANT}, start_date DESC, CAST(id AS VARCHAR)""")
def relevance(t):
    rows = ops.by_relevance(flt.filter_listings(t.listings, today=TODAY, upcoming=True), TODAY)
    return rows.select("id", "featured", iso(dates.relevant_from(F.col("start_date"), flt.day(TODAY))).alias("relevant"))


@check("o02_score_order", f"WITH {SCORED} SELECT id, family_score FROM scored ORDER BY family_score DESC, id")
def score(t):
    return ops.by_score(scored_places(t)).select("id", "family_score")


@check("o03_nearest_places", f"""
SELECT CAST(id AS VARCHAR) AS id, round({DIST}, 1) AS distance_km FROM listings_v WHERE {LOCATED} AND {DIST} <= 8""")
def nearest(t):
    return ops.nearest_places(t.listings, LAT, LNG, 8).select("id", "distance_km")


@check("o04_distance_column", f"""
SELECT {ID}, CASE WHEN {LOCATED} THEN round({DIST}, 6) END AS distance_km FROM listings_v""")
def distance(t):
    return ops.with_distance(t.listings, CENTRE).select("id", F.round("distance_km", 6).alias("distance_km"))


@check("o04_near_you", f"SELECT {ID} FROM listings_v WHERE {LOCATED} ORDER BY {DIST}, CAST(id AS VARCHAR) LIMIT 3")
def near_you(t):
    return ops.near_you(t.listings, CENTRE).select("id")


@check("o04_featured_by_chip", f"""
SELECT {ID} FROM listings_v WHERE coalesce(age_min, 0) <= 6 AND coalesce(age_max, 99) >= 4 AND {UPCOMING}
ORDER BY featured DESC, {RELEVANT}, start_date DESC, CAST(id AS VARCHAR) LIMIT 3""")
def chip(t):
    rows = flt.closed_ages(flt.filter_listings(t.listings, today=TODAY, upcoming=True))
    return ops.featured3(rows, "4-6", ops.relevance_keys(TODAY)).select("id")


@check("o05_admin_list", f"SELECT {ID} FROM listings_v ORDER BY start_date, CAST(id AS VARCHAR) LIMIT 100 OFFSET 100")
def admin(t):
    return ops.admin_list(t.listings, skip=100, limit=100).select("id")


@check("o05_partner_list", """
SELECT c_custkey AS id FROM customer ORDER BY TIMESTAMP '2024-01-01 00:00:00' + (c_custkey * 7 % 900) * INTERVAL 1 DAY DESC, c_custkey LIMIT 500""")
def partners(t):
    made = F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(cast(c_custkey * 7 % 900 as int))")
    return ops.partner_list(t.customer.select(F.col("c_custkey").alias("id"), made.alias("created_at"))).select("id")


def curated(t):
    return t.listings.withColumn("source_name", F.when(F.col("key") % 9 == 0, "Curated list").otherwise(F.col("source_name")))


@check("o06_month_groups", f"""
SELECT {ID}, CASE WHEN id % 9 = 0 THEN 'always_open' ELSE 'dated' END AS section,
  CASE WHEN id % 9 <> 0 THEN strftime({RELEVANT}, '%Y-%m') END AS month FROM listings_v WHERE {UPCOMING}""")
def months(t):
    rows = ops.grouped_by_month(flt.filter_listings(curated(t), today=TODAY, upcoming=True), TODAY, "de")
    return rows.select("id", "section", F.date_format("month", "yyyy-MM").alias("month"))


@check("o06_month_headings", f"""
SELECT section, month, count(*) AS n FROM (
  SELECT CASE WHEN id % 9 = 0 THEN 'always_open' ELSE 'dated' END AS section,
    CASE WHEN id % 9 <> 0 THEN strftime({RELEVANT}, '%Y-%m') END AS month FROM listings_v WHERE {UPCOMING})
GROUP BY section, month""")
def headings(t):
    rows = ops.grouped_by_month(flt.filter_listings(curated(t), today=TODAY, upcoming=True), TODAY, "de")
    return ops.month_headings(rows).select("section", F.date_format("month", "yyyy-MM").alias("month"), "n")


@check("o07_day_groups", f"""
SELECT {ID}, CAST(start_date AS VARCHAR) AS day FROM listings_v
WHERE start_date BETWEEN DATE '{TODAY}' AND DATE '{TODAY}' + 7""")
def days(t):
    w = flt.calendar_window("week", flt.day(TODAY))
    return ops.grouped_by_day(t.listings, w["date_from"], w["date_to"]).select("id", iso(F.col("start_date")).alias("day"))


@check("o08_communes_by_name", "SELECT DISTINCT p_name AS name FROM part")
def communes(t):
    return t.part.select(F.col("p_name").alias("name")).distinct().orderBy("name")


@check("w01_dedupe_places", f"""
WITH {SCORED} SELECT id FROM scored QUALIFY row_number() OVER (PARTITION BY kind,
  CASE WHEN lat IS NULL THEN id ELSE lower(name) END, round(lat, 4), round(lng, 4)
  ORDER BY family_score DESC, osm_id) = 1""")
def dedupe(t):
    return pl.dedupe_places(scored_places(t)).select("id")


@check("w03_first_accepting", f"WITH {SCORED} SELECT osm_id, kind FROM scored")
def accepting(t):
    return pl.classify(t.elements).select("osm_id", "kind")


def sitemap(t):
    """Entries per source: every page url twice, change dates on some."""
    key = F.col("page_id")
    e = t.pages.select((key % 7).alias("source_id"), "url", "page_id",
                       F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
    mod = F.when(key % 3 == 0, F.lit("")).otherwise(iso(F.date_add(F.lit("2024-01-01").cast("date"), (key % 50).cast("int"))))
    return e.select("source_id", "url", F.when(F.col("copy") == 0, mod).otherwise(F.lit("2030-01-01")).alias("lastmod"),
                    (key * 2 + F.col("copy")).alias("position"))


@check("w06_freshest_entries", """
WITH e AS (SELECT page_id % 7 AS source_id, url, page_id * 2 AS position,
    CASE WHEN page_id % 3 = 0 THEN '' ELSE CAST(DATE '2024-01-01' + CAST(page_id % 50 AS INT) AS VARCHAR) END AS lastmod FROM pages),
d AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY source_id, url ORDER BY position) = 1)
SELECT source_id, url, lastmod FROM d
QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY lastmod DESC, position) <= 10""")
def freshest(t):
    return ops.freshest(sitemap(t), 10).select("source_id", "url", "lastmod")


ROTATION = """items AS (SELECT page_id % 7 AS source_id, (page_id - page_id % 7) // 7 AS position, page_id FROM pages),
listed AS (SELECT source_id, count(*) AS listed, source_id * 31 AS crawl_cursor FROM items GROUP BY source_id),
turned AS (SELECT *, (position - crawl_cursor % listed + listed) % listed AS turn FROM items JOIN listed USING (source_id))"""


def rotation(t):
    key = F.col("page_id")
    items = t.pages.select((key % 7).alias("source_id"), F.expr("page_id div 7").alias("position"), "page_id")
    cursors = items.select("source_id").distinct().withColumn("crawl_cursor", F.col("source_id") * 31)
    return ops.rotate(items, cursors, 5)


@check("w07_rotate_to_cursor", f"WITH {ROTATION} SELECT source_id, page_id, turn FROM turned WHERE turn < 5")
def rotate(t):
    return rotation(t).select("source_id", "page_id", "turn")


@check("w07_next_cursor", f"""
WITH {ROTATION} SELECT source_id, (max(crawl_cursor) % max(listed) + count(*)) % max(listed) AS crawl_cursor
FROM turned WHERE turn < 5 GROUP BY source_id""")
def next_cursor(t):
    return ops.next_cursors(rotation(t))


@check("w08_empty_streak", """
WITH r AS (SELECT user_id AS source_id, ts AS run_at, CASE WHEN value > 8 THEN 1 ELSE 0 END AS seen FROM events),
l AS (SELECT source_id, max(run_at) FILTER (WHERE seen > 0) AS last_seen FROM r GROUP BY source_id)
SELECT source_id, count(*) FILTER (WHERE last_seen IS NULL OR run_at > last_seen) AS empty_runs,
  count(*) FILTER (WHERE last_seen IS NULL OR run_at > last_seen) >= 3 AS warn
FROM r JOIN l USING (source_id) GROUP BY source_id""")
def streak(t):
    runs = t.events.select(F.col("user_id").alias("source_id"), F.col("ts").alias("run_at"),
                           F.when(F.col("value") > 8, 1).otherwise(0).alias("seen"))
    return ops.empty_streak(runs)


SITE = "page_id % 11"
RANKED_URLS = """u AS (SELECT page_id % 11 AS site, CASE page_id % 5 WHEN 0 THEN 'https://s.lu/fr/agenda/x' || page_id
    WHEN 1 THEN 'https://s.lu/shop/agenda/' || page_id WHEN 2 THEN 'https://s.lu/a/b/c/atelier' || page_id
    ELSE 'https://s.lu/blog/event' || page_id END AS url FROM pages),
r AS (SELECT *, url[13:] AS path FROM u)"""


@check("w09_best_example_url", f"""
WITH {RANKED_URLS} SELECT site, url FROM r QUALIFY row_number() OVER (PARTITION BY site ORDER BY
  CASE WHEN contains(path, '/agenda/') THEN 0 ELSE 1 END, CASE WHEN contains(path, '/shop/') OR contains(path, '/blog/') THEN 1 ELSE 0 END,
  length(path) - length(replace(path, '/', '')), length(path), url) <= 3""")
def best(t):
    key = F.col("page_id")
    s = key.cast("string")
    url = (F.when(key % 5 == 0, F.concat(F.lit("https://s.lu/fr/agenda/x"), s))
           .when(key % 5 == 1, F.concat(F.lit("https://s.lu/shop/agenda/"), s))
           .when(key % 5 == 2, F.concat(F.lit("https://s.lu/a/b/c/atelier"), s))
           .otherwise(F.concat(F.lit("https://s.lu/blog/event"), s)))
    return ops.best_urls(t.pages.select((key % 11).alias("site"), url.alias("url")), ["site"], 3).select("site", "url")


@check("w10_page", f"""
SELECT {ID}, (SELECT count(*) FROM listings_v WHERE {UPCOMING}) AS total FROM listings_v WHERE {UPCOMING}
ORDER BY featured DESC, {RELEVANT}, start_date DESC, CAST(id AS VARCHAR) LIMIT 20 OFFSET 40""")
def page(t):
    hits = flt.filter_listings(t.listings, today=TODAY, upcoming=True)
    rows, total = ops.page(hits, ops.relevance_keys(TODAY), skip=40, limit=20)
    return rows.select("id").join(total)


@check("j10_hydrate_page", f"""
SELECT {ID}, title_en, town FROM listings_v WHERE {LOCATED} ORDER BY {DIST}, CAST(id AS VARCHAR) LIMIT 20""")
def hydrate(t):
    from pyspark.sql import Window

    narrow = ops.with_distance(t.listings.select("id", "lat", "lng"), CENTRE).filter("distance_km IS NOT NULL")
    top = narrow.orderBy("distance_km", "id").limit(20)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy("distance_km", "id")))
    return ops.hydrate(ranked.select("id", "rank"), t.listings).select("id", F.col("title.en").alias("title_en"), "town")


@check("f27_date_notes", f"""
SELECT {ID}, CASE WHEN start_date >= DATE '{TODAY}' THEN 'none' WHEN end_date >= DATE '{TODAY}' THEN 'runsUntil' ELSE 'startedOn' END AS kind,
  CAST(CASE WHEN start_date >= DATE '{TODAY}' THEN NULL WHEN end_date >= DATE '{TODAY}' THEN end_date ELSE start_date END AS VARCHAR) AS day,
  CAST({RELEVANT} AS VARCHAR) AS box_date FROM listings_v""")
def notes(t):
    start, end, today = F.col("start_date"), F.col("end_date"), flt.day(TODAY)
    note = dates.date_note(start, end, today)
    return t.listings.select("id", note["kind"].alias("kind"), iso(note["date"]).alias("day"),
                             iso(dates.relevant_from(start, today)).alias("box_date"))


@check("u04_distinct_in_order", """
SELECT url, min(page_id * 2) AS position FROM pages GROUP BY url""")
def distinct_urls(t):
    from ...operators.sets import distinct_in_order

    return distinct_in_order(sitemap(t), ["url"]).select("url", "position")
