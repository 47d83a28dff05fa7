"""Quality jobs, each as the report it gives or the snapshot it makes."""

from pyspark.sql import functions as F

from ...functions import text as tx
from ...functions.dates import iso
from ...operators import aggregates as agg
from ...sources import registry
from .. import evidence, quality as ops
from ..views import TODAY
from .base import check
from .feeds import now, sources
from .filters import SCORED, scored_places
from .towns import CANONICAL, written_towns

def hinted(t):
    """Hint texts as stored listings that know nothing yet."""
    none = tx.localized(F.lit(""))
    return t.hint_texts_v.select(
        "id", tx.localized(F.lit("Fest")).alias("title"), none.alias("short"),
        F.struct(F.lit("").alias("en"), F.lit("").alias("de"), F.col("text").alias("fr")).alias("description"),
        F.lit(0).alias("age_min"), F.lit(99).alias("age_max"), F.lit("unknown").alias("age_source"), F.lit(None).cast("double").alias("price_adult"),
        F.lit(None).cast("double").alias("price_child"), F.lit(False).alias("price_free"), F.lit("unknown").alias("price_source"),
        tx.localized(F.lit("Price not stated")).alias("price_label"))


@check("q01_reread_age_price", """
SELECT id, field, old, new FROM (
  SELECT id, 'age_min' AS field, '0' AS old, CASE id % 6 WHEN 0 THEN CAST(p_size % 17 AS VARCHAR) WHEN 1 THEN CAST(p_size % 9 AS VARCHAR) END AS new FROM hint_texts_v
  UNION ALL SELECT id, 'age_max', '99', CASE id % 6 WHEN 1 THEN CAST(p_size % 9 + 4 AS VARCHAR) END FROM hint_texts_v
  UNION ALL SELECT id, 'age_source', 'unknown', CASE WHEN id % 6 <= 1 THEN 'event' END FROM hint_texts_v
  UNION ALL SELECT id, 'price_adult', NULL, CASE id % 6 WHEN 3 THEN '0.0' WHEN 4 THEN p_size || '.5' END FROM hint_texts_v
  UNION ALL SELECT id, 'price_child', NULL, CASE id % 6 WHEN 3 THEN '0.0' END FROM hint_texts_v
  UNION ALL SELECT id, 'price_free', 'false', CASE id % 6 WHEN 3 THEN 'true' END FROM hint_texts_v
  UNION ALL SELECT id, 'price_source', 'unknown', CASE WHEN id % 6 IN (3, 4) THEN 'event' END FROM hint_texts_v)
WHERE new IS NOT NULL AND new IS DISTINCT FROM old""")
def reread(t):
    return ops.report(ops.reread_age_and_price(hinted(t))).filter("field <> 'price_label'")


def titled(t):
    d = F.to_date("o_orderdate")
    k = F.col("o_orderkey")
    title = F.when(k % 2 == 0, F.concat(F.lit("Fest | "), F.date_format(d, "dd.MM.yyyy"))).otherwise(F.lit("Fest"))
    return t.orders.select(k.cast("string").alias("id"), tx.localized(title).alias("title"),
                           F.when(k % 3 == 0, d).otherwise(F.date_add(d, 30)).alias("start_date"))


@check("q02_dates_from_titles", """
SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(CAST(o_orderdate AS DATE) + 30 AS VARCHAR) AS was, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS start_date
FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 AND year(o_orderdate) BETWEEN 1997 AND 2003""")
def from_titles(t):
    rows = ops.changed(ops.dates_from_titles(titled(t), TODAY, now()))
    return ops.apply(rows).select("id", iso(F.col("date_corrected.was")).alias("was"), iso(F.col("start_date")).alias("start_date"))


@check("q03_impossible_dates", """
SELECT CAST(id AS VARCHAR) AS id, CASE WHEN year(start_date) NOT BETWEEN 1997 AND 2003 THEN CAST(start_date AS VARCHAR) END AS bad_start, false AS published
FROM listings_v WHERE (year(start_date) NOT BETWEEN 1997 AND 2003 OR year(end_date) NOT BETWEEN 1997 AND 2003)""")
def impossible(t):
    rows = ops.apply(ops.changed(ops.hide_impossible_dates(t.listings, TODAY)))
    return rows.select("id", iso(F.col("date_flag.start_date")).alias("bad_start"), "published")


@check("q04_recategorise", """
SELECT CAST(id AS VARCHAR) AS id, concat_ws('|', category_1, category_2) AS old, CASE WHEN source_id % 2 = 1 THEN 'Animals' ELSE 'Culture' END AS new
FROM listings_v WHERE NOT (source_id % 2 = 0 AND category_1 = 'Culture' AND category_2 IS NULL)""")
def recategorise(t):
    rows = ops.changed(ops.recategorise(t.listings, sources(t)))
    return rows.select("id", F.array_join("category", "|").alias("old"), F.array_join("_new.category", "|").alias("new"))


@check("q04_neutral_defaults", """
SELECT DISTINCT o_custkey % 50 AS source_id, 'Culture' AS category FROM orders WHERE o_custkey % 50 % 2 = 0""")
def neutral(t):
    rows = ops.apply(ops.changed(ops.neutral_defaults(sources(t))))
    return rows.select("source_id", F.array_join("category_default", "|").alias("category"))


@check("q05_refile_places", f"""
WITH {SCORED} SELECT id, 'zoo' AS old, kind AS new, grp AS "group" FROM scored WHERE osm_id % 2 = 0""")
def refile(t):
    even = F.col("osm_id") % 2 == 0
    stored = scored_places(t).withColumns({"kind": F.when(even, "zoo").otherwise(F.col("kind")), "group": F.when(even, "animals").otherwise(F.col("group"))})
    rows = ops.changed(ops.refile_places(stored))
    return rows.select("id", F.col("kind").alias("old"), F.col("_new.kind").alias("new"), F.col("_new.group").alias("group"))


@check("q06_normalise_towns", f"""
SELECT old, new, count(*) AS n FROM (SELECT {CANONICAL} AS new, CASE p_partkey % 7 WHEN 0 THEN upper(replace(p_name, 'e', 'é')) WHEN 1 THEN p_name || '-Stadt' WHEN 2 THEN 'Lux.'
  WHEN 3 THEN 'Esch' WHEN 4 THEN 'com ' || p_name WHEN 5 THEN 'Belval Centre' ELSE ' ' END AS old FROM part) WHERE old <> new AND new <> '' GROUP BY old, new""")
def towns(t):
    rows = ops.changed(ops.normalise_towns(written_towns(t), t.communes))
    return agg.moves(rows.select(F.col("town").alias("old"), F.col("_new.town").alias("new")))


def padded(t):
    k = F.col("doc_id")
    prose = F.when(k % 2 == 0, F.concat(F.lit("[vc_row] "), "text", F.lit("  "))).otherwise(F.trim(F.regexp_replace("text", r"\s+", " ")))
    prose = F.when(k % 10 == 0, F.lit("[vc_row][/vc_row]")).otherwise(prose)
    return t.documents.select(k.alias("id"), tx.localized(F.lit("  Titel")).alias("title"), tx.localized(prose).alias("description"), tx.localized(F.lit("Kuerz ")).alias("short"))


@check("q07_clean_texts", r"""
WITH c AS (SELECT doc_id AS id, CASE WHEN doc_id % 10 = 0 THEN 'Titel' ELSE trim(regexp_replace(text, '\s+', ' ', 'g')) END AS description FROM documents)
SELECT id, 'Titel' AS title, description, CASE WHEN id % 2 = 0 THEN substr(description, 1, 120) ELSE 'Kuerz' END AS short FROM c""")
def clean(t):
    rows = ops.apply(ops.clean_texts(padded(t)))
    return rows.select("id", F.col("title.de").alias("title"), F.col("description.fr").alias("description"), F.col("short.en").alias("short"))


@check("q08_safety_audit", """
SELECT 'documents' AS collection, CAST(doc_id AS VARCHAR) AS id, 'explicit' AS reason, 'Peep-Show' AS matched FROM documents WHERE doc_id % 13 = 0
UNION ALL SELECT 'places', CAST(osm_id AS VARCHAR), 'explicit', 'Laufhaus' FROM places_v WHERE osm_id % 17 = 0""")
def audit(t):
    docs = t.documents.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit(" (Peep-Show)"))).otherwise(F.col("text")).alias("text"))
    places = t.places_v.select(F.col("osm_id").alias("id"), F.when(F.col("osm_id") % 17 == 0, F.lit("Laufhaus Nord")).otherwise(F.col("tag_name")).alias("name"))
    found = ops.safety_findings(docs, places, ["text"], ["name"])
    return found.withColumn("collection", F.when(F.col("collection") == "listings", "documents").otherwise(F.col("collection")))


@check("q08_hide_unsafe", """
SELECT doc_id AS id, doc_id % 13 <> 0 AS published, CASE WHEN doc_id % 13 = 0 THEN 'Peep-Show' END AS matched FROM documents""")
def hide(t):
    docs = t.documents.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit(" (Peep-Show)"))).otherwise(F.col("text")).alias("text"),
                              F.lit(True).alias("published"))
    return ops.apply(ops.hide_unsafe(docs, F.col("text"), now())).select("id", "published", F.col("family_flag.matched").alias("matched"))


@check("q09_blank_stock_images", """
SELECT page_id AS id, CASE WHEN page_id % 3 = 0 THEN '' ELSE url END AS image FROM pages""")
def stock(t):
    image = F.when(F.col("page_id") % 3 == 0, "https://source.unsplash.com/x").otherwise(F.col("url"))
    return ops.apply(ops.blank_stock_images(t.pages.select(F.col("page_id").alias("id"), image.alias("image"))))


@check("q10_fill_centroids", f"""
WITH {SCORED}, c AS (SELECT l_partkey AS osm_id, avg(49.5 + l_suppkey::DOUBLE / 1000) AS la, avg(6.0 + l_linenumber::DOUBLE / 100) AS ln FROM lineitem GROUP BY l_partkey)
SELECT id, round(la, 6) AS lat, round(ln, 6) AS lng, 'relation_centroid' AS precision FROM scored JOIN c USING (osm_id) WHERE osm_type = 'relation' AND lat IS NULL""")
def centroids(t):
    points = t.lineitem.select(F.col("l_partkey").alias("osm_id"), (F.lit(49.5) + F.col("l_suppkey").cast("double") / 1000).alias("lat"),
                               (F.lit(6.0) + F.col("l_linenumber").cast("double") / 100).alias("lng"))
    rows = ops.apply(ops.changed(ops.fill_centroids(scored_places(t), points)))
    return rows.select("id", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), F.col("geocode_precision").alias("precision"))


@check("q12_commune_index", """
WITH b AS (SELECT p_partkey AS osm_id, p_name AS name, 49.45 + (p_partkey * 37 % 100) * 0.007 + 0.001 AS lat, 5.75 + (p_partkey * 53 % 100) * 0.008 + 0.001 AS lng FROM part WHERE p_partkey % 5 <> 4),
c AS (SELECT *, CASE region_id % 3 WHEN 0 THEN 'Wiltz' WHEN 1 THEN 'Luxembourg' END AS canton FROM regions_v)
SELECT osm_id, b.name, array_to_string(list_sort(list_distinct([b.name, 'L ' || b.name])), '|') AS names, round(b.lat, 6) AS lat, round(b.lng, 6) AS lng, c.canton
FROM b JOIN c ON c.canton IS NOT NULL AND round(b.lat, 6) >= miny AND round(b.lat, 6) < miny + 0.14 AND round(b.lng, 6) >= minx AND round(b.lng, 6) < minx + 0.16""")
def index(t):
    k = F.col("p_partkey")
    entry = lambda key, value: F.struct(F.lit(key).alias("key"), value.alias("value"))
    tags = F.map_from_entries(F.array_compact(F.array(
        entry("name", F.col("p_name")), entry("name:lb", F.concat(F.lit("L "), "p_name")), entry("name:de", F.lit(" ")),
        F.when(k % 5 != 4, entry("ref:lau2", k.cast("string"))))))
    lat, lng = F.lit(49.45) + (k * 37 % 100) * F.lit(0.007), F.lit(5.75) + (k * 53 % 100) * F.lit(0.008)
    corner = lambda a, b: F.struct((lat + a).alias("lat"), (lng + b).alias("lng"))
    rows = t.part.select(k.alias("osm_id"), tags.alias("tags"), F.array(corner(0.0, 0.0), corner(0.002, 0.0), corner(0.002, 0.002), corner(0.0, 0.002)).alias("points"))
    r = F.col("region_id")
    cantons = t.regions.withColumn("name", F.when(r % 3 == 0, "Canton Wiltz").when(r % 3 == 1, "Kanton Lëtzebuerg").otherwise("Condominium"))
    return ops.commune_index(rows, cantons).select("osm_id", "name", F.array_join("names", "|").alias("names"), "lat", "lng", "canton")


@check("q14_site_evidence", """
SELECT CASE WHEN k % 8 = 7 THEN 'FEHLER' WHEN k % 8 = 6 THEN 'GESPERRT' WHEN k % 8 = 5 THEN 'NICHTS GEFUNDEN' ELSE 'KANDIDAT' END AS status, s_name AS name,
  CASE WHEN k % 8 = 7 THEN '' WHEN k % 8 = 6 THEN 'verbietet' ELSE 'erlaubt' END AS robots, CASE WHEN k % 8 < 6 AND k % 2 = 0 THEN '5' ELSE '' END AS delay,
  CASE WHEN k % 8 < 4 OR k % 8 = 5 THEN 'https://s' || k || '.lu/' || CASE WHEN k % 8 = 3 THEN 'sitemap.xml' ELSE 'map.xml' END ELSE '' END AS sitemap,
  CASE WHEN k % 8 >= 6 THEN '' WHEN k % 8 = 5 THEN '0' WHEN k % 8 = 4 THEN '1' ELSE '3' END AS n,
  CASE WHEN k % 8 >= 5 THEN '' WHEN k % 8 = 4 THEN 'https://s' || k || '.lu/events' WHEN k % 8 = 1 THEN 'https://s' || k || '.lu/fr/a/agenda/y' ELSE 'https://s' || k || '.lu/agenda/x' END AS example,
  CASE WHEN k % 8 >= 5 THEN '' WHEN k % 8 IN (0, 1) THEN 'ja' ELSE 'nein' END AS markup,
  CASE WHEN k % 8 = 7 THEN 'unbrauchbare Adresse' WHEN k % 8 = 6 THEN 'robots.txt untersagt das Crawlen' WHEN k % 8 = 4 THEN 'keine Sitemap, Pfad geraten' ELSE '' END AS note
FROM (SELECT *, s_suppkey AS k FROM supplier)""")
def site_evidence(t):
    k = F.col("s_suppkey")
    home = F.concat(F.lit("https://s"), k.cast("string"), F.lit(".lu"))
    at = lambda tail: F.concat(home, F.lit(tail))
    site = t.supplier.select(F.col("s_name").alias("name"), F.when(k % 8 == 7, "kein-url").otherwise(at("/")).alias("website"))
    robots = t.supplier.filter(k % 8 < 7).select(F.concat(F.lit("s"), k.cast("string"), F.lit(".lu")).alias("host"), F.concat(
        F.lit("User-agent: bad\nDisallow: /\nUser-agent: *\n"), F.when(k % 8 == 6, "Disallow: /\n").otherwise("Disallow: /intern\n"),
        F.when(k % 2 == 0, "Crawl-delay: 5\n").otherwise(""), F.when((k % 8 < 3) | (k % 8 == 5), F.concat(F.lit("Sitemap: "), at("/map.xml"))).otherwise("")).alias("robots"))
    loc = lambda u: F.concat(F.lit("<url><loc>"), u, F.lit("</loc></url>"))
    flat = F.concat(F.lit("<urlset>"), loc(at("/shop/agenda/z")), loc(at("/agenda/x")), loc(at("/fr/a/agenda/y")), loc(at("/tag/agenda")), loc(at("/kontakt")), F.lit("</urlset>"))
    inner = F.concat(F.lit("<sitemapindex><sitemap><loc>"), at("/part.xml?page=1"), F.lit("</loc></sitemap></sitemapindex>"))
    nothing = F.concat(F.lit("<urlset>"), loc(at("/kontakt")), F.lit("</urlset>"))
    docs = t.supplier.filter(k % 8 < 4).select(F.when(k % 8 == 3, at("/sitemap.xml")).otherwise(at("/map.xml")).alias("doc_url"), F.when(k % 8 == 2, inner).otherwise(flat).alias("xml")) \
        .unionByName(t.supplier.filter(k % 8 == 2).select(at("/part.xml?page=1").alias("doc_url"), flat.alias("xml"))) \
        .unionByName(t.supplier.filter(k % 8 == 5).select(at("/map.xml").alias("doc_url"), nothing.alias("xml")))
    markup = F.lit('<script type="application/ld+json">{"@type": "Event"}</script>')
    pages = t.supplier.select(F.when(k % 8 == 0, at("/agenda/x")).when(k % 8 == 1, at("/fr/a/agenda/y")).otherwise(at("/events")).alias("url"),
                              F.when(k % 8 < 2, markup).otherwise(F.lit("<p>x</p>")).alias("html"))
    rows = evidence.site_evidence(site, robots, docs, pages)
    return rows.select(F.col("Status").alias("status"), F.col("Gemeinde").alias("name"), "robots", F.col("Crawl-Delay").alias("delay"), F.col("Sitemap").alias("sitemap"),
                       F.col("Veranstaltungsseiten").alias("n"), F.col("Beispiel-URL").alias("example"), F.col("JSON-LD").alias("markup"), F.col("Hinweis").alias("note"))


@check("q15_activation", """
SELECT s_name AS name, CASE WHEN s_suppkey % 5 = 0 THEN 'missing' WHEN s_suppkey % 2 = 0 OR s_suppkey % 3 = 0 THEN 'change' ELSE 'already' END AS outcome,
  CASE WHEN s_suppkey % 3 = 0 THEN 200 WHEN s_suppkey % 5 <> 0 THEN 20 END AS max_pages FROM supplier""")
def activation(t):
    k = F.col("s_suppkey")
    stored = t.supplier.filter(k % 5 != 0).select(F.col("s_name").alias("name"), (k % 2 == 1).alias("active"), F.lit(20).alias("max_pages"))
    proven = t.supplier.select(F.col("s_name").alias("name"), F.when(k % 3 == 0, 200).alias("max_pages"))
    return registry.activation(stored, proven).select("name", "outcome", "max_pages")


@check("q15_apply_activation", """
SELECT s_name AS name, s_suppkey % 2 = 1 OR s_suppkey % 3 = 0 AS active, CASE WHEN s_suppkey % 3 = 0 THEN 200 ELSE 20 END AS max_pages FROM supplier""")
def activated(t):
    k = F.col("s_suppkey")
    stored = t.supplier.select(F.col("s_name").alias("name"), (k % 2 == 1).alias("active"), F.lit(20).alias("max_pages"))
    proven = t.supplier.filter(k % 3 == 0).select(F.col("s_name").alias("name"), F.lit(200).alias("max_pages"))
    return registry.apply_activation(stored, registry.activation(stored, proven)).select("name", "active", "max_pages")


@check("q16_preflight", """
SELECT 'orders' AS name, true AS present, count(*) AS n, 'filled' AS advice FROM orders UNION ALL SELECT 'part', true, 0, 'empty' FROM nation WHERE n_nationkey = 0
UNION ALL SELECT 'users', false, 0, 'empty' FROM nation WHERE n_nationkey = 0""")
def preflight(t):
    return ops.preflight({"orders": t.orders, "part": t.part.filter("p_partkey < 0")}, ["orders", "part", "users"])


@check("q17_erase_users", """
SELECT 'user' AS part, CAST(c_custkey AS VARCHAR) AS id, '' AS author FROM customer WHERE c_custkey % 4 <> 0 OR c_custkey = 4
UNION ALL SELECT 'session', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR) FROM orders WHERE o_custkey % 4 <> 0
UNION ALL SELECT 'listing', CAST(o_orderkey AS VARCHAR), CASE WHEN o_custkey % 4 = 0 THEN 'deleted_user' ELSE CAST(o_custkey AS VARCHAR) END FROM orders""")
def erase(t):
    text = lambda c: F.col(c).cast("string")
    users = t.customer.select(text("c_custkey").alias("id"), F.concat(F.lit("U"), text("c_custkey"), F.lit("@x.lu")).alias("email"))
    sessions = t.orders.select(text("o_orderkey").alias("token"), text("o_custkey").alias("user_id"))
    listings = t.orders.select(text("o_orderkey").alias("id"), text("o_custkey").alias("created_by"))
    requests = t.customer.filter("c_custkey % 4 = 0").select(text("c_custkey").alias("user_id"))
    u, s, c = ops.erase_users(users, sessions, listings, requests, "u4@x.lu")
    return u.select(F.lit("user").alias("part"), "id", F.lit("").alias("author")) \
        .unionByName(s.select(F.lit("session").alias("part"), F.col("token").alias("id"), F.col("user_id").alias("author"))) \
        .unionByName(c.select(F.lit("listing").alias("part"), "id", F.col("created_by").alias("author")))
