"""Feed readers over payloads built from the driver's tables, and over its pages."""

import json
from functools import reduce

from pyspark.sql import functions as F

from ...functions.dates import iso
from ...plans.builder import build_listings
from ...sources import feeds as ops, kinds
from ..views import TODAY
from .base import CHECKS, check

DAY = "CAST(CAST(o_orderdate AS DATE) AS VARCHAR)"
GATE = "year(o_orderdate) BETWEEN 1997 AND 2003"


def now():
    return F.lit("2024-01-01 00:00:00").cast("timestamp")


def sources(t):
    """Fifty feeds, derived from the customers that placed orders."""
    s = t.orders.select((F.col("o_custkey") % 50).alias("source_id")).distinct()
    k = F.col("source_id")
    return s.select(
        "source_id", F.concat(F.lit("Gemeng "), k.cast("string"), F.lit(" (x) — Agenda")).alias("name"),
        F.when(k % 2 == 0, "Wiltz").otherwise("Mersch").alias("canton_default"),
        F.when(k % 3 == 0, F.concat(F.lit("Town "), k.cast("string"))).alias("town_default"),
        F.when(k % 2 == 0, F.array(F.lit("Culture"), F.lit("Festivals"))).otherwise(F.array(F.lit("Animals"))).alias("category_default"),
        F.lit(0).alias("age_min_default"), F.when(k % 4 == 0, 12).otherwise(99).alias("age_max_default"),
        (F.lit(49.5) + k / 100).alias("lat_default"), F.lit(6.1).alias("lng_default"), F.lit("").alias("image_default"))


def json_payloads(t):
    """Orders as portal records: one payload per customer, three shapes, three sets of field names."""
    k = F.col("o_orderkey")
    d = F.to_date("o_orderdate")
    key, text = k.cast("string"), F.col("o_orderpriority")
    record = (F.when(k % 3 == 0, F.to_json(F.struct(key.alias("id"), text.alias("title"), iso(d).alias("start"), F.lit(49.9).alias("lat"), F.lit(6.2).alias("lng"))))
              .when(k % 3 == 1, F.to_json(F.struct(k.alias("uid"), text.alias("name"), F.date_format(d, "dd.MM.yyyy").alias("date"), F.lit("Ville X").alias("ville"))))
              .otherwise(F.to_json(F.struct(F.lit("").alias("id"), key.alias("_id"), text.alias("nom"), F.lit("12:30").alias("start")))))
    c = F.col("o_custkey")
    list_ = F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("record")), ","), F.lit("]"))
    g = t.orders.withColumn("record", record).groupBy("o_custkey").agg(list_.alias("list"))
    body = (F.when(c % 3 == 0, F.col("list")).when(c % 3 == 1, F.concat(F.lit('{"result":{"records":'), "list", F.lit("}}")))
            .otherwise(F.concat(F.lit('{"records":'), "list", F.lit("}"))))
    return g.select((c % 50).alias("source_id"), body.alias("payload"))


SOURCE = "o_custkey % 50 AS source_id"


@check("s02_open_data_json", f"""
SELECT {SOURCE}, CAST(o_orderkey AS VARCHAR) AS external_id, o_orderpriority AS title, {DAY} AS start_date,
  CASE WHEN o_orderkey % 3 = 1 THEN 'Ville X' WHEN o_custkey % 50 % 3 = 0 THEN 'Town ' || (o_custkey % 50) ELSE 'Luxembourg' END AS town,
  round(CASE WHEN o_orderkey % 3 = 0 THEN 49.9 ELSE 49.5 + (o_custkey % 50) / 100 END::DOUBLE, 6) AS lat
FROM orders WHERE o_orderkey % 3 < 2 AND {GATE}""")
def open_data(t):
    rows = ops.from_open_data_json(json_payloads(t), sources(t), TODAY)
    return rows.select("source_id", "external_id", "title", iso(F.col("start_date")).alias("start_date"), "town", F.round("lat", 6).alias("lat"))


def calendars(t):
    """One calendar per customer: timed, whole-day and ended events, folded lines, escapes."""
    k, d = F.col("o_orderkey"), F.to_date("o_orderdate")
    stamp = F.date_format(d, "yyyyMMdd")
    nl = F.lit("\r\n")
    start = F.when(k % 3 == 0, F.concat(F.lit("DTSTART;VALUE=DATE:"), stamp)).otherwise(F.concat(F.lit("DTSTART:"), stamp, F.lit("T183000Z")))
    end = F.when(k % 3 == 1, F.concat(F.lit("DTEND;TZID=Europe/Luxembourg:"), stamp, F.lit("T200000"), nl)).otherwise(F.lit(""))
    block = F.concat(F.lit("BEGIN:VEVENT"), nl, F.when(k % 10 != 9, F.concat(F.lit("UID:u"), k.cast("string"), nl)).otherwise(F.lit("")),
                     start, nl, end, F.lit("SUMMARY:Fest\\, grouss "), nl, F.lit(" "), k.cast("string"), nl, F.lit("LOCATION:Hal "),
                     (k % 5).cast("string"), nl, F.lit("END:VEVENT"), nl)
    g = t.orders.withColumn("b", F.struct(k.alias("k"), block.alias("b"))).groupBy("o_custkey").agg(F.array_sort(F.collect_list("b")).alias("bs"))
    body = F.concat(F.lit("BEGIN:VCALENDAR\r\n"), F.array_join(F.transform("bs", lambda x: x["b"]), ""), F.lit("END:VCALENDAR\r\n"))
    return g.select((F.col("o_custkey") % 50).alias("source_id"), body.alias("payload"))


@check("s03_ical", f"""
SELECT {SOURCE}, 'u' || o_orderkey AS external_id, 'Fest, grouss ' || o_orderkey AS title, {DAY} AS start_date,
  CASE WHEN o_orderkey % 3 = 1 THEN {DAY} END AS end_date, 'Hal ' || (o_orderkey % 5) AS town,
  CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN '18:30 - 20:00' ELSE '18:30' END AS time
FROM orders WHERE o_orderkey % 10 <> 9 AND {GATE}""")
def ical(t):
    rows = ops.from_ical(calendars(t), sources(t), TODAY)
    return rows.select("source_id", "external_id", "title", iso(F.col("start_date")).alias("start_date"), iso(F.col("end_date")).alias("end_date"), "town", "time")


def ld_pages(t):
    """Pages with a structured block made from the order of the same number: broken, nested, very deep."""
    k = F.col("page_id")
    d = F.to_date("o_orderdate")
    node = F.to_json(F.struct(
        F.when(k % 2 == 0, F.lit('MusicEvent')).otherwise(F.lit("Event")).alias("@type"), F.concat(F.lit("Fit &#038; Fun "), k.cast("string")).alias("name"),
        F.concat(iso(d), F.lit("T19:30:00")).alias("startDate"), F.concat(F.lit("https://x.lu/events/"), k.cast("string")).alias("url"),
        F.struct(F.struct(F.lit("Béiwen").alias("addressLocality")).alias("address"),
                 F.struct(F.lit("49.75").alias("latitude"), F.lit(6.25).alias("longitude")).alias("geo")).alias("location"),
        F.array(F.struct(F.lit("/bild.jpg").alias("url"))).alias("image")))
    wrap = lambda key, inner: F.concat(F.lit('{"' + key + '":['), inner, F.lit("]}"))
    deep = node
    for key in ("item", "itemListElement", "subEvent", "@graph", "item", "@graph", "item"):
        deep = wrap(key, deep)
    body = (F.when(k % 7 == 6, F.concat(node, F.lit(","))).when(k % 5 == 1, wrap("@graph", F.concat(F.lit('{"@type":"WebSite"},'), node)))
            .when(k % 5 == 2, F.concat(F.lit('[[{"itemListElement":[{"item":'), node, F.lit("}]}]]"))).when(k % 5 == 3, deep).otherwise(node))
    script = F.concat(F.lit('<script type="application/ld+json" id="x">'), body, F.lit("</script>"))
    o = t.orders.select(F.col("o_orderkey").alias("page_id"), "o_orderdate", "o_custkey")
    return t.pages.join(o, "page_id").select("page_id", (F.col("o_custkey") % 50).alias("source_id"), "url",
                                             F.concat("html", script).alias("html"))


@check("s04_json_ld", f"""
SELECT {SOURCE}, 'https://x.lu/events/' || page_id AS external_id, 'Fit & Fun ' || page_id AS title, {DAY} AS start_date, '19:30' AS time,
  'Béiwen' AS town, 49.75::DOUBLE AS lat, 6.25::DOUBLE AS lng, regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/bild.jpg' AS image
FROM pages JOIN orders ON page_id = o_orderkey WHERE page_id % 7 <> 6 AND {GATE}""")
def json_ld(t):
    rows = ops.from_json_ld(ld_pages(t), sources(t), TODAY)
    return rows.select("source_id", "external_id", "title", iso(F.col("start_date")).alias("start_date"), "time", "town", "lat", "lng", "image")


@check("f41_json_ld_nodes", """
SELECT page_id, CASE WHEN page_id % 5 = 1 THEN 1 WHEN page_id % 5 = 2 THEN 2 WHEN page_id % 5 = 3 THEN 7 ELSE 0 END > 4 AS deep
FROM pages JOIN orders ON page_id = o_orderkey WHERE page_id % 7 <> 6""")
def nodes(t):
    return ops.json_ld_events(ld_pages(t)).select("page_id", (F.col("level") > 4).alias("deep"))


def og_pages(t):
    """Pages whose date stands in the title, a time tag, a meta tag, the text, or nowhere."""
    k, d = F.col("page_id"), F.to_date("o_orderdate")
    title = F.when(k % 5 == 0, F.concat(F.lit("Mini | "), F.date_format(d, "dd.MM.yyyy"))).otherwise(F.concat(F.lit("Fest "), k.cast("string")))
    extra = (F.when(k % 5 == 1, F.concat(F.lit("<time>13:15</time><time datetime='"), iso(d), F.lit("'>x</time>")))
             .when(k % 5 == 2, F.concat(F.lit('<meta name="article:published_time" content="'), iso(d), F.lit('T10:00:00Z">')))
             .when(k % 5 == 3, F.concat(F.lit("<p>Am "), F.date_format(d, "d/M/yyyy"), F.lit(" ass Fest</p>"))).otherwise(F.lit("")))
    html = F.concat(F.lit('<meta property="og:title" content="'), title, F.lit('"><meta content="De &amp; Text" property="og:description">'),
                    F.regexp_replace("html", r"\d", ""), extra)
    o = t.orders.select(F.col("o_orderkey").alias("page_id"), "o_orderdate")
    return t.pages.join(o, "page_id").select("page_id", F.concat(F.lit("https://x.lu/p"), k.cast("string")).alias("url"), html.alias("html"))


@check("s05_open_graph", f"""
SELECT page_id, 'https://x.lu/p' || page_id AS external_id, CASE WHEN page_id % 5 = 0 THEN 'Mini | ' || strftime(o_orderdate, '%d.%m.%Y') ELSE 'Fest ' || page_id END AS title,
  'De & Text' AS description, {DAY} AS start_date FROM pages JOIN orders ON page_id = o_orderkey WHERE page_id % 5 < 4 AND {GATE}""")
def open_graph(t):
    rows = ops.from_open_graph(og_pages(t), TODAY)
    return rows.select("page_id", "external_id", "title", "description", iso(F.col("start_date")).alias("start_date"))


def card_pages(t):
    """One listing page per customer, a card per order."""
    k, d = F.col("o_orderkey"), F.to_date("o_orderdate")
    card = F.concat(F.lit('<div class="card event-card wide"><h3 class="t">Fest '), k.cast("string"), F.lit(" &amp; Spill</h3><time class=\"date\" datetime=\""), iso(d),
                    F.lit('">gläich</time><span class="venue">Lieu | <b>Hal</b> '), (k % 4).cast("string"), F.lit("</span>"),
                    F.when(k % 2 == 0, F.concat(F.lit("<a href='/e/"), k.cast("string"), F.lit("'>méi</a>"))).otherwise(F.lit("")), F.lit("</div>"))
    g = t.orders.withColumn("c", F.struct(k.alias("k"), card.alias("c"))).groupBy("o_custkey").agg(F.array_sort(F.collect_list("c")).alias("cs"))
    return g.select(F.col("o_custkey").alias("page_id"), (F.col("o_custkey") % 50).alias("source_id"), F.lit("https://x.lu/agenda").alias("url"),
                    F.concat(F.lit("<body><div class='cards'></div>"), F.array_join(F.transform("cs", lambda x: x["c"]), "\n"), F.lit("</body>")).alias("html"))


@check("s06_listing_blocks", f"""
SELECT o_custkey AS page_id, CASE WHEN o_orderkey % 2 = 0 THEN '/e/' || o_orderkey ELSE (o_custkey % 50) || ':' || {DAY} || ':Fest ' || o_orderkey || ' & Spill' END AS external_id,
  'Fest ' || o_orderkey || ' & Spill' AS title, {DAY} AS start_date, 'Hal ' || (o_orderkey % 4) AS town FROM orders WHERE {GATE}""")
def blocks(t):
    selectors = {"item": ".event-card", "title": "h3", "date": ".date", "date_attr": "datetime", "location": ".venue", "link": "a"}
    rows = ops.from_listing_blocks(card_pages(t), sources(t), selectors, TODAY)
    return rows.select("page_id", "external_id", "title", iso(F.col("start_date")).alias("start_date"), "town")


@check("s06_select_all", r"""
SELECT page_id, CAST(len(regexp_extract_all(html, '<li><a [^>]*>[^<]*</a></li>')) AS BIGINT) AS links FROM pages""")
def selected(t):
    return t.pages.select("page_id", F.size(ops.select_all(F.col("html"), "li a")).cast("bigint").alias("links"))


def sitemap_docs(t):
    """Seven sitemaps over the pages and an index that lists them."""
    k = F.col("page_id")
    mod = F.when(k % 2 == 0, F.concat(F.lit("<lastmod>2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit("</lastmod>"))).otherwise(F.lit(""))
    entry = F.concat(F.lit("<url>\n<loc> "), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc>"), mod, F.lit("</url>"))
    g = t.pages.select((k % 7).alias("s"), F.struct(k.alias("k"), entry.alias("e")).alias("e")).groupBy("s").agg(F.array_sort(F.collect_list("e")).alias("es"))
    maps = g.select(F.concat(F.lit("https://x.lu/sitemap"), F.col("s").cast("string"), F.lit(".xml")).alias("doc_url"),
                    F.concat(F.lit("<urlset>"), F.array_join(F.transform("es", lambda x: x["e"]), ""), F.lit("</urlset>")).alias("xml"))
    index = maps.agg(F.concat(F.lit("<sitemapindex>"), F.array_join(F.transform(F.array_sort(F.collect_list("doc_url")), lambda u: F.concat(
        F.lit("<sitemap><loc>"), u, F.lit("</loc></sitemap>"))), ""), F.lit("</sitemapindex>")).alias("xml")) \
        .select(F.lit("https://x.lu/index.xml").alias("doc_url"), "xml")
    return maps, index


@check("s07_sitemap_entries", """
SELECT 'https://x.lu/sitemap' || (page_id % 7) || '.xml' AS doc_url, url, CASE WHEN page_id % 2 = 0 THEN '2024-01-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') ELSE '' END AS lastmod FROM pages""")
def sitemap(t):
    return ops.sitemap_entries(sitemap_docs(t)[0]).select("doc_url", "url", "lastmod")


@check("s07_sitemap_index", """
SELECT 'https://x.lu/index.xml' AS doc_url, url, CASE WHEN page_id % 2 = 0 THEN '2024-01-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') ELSE '' END AS lastmod FROM pages""")
def index(t):
    maps, root = sitemap_docs(t)
    return ops.expand_index(ops.sitemap_entries(root), maps).select("doc_url", "url", "lastmod")


@check("s08_robots_sitemaps", """
SELECT n_name AS host, 0 AS position, 'https://' || n_name || '/a.xml' AS sitemap FROM nation
UNION ALL SELECT n_name, 1, 'https://' || n_name || '/b.xml' FROM nation WHERE n_nationkey % 2 = 0""")
def robots(t):
    n = F.col("n_name")
    body = F.concat(F.lit("User-agent: *\r\nDisallow: /x\r\n  SiteMap:  https://"), n, F.lit("/a.xml \r\n#sitemap: no\r\n"),
                    F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("Sitemap: https://"), n, F.lit("/b.xml"))).otherwise(F.lit("Sitemap:\n")))
    return ops.robots_sitemaps(t.nation.select(n.alias("host"), body.alias("robots"))).select("host", "position", "sitemap")


def link_pages(t):
    """Pages with event anchors in front; every fourth describes its events itself."""
    k = F.col("page_id")
    s = k.cast("string")
    anchors = F.concat(F.lit('<a class="x" href="/de/agenda/">A</a><a href="/events/fest-'), s, F.lit('">F</a><a href="/events/fest-'), s,
                       F.lit('">F</a><a href="/events/bild.JPG?x">B</a><a href=\'https://y.lu/veranstaltungen/d&amp;e\'>G</a><a href="/kontakt/">K</a>'))
    ld = F.when(k % 4 == 0, F.concat(F.lit('<script type="application/ld+json">[{"@type":"WebSite","url":"https://x.lu"},{"@type":["Thing","Event"],"url":"https://x.lu/events/e'), s,
                                     F.lit('"}]</script>'))).otherwise(F.lit(""))
    return t.pages.select("page_id", F.lit("https://x.lu/agenda").alias("url"), F.concat(anchors, ld, "html").alias("html"))


@check("s09_event_links", """
SELECT page_id, 1 AS rank, 'https://x.lu/events/e' || page_id AS url FROM pages WHERE page_id % 4 = 0
UNION ALL SELECT page_id, 1, 'https://x.lu/events/fest-' || page_id FROM pages WHERE page_id % 4 <> 0
UNION ALL SELECT page_id, 2, 'https://y.lu/veranstaltungen/d&e' FROM pages WHERE page_id % 4 <> 0
UNION ALL SELECT page_id, 3, 'https://x.lu/de/agenda/' FROM pages WHERE page_id % 4 <> 0""")
def links(t):
    return ops.event_links(link_pages(t))


@check("s10_detail_links", """
SELECT DISTINCT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) || h || '/' AS url
FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="(/[^"/]+)"', 1)) AS h FROM pages)""")
def details(t):
    return ops.detail_links(t.pages, "/")


@check("s11_page_image", """
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://cdn.lu/og.jpg' WHEN 1 THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/icon.png' END AS image FROM pages""")
def image(t):
    k = F.col("page_id")
    head = (F.when(k % 3 == 0, '<meta content="//cdn.lu/og.jpg" property="og:image"><link rel="icon" href="/i.png">')
            .when(k % 3 == 1, '<link href="/icon.png" rel="apple-touch-icon">').otherwise(""))
    return ops.page_image(t.pages.select("page_id", "url", F.concat(head, "html").alias("html")))


@check("s12_probe_pages", """
SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 1 ELSE 0 END AS jsonld_blocks, CAST(CASE WHEN page_id % 4 = 0 THEN 1 ELSE 0 END AS BIGINT) AS jsonld_events,
  1 AS rss_links, 1 AS ical_links, 5 AS event_anchors FROM pages""")
def probe(t):
    head = F.lit('<link type="application/rss+xml" href="/feed"><a href="webcal://x.lu/c">C</a>')
    return ops.probe_pages(link_pages(t).withColumn("html", F.concat(head, "html")))


@check("j02_source_defaults", """
SELECT o_orderkey AS id, CASE WHEN o_custkey % 50 % 2 = 0 THEN 'Wiltz' ELSE 'Mersch' END AS canton FROM orders""")
def defaults(t):
    rows = t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("source_id"))
    return ops.with_source_defaults(rows, sources(t)).select("id", F.col("canton_default").alias("canton"))


def candidates(t):
    """Hint texts as feed candidates, some of them section pages, some explicit."""
    h = t.hint_texts_v
    k = F.col("id")
    title = (F.when(k % 10 == 7, F.lit("Actualités - Gemeng 1")).when(k % 10 == 8, F.lit("Striptease Owend"))
             .otherwise(F.concat(F.lit(" Fest "), k.cast("string"), F.lit("  | Commune de Leudelange"))))
    return h.select((k % 50).alias("source_id"), F.concat(F.lit("c"), k.cast("string")).alias("external_id"), title.alias("title"),
                    F.when(k % 10 == 9, F.lit("[vc_row] [/vc_row]")).otherwise(F.col("text")).alias("description"),
                    F.lit(TODAY).cast("date").alias("start_date"), F.lit(None).cast("date").alias("end_date"), F.lit("").alias("time"),
                    F.when(k % 3 == 0, F.lit("")).otherwise(F.lit("Com-small ring")).alias("town"), F.lit(49.6).alias("lat"), F.lit(6.1).alias("lng"), F.lit("").alias("image"))


SEEN = "id % 10 NOT IN (7, 8)"
HAS = "id % 10 <> 9"


@check("q13_build_listings", f"""
SELECT 'c' || id AS external_id, 'Fest ' || id AS title, CASE WHEN {HAS} THEN substr(text, 1, 120) ELSE 'Fest ' || id END AS short,
  CASE WHEN {HAS} AND id % 6 = 0 THEN p_size % 17 WHEN {HAS} AND id % 6 = 1 THEN p_size % 9 ELSE 0 END AS age_min,
  CASE WHEN {HAS} AND id % 6 = 0 THEN 99 WHEN {HAS} AND id % 6 = 1 THEN p_size % 9 + 4 WHEN id % 50 % 4 = 0 THEN 12 ELSE 99 END AS age_max,
  CASE WHEN {HAS} AND id % 6 <= 1 THEN 'event' ELSE 'source' END AS age_source,
  CASE WHEN {HAS} AND id % 6 = 3 THEN 0.0 WHEN {HAS} AND id % 6 = 4 THEN p_size + 0.5 END::DOUBLE AS price_adult,
  CASE WHEN {HAS} AND id % 6 = 3 THEN 'Free entry' WHEN {HAS} AND id % 6 = 4 THEN p_size || '.50 €' ELSE 'Price not stated' END AS price_label,
  CASE WHEN id % 2 = 1 THEN 'Animals' ELSE 'Festivals' END AS category,
  CASE WHEN id % 3 <> 0 THEN 'small ring' WHEN id % 50 % 3 = 0 THEN 'Town ' || (id % 50) ELSE 'Luxembourg' END AS town,
  CASE WHEN id % 2 = 0 THEN 'Wiltz' ELSE 'Mersch' END AS canton FROM hint_texts_v WHERE {SEEN}""")
def build(t):
    made, _ = build_listings(candidates(t), sources(t), t.communes, now())
    return made.select("external_id", F.col("title.de").alias("title"), F.col("short.fr").alias("short"), "age_min", "age_max", "age_source", "price_adult",
                       F.col("price_label.en").alias("price_label"), F.array_join("category", "|").alias("category"), "town", "canton")


@check("q13_refused", f"""
SELECT 'c' || id AS external_id, CASE WHEN id % 10 = 7 THEN 'not an event' ELSE 'explicit' END AS reason FROM hint_texts_v WHERE NOT ({SEEN})""")
def refused(t):
    return build_listings(candidates(t), sources(t), t.communes, now())[1].select("external_id", "reason")


def curated_pages(t):
    """Detail pages whose title names a commune in brackets, or none."""
    k, name = F.col("p_partkey"), F.col("p_name")
    title = (F.when(k % 4 == 0, F.concat(F.lit("Spill (Uelzecht - "), name, F.lit(")"))).when(k % 4 == 1, F.concat(F.lit("Spill ("), name, F.lit(", Zzz)")))
             .when(k % 4 == 2, F.concat(F.lit("Spill ("), name, F.lit("/Xyz)"))).otherwise(F.lit("Spill")))
    html = F.concat(F.lit('<meta property="og:title" content="'), title, F.lit('">'), F.when(
        k % 4 == 0, '<iframe src="https://google.com/maps/embed?q=49.8,6.1">').otherwise(""))
    return t.part.select(k.alias("page_id"), F.concat(F.lit("https://x.lu/p/"), k.cast("string"), F.lit("/")).alias("url"), html.alias("html"))


@check("f40_curated_detail", """
SELECT p_partkey AS id, CASE WHEN p_partkey % 4 < 3 THEN p_name ELSE '' END AS commune, CASE WHEN p_partkey % 4 < 3 THEN canton ELSE '' END AS canton,
  CASE p_partkey % 4 WHEN 0 THEN 'address' WHEN 3 THEN 'fallback' ELSE 'commune' END AS precision,
  CASE p_partkey % 4 WHEN 0 THEN 49.8 WHEN 3 THEN 49.8153 ELSE lat END::DOUBLE AS lat, 'Spill' AS title FROM part JOIN communes_v ON p_name = name""")
def detail(t):
    from ...sources.curated import curated_details

    return curated_details(curated_pages(t), t.communes).select(F.col("page_id").alias("id"), "commune", "canton", "precision", "lat", "title")


KINDS = ["data_public_lu", "ical", "json_ld", "html_scraper", "sitemap", "kids_in_lux"]
CARDS = {"item": ".event-card", "title": "h3", "date": ".date", "date_attr": "datetime", "location": ".venue", "link": "a"}


def all_sources(t):
    """The fifty feeds once for each kind, a hundred numbers apart."""
    kind = F.posexplode(F.array(*map(F.lit, KINDS))).alias("_n", "kind")
    every = sources(t).select("*", kind).withColumn("source_id", F.col("source_id") + F.col("_n") * 100).drop("_n")
    return every.withColumn("selectors", F.when(F.col("kind") == "html_scraper", F.lit(json.dumps(CARDS))))


def all_payloads(t):
    """What all kinds have stored; every seventh sitemap page has Event nodes, the others have OpenGraph only."""
    def of(kind, rows, body, url=F.lit(None).cast("string")):
        n = KINDS.index(kind)
        number = F.col("page_id") if "page_id" in rows.columns else F.monotonically_increasing_id()
        source = F.col("source_id") if "source_id" in rows.columns else F.lit(n).cast("bigint")
        return rows.select(F.concat(F.lit(f"{kind}:"), number.cast("string")).alias("payload_id"), (source + 100 * n).alias("source_id"), url.alias("url"), body.alias("payload"))

    page, url = F.col("html"), F.col("url")
    parts = [of("data_public_lu", json_payloads(t), F.col("payload")), of("ical", calendars(t), F.col("payload")), of("json_ld", ld_pages(t), page, url),
             of("html_scraper", card_pages(t), page, url), of("sitemap", ld_pages(t).filter("page_id % 7 = 0"), page, url),
             of("sitemap", og_pages(t).filter("page_id % 7 <> 0"), page, url), of("kids_in_lux", curated_pages(t), page, url)]
    return reduce(lambda a, b: a.unionByName(b), parts)


_OF = lambda kind, name, external="external_id", day="start_date", where="true": (
    f"SELECT '{kind}' AS kind, {external} AS external_id, title, {day} AS start_date FROM ({CHECKS[name].sql}) WHERE {where}")
# a made id begins with the number of its source, which here is one of the fourth kind
NUMBERED = "CASE WHEN external_id LIKE '/e/%' THEN external_id ELSE CAST(split_part(external_id, ':', 1) AS INT) + 300 || substr(external_id, strpos(external_id, ':')) END"
UNION = " UNION ALL ".join([
    _OF("data_public_lu", "s02_open_data_json"), _OF("ical", "s03_ical"), _OF("json_ld", "s04_json_ld"), _OF("html_scraper", "s06_listing_blocks", external=NUMBERED),
    _OF("sitemap", "s04_json_ld", where="CAST(regexp_extract(external_id, '[0-9]+$') AS BIGINT) % 7 = 0"), _OF("sitemap", "s05_open_graph", where="page_id % 7 <> 0"),
    _OF("kids_in_lux", "f40_curated_detail", external="'kids-in-lux:' || id", day=f"'{TODAY}'")])


@check("u01_union_feeds", UNION)
def union(t):
    """All stored payloads, each read by the kind of its source."""
    rows = kinds.read_all(all_payloads(t), all_sources(t), TODAY, t.communes)
    return rows.select("kind", "external_id", "title", iso(F.col("start_date")).alias("start_date"))


@check("s20_refresh_curated", f"""
SELECT 'kids-in-lux:' || id AS external_id, CASE WHEN id % 2 = 0 THEN 'stored' ELSE 'new' END AS first_seen, 'Spill' AS title, CASE WHEN commune <> '' THEN commune ELSE canton END AS town,
  true AS written FROM ({CHECKS["f40_curated_detail"].sql})
UNION ALL SELECT 'kids-in-lux:gone', 'stored', 'Old', 'Old', NULL""")
def refreshed(t):
    """Half of the curated pages are known with an older text; what is read again keeps its first day, what is gone stays."""
    rows = kinds.curated_reader("kids-in-lux", t.communes)(
        curated_pages(t).select(F.col("page_id").alias("payload_id"), F.lit(1).alias("source_id"), "url", F.col("html").alias("payload")), sources(t), TODAY)
    built = rows.select("external_id", F.concat(F.lit("n"), "external_id").alias("id"), "title", "town", "start_date", F.lit("new").alias("created_at"))
    gone = built.sparkSession.range(1).select(F.lit("kids-in-lux:gone").alias("external_id"))
    known = built.filter(F.regexp_extract("external_id", r"(\d+)$", 1).cast("int") % 2 == 0).select("external_id").unionByName(gone)
    old = known.select("external_id", F.concat(F.lit("o"), "external_id").alias("id"), F.lit("Old").alias("title"), F.lit("Old").alias("town"),
                       F.lit("1990-01-01").cast("date").alias("start_date"), F.lit("stored").alias("created_at"))
    out = kinds.refresh_curated(old, built)
    kept = F.when(F.col("created_at") == "stored", F.col("id").startswith("o")).otherwise(F.col("id").startswith("n"))
    return out.filter(kept).select("external_id", F.col("created_at").alias("first_seen"), "title", "town", F.col("_written").alias("written"))
