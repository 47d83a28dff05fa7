"""Scalar functions over the driver's texts and over texts built from its columns."""

from pyspark.sql import functions as F

from ...functions import dates, geo, hints, opening, tags as tagging, text as tx, urls
from ...functions.dates import iso
from ...operators import towns
from ..views import TODAY
from .base import check



def key():
    return F.col("p_partkey")


@check("f01_normalise_text", r"""
SELECT doc_id, trim(regexp_replace(text || chr(160) || ' ' || chr(8203) || chr(65279), '[\s\x{00a0}\x{200b}\x{feff}]+', ' ', 'g')) AS text
FROM documents""")
def normalise(t):
    padded = F.concat("text", F.lit("  ​﻿"))
    return t.documents.select("doc_id", tx.normalise_text(padded).alias("text"))


@check("f02_strip_page_builder", r"""
SELECT doc_id, trim(regexp_replace(regexp_replace('[et_pb_section fb_built="1"] ' || text || ' [/vc_row] [FR]',
  '(?i)\[/?(et_pb_|vc_)[a-z0-9_]*(\s[^\]]*)?\]', ' ', 'g'), '[ \t\n\f\r]{2,}', ' ', 'g'), ' ') AS text FROM documents""")
def builder(t):
    wrapped = F.concat(F.lit('[et_pb_section fb_built="1"] '), "text", F.lit(" [/vc_row] [FR]"))
    return t.documents.select("doc_id", tx.strip_page_builder(wrapped).alias("text"))


@check("f03_site_tail", """
SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name
  WHEN 2 THEN p_name || ' – Handball Käerjeng' ELSE 'Käerjeng' END AS title, 'Käerjeng' AS site FROM part""")
def tails(t):
    site = tx.site_identity(F.lit("Käerjeng (Bascharage) — Sitemap"))
    title = (F.when(key() % 4 == 0, F.concat("p_name", F.lit(" - KÄERJENG")))
             .when(key() % 4 == 1, F.concat("p_name", F.lit(" | Commune de Leudelange")))
             .when(key() % 4 == 2, F.concat("p_name", F.lit(" – Handball Käerjeng"))).otherwise(F.lit(" Käerjeng ")))
    return t.part.select(key().alias("id"), tx.strip_site_tail(title, site).alias("title"), site.alias("site"))


@check("f04_clean_location", "SELECT p_partkey AS id, p_name AS place FROM part")
def location(t):
    labelled = F.when(key() % 2 == 0, F.concat(F.lit("Lieu | "), "p_name", F.lit(" "))).otherwise(F.col("p_name"))
    return t.part.select(key().alias("id"), tx.clean_location(labelled).alias("place"))


@check("f05_unescape_html", """
SELECT page_id, replace(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'),
  '&quot;', '"'), '&#39;', ''''), '&amp;', '&') || ' & – é €' AS title FROM pages""")
def unescape(t):
    title = F.concat(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit(" &#038; &#8211; &eacute; &#x20AC;"))
    return t.pages.select("page_id", tx.unescape_html(title).alias("title"))


@check("f06_fold", """
SELECT doc_id, regexp_replace(strip_accents(lower(text)), '[^a-z]', '', 'g') AS folded FROM documents""")
def fold(t):
    return t.documents.select("doc_id", tx.fold(F.col("text")).alias("folded"))


@check("f07_slugify", """
SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 0 THEN 'poi'
  ELSE replace(lower(p_name), ' ', '-') || '-' || replace(lower(p_brand), '#', '-') || '-ete' END AS slug FROM part""")
def slug(t):
    name = F.when(key() % 10 == 0, F.lit("…!")).otherwise(F.concat(F.lit(" "), "p_name", F.lit(" / "), "p_brand", F.lit(" Été! ")))
    return t.part.select(key().alias("id"), tx.slugify(name).alias("slug"))


@check("f08_pick_language", """
SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'de ' || p_name WHEN 1 THEN 'en ' || p_name ELSE 'fr ' || p_name END AS fr,
  CASE p_partkey % 3 WHEN 0 THEN 'de ' || p_name WHEN 1 THEN 'en ' || p_name ELSE '' END AS lb FROM part""")
def lang(t):
    only = lambda i, name: F.when(key() % 3 == i, F.concat(F.lit(name + " "), "p_name")).otherwise(F.lit("")).alias(name)
    field = F.struct(only(1, "en"), only(0, "de"), only(2, "fr"))
    return t.part.select(key().alias("id"), tx.pick_lang(field, "fr").alias("fr"), tx.pick_lang(tx.with_lb(field), "lb", True).alias("lb"))


@check("f09_short_text", "SELECT doc_id, substr(text, 1, 120) AS short FROM documents")
def short(t):
    return t.documents.select("doc_id", tx.short_text(F.col("text")).alias("short"))


@check("f10_town_suffix", "SELECT CAST(id AS VARCHAR) AS id, canton AS town FROM listings_v")
def suffix(t):
    return t.listings.select("id", tx.strip_town_suffix(F.concat("town", F.lit(" "))).alias("town"))


@check("f11_town_parts", """
SELECT p_partkey AS id, p_name AS commune, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_name || ' / ' || p_brand END AS town,
  CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_name END AS known, p_name AS title FROM part""")
def parts(t):
    raw = F.when(key() % 2 == 0, F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).otherwise(
        F.concat("p_name", F.lit(" / "), "p_brand"))
    title = tx.localized(F.concat("p_name", F.lit(" — "), "p_type"))
    return t.part.select(key().alias("id"), tx.parse_commune(raw).alias("commune"), tx.clean_town(raw).alias("town"),
                         tx.normalize_town(raw, F.lit(True)).alias("known"), tx.clean_title(title).alias("title"))


MONTH_DE = "['Januar','Februar','März','April','Mai','Juni','Juli','August','September','Oktober','November','Dezember']"
MONTH_FR = "['janvier','février','mars','avril','mai','juin','juillet','août','septembre','octobre','novembre','décembre']"
MONTH_LB = "['Januar','Februar','Mäerz','Abrëll','Mee','Juni','Juli','August','September','Oktober','November','Dezember']"


def written_date(d, key):
    """A date in one of eight notations."""
    names = lambda text: F.element_at(F.array(*[F.lit(x.strip("'")) for x in text.strip("[]").split(",")]), F.month(d))
    day, year = F.dayofmonth(d).cast("string"), F.year(d).cast("string")
    return (F.when(key % 8 == 0, F.date_format(d, "yyyy-MM-dd"))
            .when(key % 8 == 1, F.date_format(d, "yyyy-MM-dd'T'19:30:00'Z'"))
            .when(key % 8 == 2, F.date_format(d, "d.M.yyyy"))
            .when(key % 8 == 3, F.concat(F.lit("Samschdeg, "), F.date_format(d, "dd/MM/yyyy"), F.lit(" 20:00")))
            .when(key % 8 == 4, F.concat(day, F.lit(". "), names(MONTH_DE), F.lit(" "), year))
            .when(key % 8 == 5, F.concat(F.lit("le "), day, F.lit(" "), names(MONTH_FR), F.lit(" "), year))
            .when(key % 8 == 6, F.concat(day, F.lit(" "), names(MONTH_LB), F.lit(" "), year))
            .otherwise(F.lit("13:15")))


@check("f12_read_dates", f"""
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 8 <> 7 AND year(o_orderdate) BETWEEN 1997 AND 2003
  THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day FROM orders""")
def read_dates(t):
    text = written_date(F.to_date("o_orderdate"), F.col("o_orderkey"))
    return t.orders.select(F.col("o_orderkey").alias("id"), iso(dates.to_iso_date(text, F.lit(TODAY).cast("date"))).alias("day"))


@check("f13_plausible_year", """
SELECT o_orderkey AS id, year(o_orderdate) + CASE WHEN o_orderkey % 20 = 0 THEN 900 ELSE 0 END BETWEEN 1997 AND 2003 AS ok FROM orders""")
def plausible(t):
    d = F.to_date("o_orderdate")
    shifted = F.when(F.col("o_orderkey") % 20 == 0, F.add_months(d, 10800)).otherwise(d)
    return t.orders.select(F.col("o_orderkey").alias("id"), dates.plausible_year(shifted, F.lit(TODAY).cast("date")).alias("ok"))


@check("f14_date_from_title", """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 <> 2 AND year(o_orderdate) BETWEEN 1997 AND 2003
  THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day FROM orders""")
def title_dates(t):
    d, key = F.to_date("o_orderdate"), F.col("o_orderkey")
    title = (F.when(key % 3 == 0, F.concat(F.lit("Mini monstres | "), F.date_format(d, "dd.MM.yyyy"), F.lit(" 13:15")))
             .when(key % 3 == 1, F.concat(F.lit("Lunchtime – "), F.date_format(d, "d MMM yyyy")))
             .otherwise(F.concat(F.lit("Saison ("), F.date_format(d, "dd/MM/yyyy"), F.lit(" – 15/10/1999)"))))
    return t.orders.select(key.alias("id"), iso(dates.date_from_title(title, F.lit(TODAY).cast("date"))).alias("day"))


@check("f15_date_from_url", """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 4 THEN NULL
  ELSE CAST(CAST(o_orderdate AS DATE) + INTERVAL 25 YEAR AS DATE)::VARCHAR END AS day FROM orders""")
def url_dates(t):
    key = F.col("o_orderkey")
    d = F.add_months(F.to_date("o_orderdate"), 300)
    fr = F.element_at(F.array(*[F.lit(x.strip("'")) for x in MONTH_FR.strip("[]").split(",")]), F.month(d))
    url = (F.when(key % 5 == 0, F.concat(F.lit("https://x.lu/e/"), F.date_format(d, "yyyy-MM-dd"), F.lit("-fest")))
           .when(key % 5 == 1, F.concat(F.lit("https://x.lu/"), F.url_encode(F.concat_ws(
               "-", F.dayofmonth(d).cast("string"), fr, F.year(d).cast("string")))))
           .when(key % 5 == 2, F.concat(F.lit("https://x.lu/concert-"), F.date_format(d, "dd-MM-yyyy")))
           .when(key % 5 == 3, F.concat(F.lit("https://x.lu/fest_"), F.lower(F.date_format(d, "d_MMM_yyyy"))))
           .otherwise(F.lit("https://x.lu/2026-02-31/")))
    url = F.when(key % 5 == 3, F.concat(F.lit("https://x.lu/fest-"), F.lower(F.date_format(d, "d-MMM-yyyy")))).otherwise(url)
    return t.orders.select(key.alias("id"), iso(dates.date_from_url(url)).alias("day"))


@check("f16_time_range", """
SELECT id, CASE WHEN id % 6 = 5 THEN '14:30 - 16:15' ELSE '' END AS time FROM hint_texts_v""")
def times(t):
    return t.hint_texts_v.select("id", dates.time_range(F.col("text")).alias("time"))


@check("f17_curated_age_range", """
SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN p_size WHEN 1 THEN p_size ELSE 0 END AS age_min,
  CASE p_partkey % 3 WHEN 0 THEN p_size + 5 ELSE 99 END AS age_max FROM part""")
def curated_ages(t):
    s = F.col("p_size").cast("string")
    text = (F.when(key() % 3 == 0, F.concat(s, F.lit("-"), (F.col("p_size") + 5).cast("string")))
            .when(key() % 3 == 1, F.concat(s, F.lit("+"))).otherwise(F.lit("alle")))
    return t.part.select(key().alias("id"), hints.parse_age_range(text).alias("a")).select("id", "a.age_min", "a.age_max")


@check("f18_read_age", """
SELECT id, CASE id % 6 WHEN 0 THEN p_size % 17 WHEN 1 THEN p_size % 9 END AS age_min,
  CASE id % 6 WHEN 1 THEN p_size % 9 + 4 END AS age_max, CASE WHEN id % 6 <= 1 THEN 'event' ELSE 'unknown' END AS source
FROM hint_texts_v""")
def ages(t):
    return t.hint_texts_v.select("id", hints.read_age(F.col("text")).alias("a")).select("id", "a.age_min", "a.age_max", "a.source")


@check("f19_read_price", """
SELECT id, CASE WHEN id % 6 = 3 THEN 0.0::DOUBLE WHEN id % 6 = 4 THEN (p_size + 0.5)::DOUBLE END AS adult,
  id % 6 = 3 AS is_free, CASE WHEN id % 6 IN (3, 4) THEN 'event' ELSE 'unknown' END AS source
FROM hint_texts_v""")
def prices(t):
    # A budget far ahead of the amount is out of its context; right before it, it would rule it out.
    text = F.concat(F.lit("Budget 900 € " + "x" * 70), F.col("text"))
    return t.hint_texts_v.select("id", hints.read_price(text).alias("p")).select("id", "p.adult", "p.is_free", "p.source")


@check("f20_labels", """
SELECT id, CASE WHEN id % 6 = 3 THEN 'Free entry' WHEN id % 6 = 4 THEN CAST(p_size AS VARCHAR) || '.50 €' ELSE 'Price not stated' END AS price,
  CASE WHEN id % 6 = 0 THEN CAST(p_size % 17 AS VARCHAR) || '-99' WHEN id % 6 = 1 THEN CAST(p_size % 9 AS VARCHAR) || '-' || CAST(p_size % 9 + 4 AS VARCHAR) ELSE '' END AS age,
  CASE WHEN id % 6 = 0 THEN 'ab ' || CAST(p_size % 17 AS VARCHAR) WHEN id % 6 = 1 THEN CAST(p_size % 9 AS VARCHAR) || '-' || CAST(p_size % 9 + 4 AS VARCHAR) END AS stated
FROM hint_texts_v WHERE NOT (id % 6 = 0 AND p_size % 17 = 0)""")
def labels(t):
    rows = t.hint_texts_v.filter("NOT (id % 6 = 0 AND p_size % 17 = 0)").select(
        "id", hints.read_price(F.col("text")).alias("p"), hints.read_age(F.col("text")).alias("a"))
    low, high = F.coalesce("a.age_min", F.lit(0)), F.coalesce("a.age_max", F.lit(99))
    return rows.select("id", hints.price_label(F.col("p.adult"), F.col("p.is_free")).alias("price"),
                       hints.age_label(low, high, F.col("a.source") == "event").alias("age"),
                       hints.stated_age_label(F.col("a.age_min"), F.col("a.age_max")).alias("stated"))


@check("f21_safety", """
SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'explicit' END AS reason, CASE WHEN doc_id % 7 = 0 THEN 'STRIPTEASE-Show' END IS NOT NULL AS refused
FROM documents""")
def safety(t):
    d = F.col("doc_id")
    text = (F.when(d % 7 == 0, F.concat("text", F.lit(" STRIPTEASE-Show")))
            .when(d % 7 == 1, F.concat("text", F.lit(" Sextett, Comic-Strip a Nacktschnecken zu Essex"))).otherwise(F.col("text")))
    return t.documents.select("doc_id", hints.assess(text).alias("v")).select(
        "doc_id", F.col("v.reason").alias("reason"), F.col("v").isNotNull().alias("refused"))


@check("f22_categorise", """
SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'Playgrounds|Festivals' WHEN 1 THEN 'Animals|Water' WHEN 2 THEN 'Culture'
  WHEN 3 THEN 'Animals|Nature' ELSE 'Nature' END AS category FROM part""")
def categories(t):
    text = (F.when(key() % 5 == 0, F.concat("p_name", F.lit(" Kannerfête um Spillplaz, FESTIVAL am Gaart")))
            .when(key() % 5 == 1, F.concat(F.lit("Déierepark a Piscine: Konzert "), "p_name"))
            .when(key() % 5 == 2, F.concat("p_name", F.lit(" atelier de réparation")))
            .when(key() % 5 == 3, F.lit("Konzert")).otherwise(F.concat(F.lit("geführte Wanderung "), "p_name")))
    default = F.when(key() % 5 == 3, F.array(F.lit("Animals"), F.lit("Nature"))).otherwise(F.array(F.lit("Culture")))
    return t.part.select(key().alias("id"), F.array_join(hints.categorise(text, default), "|").alias("category"))


@check("f23_score_and_age", """
WITH p AS (SELECT osm_id, greatest(0, least(100, 90 + CASE WHEN tag_name IS NOT NULL THEN 5 ELSE 0 END
  + CASE WHEN tag_wheelchair = 'yes' THEN 4 ELSE 0 END + CASE tag_fee WHEN 'no' THEN 3 WHEN 'yes' THEN -3 ELSE 0 END
  + CASE WHEN tag_access IN ('private', 'customers') THEN -40 ELSE 0 END)) AS score, tag_name FROM places_v)
SELECT osm_id, score, 1 AS age_min, 12 AS age_max, coalesce(tag_name, 'Spielplatz') AS name FROM p""")
def scores(t):
    kind = F.lit("playground")
    a = tagging.age_range(F.col("tags"), kind)
    return t.elements.select("osm_id", tagging.family_score(F.col("tags"), kind).alias("score"),
                             a["age_min"].alias("age_min"), a["age_max"].alias("age_max"),
                             tagging.pick_name(F.col("tags"), tagging.label_of(kind)).alias("name"))


@check("f24_haversine", """
SELECT CAST(id AS VARCHAR) AS id, round(6371.0 * acos(least(1.0, sin(radians(49.75)) * sin(radians(lat))
  + cos(radians(49.75)) * cos(radians(lat)) * cos(radians(lng - 6.10)))), 4) AS km
FROM listings_v WHERE lat IS NOT NULL AND lat <> 0""")
def haversine(t):
    d = geo.haversine_km(F.lit(49.75), F.lit(6.10), F.col("lat"), F.col("lng"))
    return t.listings.filter("lat IS NOT NULL AND lat <> 0").select("id", F.round(d, 4).alias("km"))


SEGMENTS = """v AS (SELECT route_id, lat, lng, lead(lat) OVER w AS lat2, lead(lng) OVER w AS lng2, count(*) OVER (PARTITION BY route_id) AS n
  FROM routes_v WINDOW w AS (PARTITION BY route_id ORDER BY seq, l_partkey, l_suppkey, lat, lng)),
s AS (SELECT route_id, n, lat, lng, lat2, 111.0 * cos(radians((lat + lat2) / 2)) AS kx, (6.10 - lng) AS dx, (49.75 - lat) AS dy,
  lng2 - lng AS bx0, lat2 - lat AS by0 FROM v),
k AS (SELECT *, dx * kx AS px, dy * 111.0 AS py, bx0 * kx AS bx, by0 * 111.0 AS b_y FROM s),
d AS (SELECT *, CASE WHEN bx * bx + b_y * b_y = 0 THEN 0 ELSE greatest(0.0, least(1.0, (px * bx + py * b_y) / nullif(bx * bx + b_y * b_y, 0))) END AS u FROM k)"""


@check("f25_distance_to_path", f"""
WITH {SEGMENTS} SELECT route_id, round(min(CASE WHEN n = 1 THEN 12742.0 * asin(sqrt(pow(sin(radians(lat - 49.75) / 2), 2)
    + pow(sin(radians(lng - 6.10) / 2), 2) * cos(radians(49.75)) * cos(radians(lat))))
  ELSE sqrt(pow(px - u * bx, 2) + pow(py - u * b_y, 2)) END), 6) AS km FROM d GROUP BY route_id""")
def to_path(t):
    d = geo.distance_to_path_km(F.lit(49.75), F.lit(6.10), F.col("path_parts"))
    return t.routes.select("route_id", F.round(d, 6).alias("km"))


@check("f26_valid_point", "SELECT CAST(id AS VARCHAR) AS id, lat IS NOT NULL AND lat <> 0 AS located FROM listings_v")
def valid(t):
    return t.listings.select("id", geo.valid_point(F.col("lat"), F.col("lng")).alias("located"))


HOURS = ["Mo-Fr 09:00-12:00,14:00-18:00; Sa 10:00-16:00", "24/7", "Mo-Su 10:00-18:00; Su off", "Fr-Mo 22:00-02:00",
         "PH off; Mo 09:00-10:00", "09:00-18:00", "sunrise-sunset", "by appointment"]
# Monday 0; minute of the day as m.
HOURS_SQL = """CASE k WHEN 0 THEN CASE WHEN wd <= 4 AND (m BETWEEN 540 AND 719 OR m BETWEEN 840 AND 1079) OR wd = 5 AND m BETWEEN 600 AND 959 THEN 'open' ELSE 'closed' END
  WHEN 1 THEN 'open' WHEN 2 THEN CASE WHEN wd < 6 AND m BETWEEN 600 AND 1079 THEN 'open' ELSE 'closed' END
  WHEN 3 THEN CASE WHEN wd IN (4, 5, 6, 0) AND (m >= 1320 OR m < 120) THEN 'open' ELSE 'closed' END
  WHEN 5 THEN CASE WHEN m BETWEEN 540 AND 1079 THEN 'open' ELSE 'closed' END ELSE 'unknown' END"""


def hours(t):
    value = F.element_at(F.array(*[F.lit(h) for h in HOURS]), (F.col("event_id") % 8 + 1).cast("int"))
    return t.events.select("event_id", value.alias("value"), "ts")


@check("f28_open_state", f"""
SELECT event_id, {HOURS_SQL} AS state FROM (SELECT event_id, event_id % 8 AS k, isodow(ts) - 1 AS wd, hour(ts) * 60 + minute(ts) AS m FROM events)""")
def open_state(t):
    return hours(t).select("event_id", opening.is_open_at(F.col("value"), F.col("ts")).alias("state"))


@check("f43_open_label", f"""
SELECT event_id, CASE {HOURS_SQL} WHEN 'open' THEN 'Elo op' WHEN 'closed' THEN 'Zou' END AS label
FROM (SELECT event_id, event_id % 8 AS k, isodow(ts) - 1 AS wd, hour(ts) * 60 + minute(ts) AS m FROM events)""")
def open_label(t):
    return hours(t).select("event_id", opening.open_label(F.col("value"), "lb", F.col("ts")).alias("label"))


@check("f31_client_hash", """
SELECT event_id, substr(sha256('salt:' || CAST(user_id AS VARCHAR)), 1, 16) AS client FROM events""")
def client(t):
    return t.events.select("event_id", tx.hash_client(F.col("user_id"), "salt").alias("client"))


@check("f31_int_hash", """
SELECT p_partkey AS id, abs(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(p_name, ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda a, b: ((a * 31 + b + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)) AS hash FROM part""")
def int_hash(t):
    return t.part.select(key().alias("id"), tx.int32_hash(F.col("p_name")).alias("hash"))


@check("f32_map_embed", """
SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 49.5 + CAST(p_size AS DOUBLE) / 100 WHEN 1 THEN 49.6::DOUBLE END AS lat,
  CASE WHEN p_partkey % 3 < 2 THEN 6.125::DOUBLE END AS lng FROM part""")
def embed(t):
    q = F.when(key() % 3 == 0, F.concat((49.5 + F.col("p_size") / 100).cast("string"), F.lit("%2C6.125"))).otherwise(F.lit("10.5%2C6.1"))
    centre = F.when(key() % 3 == 1, F.lit("49.6%2C6.125")).otherwise(F.lit("1.5%2C1.5"))
    html = F.concat(F.lit('<iframe src="https://www.google.com/maps/embed/v1/place?key=k&amp;q='), q,
                    F.lit("&amp;center="), centre, F.lit('"></iframe>'))
    return t.part.select(key().alias("id"), urls.map_embed_point(html, geo.COUNTRY_BOX).alias("p")).select("id", "p.lat", "p.lng")


@check("f33_absolute_url", """
SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/x' AS rooted, 'https://cdn.lu/y' AS relative, 'z' AS plain FROM pages""")
def absolute(t):
    u = F.col("url")
    return t.pages.select("page_id", urls.abs_url(u, F.lit("/x")).alias("rooted"),
                          urls.abs_url(u, F.lit("//cdn.lu/y")).alias("relative"), urls.abs_url(u, F.lit("z")).alias("plain"))


@check("f34_domain", r"""
SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '^www\.', '') AS domain FROM pages""")
def domain(t):
    return t.pages.select("page_id", urls.domain(F.col("url")).alias("domain"))


@check("f35_events_section", """
SELECT page_id, 'https://' || regexp_extract(url, '^https?://([^/?#]+)', 1) || CASE page_id % 3 WHEN 0 THEN '/actualites/agenda/'
  WHEN 1 THEN '/événements/' ELSE '/events/' END AS section FROM pages""")
def section(t):
    key = F.col("page_id")
    tail = (F.when(key % 3 == 0, "/actualites/agenda/agenda-2026/").when(key % 3 == 1, "/événements/fest")
            .otherwise("/kultur/fest"))
    example = F.concat(F.regexp_extract("url", "^(https?://[^/?#]+)", 1), tail)
    return t.pages.select("page_id", urls.events_section_url(F.col("url"), example).alias("section"))


@check("f36_canton_prefix", """
SELECT n_nationkey AS id, CASE n_nationkey % 3 WHEN 0 THEN n_name WHEN 1 THEN 'vun ' || n_name ELSE n_name END AS canton FROM nation""")
def prefix(t):
    k = F.col("n_nationkey")
    raw = (F.when(k % 3 == 0, F.concat(F.lit("Canton "), "n_name")).when(k % 3 == 1, F.concat(F.lit("Kanton vun "), "n_name"))
           .otherwise(F.concat(F.lit(" "), "n_name")))
    return t.nation.select(k.alias("id"), tx.strip_canton_prefix(raw).alias("canton"))


@check("f37_precision_ladder", """
SELECT p_partkey AS id, CASE WHEN p_size % 10 >= 8 THEN 'address' WHEN p_size % 10 >= 6 THEN 'street' ELSE 'locality' END AS precision FROM part""")
def precision(t):
    return t.part.select(key().alias("id"), towns.precision_of(F.col("p_size") % 10).alias("precision"))


@check("f39_tag_filters", """
SELECT osm_id, coalesce(tag_leisure = 'garden', false) AND NOT coalesce(tag_access IN ('private', 'no', 'customers'), false) AS garden,
  tag_name IS NOT NULL AND coalesce(tag_fee, '') <> 'yes' AS named_free, coalesce(contains(tag_leisure, 'pool'), false) AS pool, false AS unreadable
FROM places_v""")
def tag_filters(t):
    p = lambda fragment: tagging.filter_predicate(fragment, F.col("tags"))
    return t.elements.select(
        "osm_id", p('["leisure"="garden"]["access"!~"^(private|no|customers)$"]').alias("garden"),
        p('["name"]["fee"!="yes"]').alias("named_free"), p('["leisure"~"pool"]').alias("pool"),
        p('["leisure"="park"](newer:"x")').alias("unreadable"))


@check("f42_booking_total", """
SELECT CAST(id AS VARCHAR) AS id, 2 * price_adult + 3 * CASE WHEN price_adult = 0 THEN 0 END AS total FROM listings_v""")
def booking(t):
    return t.listings.select("id", hints.booking_total(F.lit(2), F.lit(3), F.col("price_adult"), F.col("price_child")).alias("total"))
