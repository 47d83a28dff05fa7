"""Names to places."""

from pyspark.sql import functions as F

from ...functions import text as tx
from ...operators import towns as ops
from .base import check



def key():
    return F.col("p_partkey")
FOLD = "regexp_replace(strip_accents(lower({})), '[^a-z]', '', 'g')".format


def written_towns(t):
    """Towns in many spellings, one per part."""
    name = F.col("p_name")
    town = (F.when(key() % 7 == 0, F.upper(F.regexp_replace(name, "e", "é")))
            .when(key() % 7 == 1, F.concat(name, F.lit("-Stadt"))).when(key() % 7 == 2, F.lit("Lux."))
            .when(key() % 7 == 3, F.lit("Esch")).when(key() % 7 == 4, F.concat(F.lit("com "), name))
            .when(key() % 7 == 5, F.lit("Belval Centre")).otherwise(F.lit(" ")))
    canton = F.when(key() % 2 == 0, F.lit("Wiltz")).otherwise(F.lit("Nowhere"))
    return t.part.select(key().alias("id"), town.alias("town"), canton.alias("canton"), "p_name")


CANONICAL = """CASE p_partkey % 7 WHEN 0 THEN p_name WHEN 1 THEN p_name WHEN 2 THEN 'Luxembourg'
  WHEN 3 THEN CASE WHEN p_partkey % 2 = 0 THEN 'Esch-sur-Sûre' ELSE 'Esch' END WHEN 4 THEN p_name WHEN 5 THEN 'Belval Centre' ELSE '' END"""


@check("j03_canonical_towns", f"SELECT p_partkey AS id, {CANONICAL} AS town FROM part")
def canonical(t):
    return ops.canonical_towns(written_towns(t), t.communes, canton="canton").select("id", F.col("town_canonical").alias("town"))


@check("j03_is_commune", "SELECT p_partkey AS id, p_partkey % 7 IN (0, 4) AS is_commune FROM part")
def commune(t):
    return ops.is_commune(written_towns(t), t.communes, "town").select("id", "is_commune")


SPELLINGS = f"s AS (SELECT name AS display, {FOLD('name')} AS spelling FROM communes_v UNION SELECT name, {FOLD('name_alt')} FROM communes_v)"


def town_texts(t):
    d = t.documents.withColumn("k", F.col("doc_id") % 150)
    return d.join(t.part.select(F.col("p_partkey").alias("k"), "p_name"), "k").select(
        "doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" zu "), F.upper("p_name"), F.lit("!")))
        .when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Com: "), "p_name", F.lit("; "), "text")).otherwise(F.col("text")).alias("text"))


@check("j04_towns_in_text", f"""
WITH {SPELLINGS}, d AS (SELECT doc_id, {FOLD('''CASE doc_id % 3 WHEN 0 THEN text || ' zu ' || upper(p_name) || '!'
    WHEN 1 THEN 'Com: ' || p_name || '; ' || text ELSE text END''')} AS folded FROM documents JOIN part ON p_partkey = doc_id % 150)
SELECT doc_id, display AS town FROM d JOIN s ON length(spelling) >= 5 AND contains(folded, spelling)
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(spelling) DESC, display) = 1""")
def in_text(t):
    return ops.towns_in_text(town_texts(t), t.communes, "doc_id", "text")


CANDIDATE = """CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' an der Mess' WHEN 2 THEN string_split(p_name, ' ')[2] ELSE 'Xyz' END"""


@check("j05_match_commune", f"""
WITH {SPELLINGS}, c AS (SELECT p_partkey AS id, {FOLD(CANDIDATE)} AS target FROM part),
e AS (SELECT DISTINCT target, min(display) OVER (PARTITION BY target) AS display FROM c JOIN s ON spelling = target),
p AS (SELECT target, min(display) AS display FROM (SELECT DISTINCT target, display FROM (SELECT DISTINCT target FROM c)
    JOIN s ON contains(target, spelling) OR contains(spelling, target)) GROUP BY target HAVING count(*) = 1)
SELECT id, coalesce(e.display, p.display) AS commune FROM c LEFT JOIN e USING (target) LEFT JOIN p USING (target)""")
def match(t):
    name = (F.when(key() % 4 == 0, F.col("p_name")).when(key() % 4 == 1, F.concat("p_name", F.lit(" an der Mess")))
            .when(key() % 4 == 2, F.element_at(F.split("p_name", " "), 2)).otherwise(F.lit("Xyz")))
    return ops.match_commune(t.part.select(key().alias("id"), name.alias("name")), t.communes).select("id", "commune")


PLACE_ROWS = "pl AS (SELECT osm_id, tag_name AS name, 'c' || CAST(osm_id % 3 AS VARCHAR) AS commune, lat, lng FROM places_v WHERE lat IS NOT NULL AND tag_name IS NOT NULL)"


def place_rows(t):
    return t.places_v.filter("tag_name IS NOT NULL").select(
        F.col("osm_id").alias("id"), F.col("tag_name").alias("name"),
        F.concat(F.lit("c"), (F.col("osm_id") % 3).cast("string")).alias("commune"), "lat", "lng")


VENUES = "v AS (SELECT p_partkey AS key, CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN string_split(p_name, ' ')[1] ELSE p_name || 'x' END AS venue, 'c' || CAST(p_size % 4 AS VARCHAR) AS commune FROM part)"


@check("j09_local_places", f"""
WITH {PLACE_ROWS}, {VENUES} SELECT v.key, pl.name AS place_name, pl.lat, pl.lng FROM v JOIN pl ON length(venue) >= 4 AND starts_with(lower(pl.name), lower(venue))
QUALIFY row_number() OVER (PARTITION BY key ORDER BY CASE WHEN pl.commune = v.commune THEN 0 ELSE 1 END, osm_id) = 1""")
def local(t):
    venue = (F.when(key() % 3 == 0, F.upper("p_name")).when(key() % 3 == 1, F.element_at(F.split("p_name", " "), 1))
             .otherwise(F.concat("p_name", F.lit("x"))))
    venues = t.part.select(key().alias("key"), venue.alias("venue"), F.concat(F.lit("c"), (F.col("p_size") % 4).cast("string")).alias("town"))
    return ops.local_places(venues, place_rows(t), "key", "venue", "town")


@check("j15_canton_of", """
SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN canton WHEN p_partkey % 4 = 1 THEN 'Wiltz' WHEN p_partkey % 4 = 2 THEN 'Echternach' ELSE 'Luxembourg' END AS canton
FROM part JOIN communes_v ON p_name = name""")
def canton(t):
    rows = t.part.select(
        key().alias("id"), F.when(key() % 4 == 0, F.concat(F.upper("p_name"), F.lit(" (x)"))).otherwise(F.lit("?")).alias("commune"),
        F.when(key() % 4 == 1, F.lit("Éislek")).alias("region"),
        F.when(key() % 4 == 2, F.lit("Visit Mullerthal — Agenda")).otherwise(F.lit("Agenda")).alias("source"))
    return ops.canton_of(rows, t.communes, "commune", "region", "source").select("id", "canton")


def to_locate(t):
    """Listings whose position comes from each source in turn."""
    name = F.col("p_name")
    title = F.when(key() % 7 == 0, F.concat(name, F.lit(" — fir Kanner"))).otherwise(F.lit("Zzyx"))
    town = (F.when(key() % 7 == 1, name).when(key() % 7 == 2, F.lit("Kirchberg (Quartier Aal)")).when(key() % 7 == 3, F.lit("Quartier Nei"))
            .when(key() % 7 == 4, F.concat(F.lit("Com-"), name)).otherwise(F.lit("Nowhere")))
    canton = F.when(key() % 7 == 3, F.lit("Mersch")).when(key() % 7 == 5, F.lit("Wiltz")).otherwise(F.lit("?"))
    return t.part.select(key().alias("id"), tx.localized(title).alias("title"), town.alias("town"), canton.alias("canton"))


def addresses(t):
    """Answers of an address service, derived from nations: one good, one narrowed, one guess to refuse."""
    k = F.col("n_nationkey")
    query = F.when(k % 3 == 0, "Quartier Aal").when(k % 3 == 1, "Quartier Nei, Mersch").otherwise("Nowhere")
    answer = F.when(k % 3 == 2, F.lit("hierheck")).otherwise(F.concat(F.lit("Rue Quartier "), k.cast("string")))
    return t.nation.select(query.alias("query"), answer.alias("address"), F.when(k % 3 == 2, 3).otherwise(k % 9).alias("accuracy"),
                           (F.lit(49.5) + k.cast("double") / 100).alias("lat"), (F.lit(6.0) + k.cast("double") / 100).alias("lng"))


@check("j18_resolve_locations", f"""
WITH {PLACE_ROWS}, a AS (SELECT CASE n_nationkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 END AS k, n_nationkey % 9 AS acc, 'Rue Quartier ' || n_nationkey AS address,
    49.5 + n_nationkey::DOUBLE / 100 AS lat, 6.0 + n_nationkey::DOUBLE / 100 AS lng FROM nation WHERE n_nationkey % 3 < 2
  QUALIFY row_number() OVER (PARTITION BY n_nationkey % 3 ORDER BY acc DESC, address) = 1),
m AS (SELECT p_partkey AS id, p_partkey % 7 AS k, (SELECT min_by({{'lat': pl.lat, 'lng': pl.lng}}, pl.osm_id) FROM pl WHERE starts_with(lower(pl.name), lower(p_name))) AS place,
    c.lat AS clat, c.lng AS clng FROM part JOIN communes_v c ON p_name = c.name)
SELECT id, CASE WHEN k IN (0, 1) AND place IS NOT NULL THEN place.lat WHEN k IN (2, 3) THEN a.lat WHEN k = 4 THEN clat WHEN k = 5 THEN 49.9663 ELSE 49.61 END::DOUBLE AS lat,
  CASE WHEN k IN (0, 1) AND place IS NOT NULL THEN place.lng WHEN k IN (2, 3) THEN a.lng WHEN k = 4 THEN clng WHEN k = 5 THEN 5.9333 ELSE 6.13 END::DOUBLE AS lng,
  CASE WHEN k IN (0, 1) AND place IS NOT NULL THEN 'address' WHEN k IN (2, 3) THEN CASE WHEN acc >= 8 THEN 'address' WHEN acc >= 6 THEN 'street' ELSE 'locality' END
    WHEN k = 4 THEN 'commune' ELSE 'canton' END AS geocode_precision,
  CASE WHEN k IN (0, 1) AND place IS NOT NULL OR k = 4 THEN 'places' WHEN k IN (2, 3) THEN 'addresses' ELSE 'fallback' END AS geocode_source
FROM m LEFT JOIN a USING (k)""")
def resolve(t):
    centres = t.communes_v.select(F.concat(F.lit("Com-"), "name").alias("commune"), "lat", "lng")
    return ops.resolve_locations(to_locate(t), place_rows(t), addresses(t), t.communes, centres).select(
        "id", "lat", "lng", "geocode_precision", "geocode_source")


@check("f37_address_queries", """
SELECT p_partkey AS id, CASE p_partkey % 7 WHEN 1 THEN p_name WHEN 2 THEN 'Quartier Aal' WHEN 3 THEN 'Quartier Nei' WHEN 4 THEN 'Com-' || p_name ELSE 'Nowhere' END AS query,
  CASE p_partkey % 7 WHEN 1 THEN '' WHEN 2 THEN 'Quartier Aal, ?' WHEN 3 THEN 'Quartier Nei, Mersch' WHEN 4 THEN '' WHEN 5 THEN 'Nowhere, Wiltz' ELSE 'Nowhere, ?' END AS narrowed FROM part""")
def queries(t):
    return ops.address_queries(to_locate(t), t.communes).select("id", "query", "narrowed")


@check("j19_match_index", """
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://a.lu/spill' WHEN 1 THEN 'https://a.lu/spill/nei/' END AS index_url,
  CASE WHEN page_id % 3 = 2 THEN 'matches no known index page' END AS error FROM pages""")
def index(t):
    k = F.col("page_id")
    url = (F.when(k % 3 == 0, F.concat(F.lit("https://a.lu/spill/x"), k.cast("string"), F.lit("/")))
           .when(k % 3 == 1, F.lit("https://a.lu/spill/nei")).otherwise(F.lit("https://a.lu/spillplaz/")))
    # Index pages of the site, found among the pages' own folders.
    known = t.pages.select(F.when(k % 2 == 0, "https://a.lu/spill").otherwise("https://a.lu/spill/nei/").alias("index_url"),
                           (k % 2).alias("position")).distinct()
    return ops.match_index(t.pages.select("page_id", url.alias("url")), known).select("page_id", "index_url", "error")
