"""Tables in and out."""

from pyspark.sql import functions as F

from ...functions.dates import iso
from ...session import fresh_path
from ...sources import sinks as ops, tables
from ..views import TODAY
from .base import check
from .feeds import now, sources
from .filters import SCORED, scored_places

HALF = "id % 2 = 0"


@check("s01_read_listings", """
SELECT CAST(id AS VARCHAR) AS id, title_en, coalesce(age_min, 0) AS age_min, coalesce(age_max, 99) AS age_max, price_adult, '' AS time,
  4.5::DOUBLE AS rating, true AS food_allowed, 0 AS payments, CAST(start_date AS VARCHAR) AS start_date FROM listings_v""")
def read(t):
    path = fresh_path(t.spark, "listings")
    ops.write_snapshot(t.listings.drop("time", "rating", "key"), path)
    rows = tables.read_listings(t.spark, path)
    return rows.select("id", F.col("title.en").alias("title_en"), "age_min", "age_max", "price_adult", "time", "rating", "food_allowed",
                       F.size("payment_methods").alias("payments"), iso(F.col("start_date")).alias("start_date"))


@check("s01_read_listings_json", """
SELECT CAST(id AS VARCHAR) AS id, coalesce(age_min, 0) AS age_min, featured FROM listings_v""")
def read_json(t):
    path = fresh_path(t.spark, "listings")
    t.listings.drop("key").write.json(path)
    return tables.read_listings(t.spark, path, "json").select("id", "age_min", "featured")


@check("s01_listings_layout", f"""
SELECT CAST(id AS VARCHAR) AS id FROM listings_v WHERE start_date BETWEEN DATE '{TODAY}' AND DATE '{TODAY}' + 30""")
def layout(t):
    path = fresh_path(t.spark, "listings")
    ops.write_listings(t.listings.drop("key"), path)
    rows = t.spark.read.parquet(path)
    start, end = F.lit(TODAY).cast("date"), F.date_add(F.lit(TODAY).cast("date"), 30)
    months = F.col("month").cast("string").between(F.date_format(start, "yyyy-MM"), F.date_format(end, "yyyy-MM"))
    return rows.filter(months & F.col("start_date").between(start, end)).select("id")


@check("s13_read_elements", "SELECT osm_id, tag_leisure AS leisure FROM places_v")
def elements(t):
    path = fresh_path(t.spark, "elements")
    ops.write_snapshot(t.elements, path)
    return tables.read_osm_elements(t.spark, path).select("osm_id", F.try_element_at("tags", F.lit("leisure")).alias("leisure"))


@check("s14_candidates_csv", """
SELECT p_name AS name, 'https://www.' || p_partkey || '.lu/' AS website FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 2 = 0""")
def candidates(t):
    k = F.col("p_partkey")
    text = lambda c: c.cast("string")
    rows = t.part.select(
        F.when(k % 3 == 0, "KANDIDAT").otherwise("NICHTS GEFUNDEN").alias("﻿Status"), F.col("p_name").alias("Gemeinde"),
        F.concat(F.lit("https://www."), text(k), F.lit(".lu/")).alias("Website"), F.lit("erlaubt").alias("robots"), F.lit("").alias("Crawl-Delay"),
        F.lit("").alias("Sitemap"), text(F.col("p_size")).alias("Veranstaltungsseiten"), F.lit('a "b", c').alias("Beispiel-URL"),
        F.when(k % 2 == 0, "ja").otherwise("nein").alias("JSON-LD"), F.lit("").alias("Hinweis"))
    path = fresh_path(t.spark, "candidates")
    rows.write.csv(path, header=True)
    good = tables.accepted(tables.read_candidates(t.spark, path))
    return good.select(F.col("Gemeinde").alias("name"), F.col("Website").alias("website"))


@check("j01_new_rows", """
SELECT CAST(id AS VARCHAR) AS id FROM listings_v a WHERE id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM listings_v b
  WHERE b.id % 2 = 0 AND a.source_id = b.source_id AND a.external_id = b.external_id)""")
def new_rows(t):
    rows = t.listings
    return ops.new_rows(rows.filter("key % 2 = 1"), rows.filter("key % 2 = 0"), ["source_id", "external_id"]).select("id")


@check("s15_insert_new", """
WITH f AS (SELECT * FROM listings_v QUALIFY id % 2 = 0 OR row_number() OVER (PARTITION BY source_id, external_id, id % 2 ORDER BY id) = 1)
SELECT CAST(id AS VARCHAR) AS id FROM f a WHERE id % 2 = 0 OR NOT EXISTS (SELECT 1 FROM listings_v b
  WHERE b.id % 2 = 0 AND a.source_id = b.source_id AND a.external_id = b.external_id)""")
def insert(t):
    rows = t.listings
    return ops.insert_new(rows.filter("key % 2 = 0"), rows.filter("key % 2 = 1"), ["source_id", "external_id"], ["key"]).select("id")


@check("s16_upsert", f"""
WITH {SCORED} SELECT id, CASE WHEN osm_id % 4 = 3 THEN family_score + 1 ELSE family_score END AS family_score,
  CASE WHEN osm_id % 4 <= 1 THEN 'old' WHEN osm_id % 4 = 3 AND osm_id % 8 = 3 THEN 'old' ELSE 'new' END AS created_at,
  CASE WHEN osm_id % 4 = 0 THEN NULL WHEN osm_id % 4 = 1 THEN false ELSE true END AS written FROM scored""")
def upsert(t):
    rows = scored_places(t).select("id", "osm_id", "family_score", F.lit("old").alias("created_at"))
    k = F.col("osm_id")
    target = rows.filter((k % 4 <= 1) | (k % 8 == 3))
    batch = rows.filter(k % 4 != 0).withColumns({"created_at": F.lit("new"), "family_score": F.col("family_score") + F.when(k % 4 == 3, 1).otherwise(0)})
    return ops.upsert(target, batch, "id", order=["id"]).select("id", "family_score", "created_at", F.col("_written").alias("written"))


@check("s17_apply_patches", f"""
SELECT CAST(id AS VARCHAR) AS id, CASE WHEN id % 3 = 0 AND id % 2 = 0 THEN 'Patched' ELSE town END AS town,
  CASE WHEN id % 3 = 0 THEN NULL ELSE CAST(end_date AS VARCHAR) END AS end_date, view_count, id % 3 = 0 AS updated FROM listings_v""")
def patch(t):
    k = F.col("key")
    p = t.listings.filter(k % 3 == 0).select(
        "id", F.array(F.lit("town"), F.lit("end_date")).alias("sent"), F.when(k % 2 == 0, "Patched").alias("town"),
        F.lit(None).cast("date").alias("end_date"), F.lit(-1).cast("bigint").alias("view_count"), F.lit(1).alias("at"))
    rows = t.listings.withColumn("updated_at", F.lit(None).cast("timestamp"))
    out = ops.apply_patches(rows, p, now(), "at")
    return out.select("id", "town", iso(F.col("end_date")).alias("end_date"), "view_count", F.col("updated_at").isNotNull().alias("updated"))


@check("s17_folded_patches", f"""
SELECT CAST(id AS VARCHAR) AS id, CASE WHEN id % 3 = 0 THEN CASE WHEN id % 2 = 0 THEN 'Second' ELSE 'First' END ELSE town END AS town,
  CASE WHEN id % 3 = 0 THEN CASE WHEN id % 4 = 0 THEN NULL ELSE '2030-01-01' END ELSE CAST(end_date AS VARCHAR) END AS end_date FROM listings_v""")
def folded(t):
    """Three patches of a listing, out of order: the last town that is none clears nothing, the last end day may be cleared."""
    k = F.col("key")
    day = lambda d: F.lit(d).cast("date")
    patch = lambda at, sent, town, end: F.struct(F.lit(at).alias("at"), sent.alias("sent"), town.alias("town"), end.alias("end_date"))
    both, one = F.array(F.lit("town"), F.lit("end_date")), F.array(F.lit("town"))
    patches = F.array(patch(3, F.when(k % 4 == 0, both).otherwise(one), F.when(k % 2 == 0, "Second"), day(None)),
                      patch(1, both, F.lit("Zero"), day("2031-01-01")), patch(2, both, F.lit("First"), day("2030-01-01")))
    p = t.listings.filter(k % 3 == 0).select("id", F.inline(patches))
    out = ops.apply_patches(t.listings.withColumn("updated_at", F.lit(None).cast("timestamp")), p, now(), "at")
    return out.select("id", "town", iso(F.col("end_date")).alias("end_date"))


@check("s18_reconcile", """
SELECT count(*) AS in_source, count(*) FILTER (WHERE id % 10 <> 0) AS in_target, count(*) FILTER (WHERE id % 10 = 0) AS only_source,
  CAST(0 AS BIGINT) AS only_target, false AS same FROM listings_v""")
def reconcile(t):
    return ops.reconcile(t.listings, t.listings.filter("key % 10 <> 0"), ["id"])


@check("s18_copy_table", "SELECT count(*) AS in_source, count(*) AS in_target, true AS same FROM orders")
def copy(t):
    path = fresh_path(t.spark, "copy")
    ops.copy_table(t.orders, path)
    return ops.reconcile(t.orders, t.spark.read.parquet(path), ["o_orderkey"]).select("in_source", "in_target", "same")


@check("s19_register_sources", """
WITH s AS (SELECT name, canton, commune_id FROM communes_v)
SELECT name || ' (Gemeng) — Events' AS name, commune_id % 2 = 0 AND commune_id % 4 = 0 AS active, canton AS canton_default,
  CASE WHEN commune_id % 2 = 0 THEN 'old' ELSE 'new' END AS created FROM s""")
def register(t):
    from ...sources.registry import commune_sources

    k = F.col("commune_id")
    found = t.communes.select(
        F.upper("name").alias("Gemeinde"), F.concat(F.lit("https://www."), k.cast("string"), F.lit(".lu")).alias("Website"),
        F.concat(F.lit("https://www."), k.cast("string"), F.lit(".lu/agenda/x")).alias("Beispiel-URL"))
    batch = commune_sources(found, t.communes)
    ids = t.communes.select(F.col("name").alias("town_default"), "commune_id")
    target = batch.join(ids, "town_default").filter(k % 2 == 0).select(
        "name", F.lit("stale").alias("url"), F.lit("?").alias("canton_default"), F.sha2("name", 256).alias("id"),
        (k % 4 == 0).alias("active"), F.lit("2020-01-01 00:00:00").cast("timestamp").alias("created_at"))
    out = ops.register_sources(target, batch, now())
    return out.select("name", "active", "canton_default", F.when(F.year("created_at") == 2020, "old").otherwise("new").alias("created"))


@check("s20_curated", """
SELECT CAST(p_partkey AS VARCHAR) AS external_id, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN 'Indoor' ELSE 'Outdoor' END AS type,
  CASE p_partkey % 3 WHEN 0 THEN 'Playgrounds|Indoor' WHEN 1 THEN 'Nature' ELSE 'Culture' END AS category, canton, p_name AS town, 3 AS age_min, 99 AS age_max
FROM part JOIN communes_v ON p_name = name""")
def curated(t):
    k = F.col("p_partkey")
    rows = t.part.select(
        k.alias("id"), F.concat(F.lit(" "), "p_name").alias("name"), F.concat("p_name", F.lit(" (Uewen)")).alias("commune"), F.lit("Minett").alias("region"),
        F.when(k % 3 == 0, "indoor_playground").when(k % 3 == 1, "hiking").otherwise("?").alias("category"),
        F.when(k % 2 == 0, "indoor").otherwise("both").alias("indoor_outdoor"), F.lit("3+").alias("age_range"), F.lit("Text").alias("description_de"),
        F.lit("").alias("image_url"), F.lit("").alias("source_url"))
    out = tables.from_curated(rows, t.communes, F.lit(TODAY).cast("date"), now())
    return out.select("external_id", F.col("title.de").alias("title"), "type", F.array_join("category", "|").alias("category"), "canton", "town", "age_min", "age_max")


@check("s21_append_submissions", """
SELECT c_name AS name, 'pending' AS status, 'admin' AS created_by, sha256(c_name || chr(1) || c_mktsegment) AS id FROM customer""")
def append(t):
    batch = t.customer.select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    replayed = batch.unionByName(batch.filter("name LIKE '%5'"))
    first = ops.append_submissions(None, replayed, ["name", "segment"], now(), F.lit("admin"))
    return ops.append_submissions(first, batch, ["name", "segment"], now(), F.lit("other")).select("name", "status", "created_by", "id")


@check("s22_delete_ids", """
SELECT CAST(id AS VARCHAR) AS id, 'kept' AS outcome FROM listings_v WHERE id % 4 <> 0
UNION ALL SELECT DISTINCT CAST(-l_partkey - 1 AS VARCHAR), 'unmatched' FROM lineitem""")
def delete(t):
    ids = t.listings.filter("key % 4 = 0").select("id").unionByName(
        t.lineitem.select((-F.col("l_partkey") - 1).cast("string").alias("id")))
    kept, missing = ops.delete_ids(t.listings, ids)
    return kept.select("id", F.lit("kept").alias("outcome")).unionByName(missing.select("id", F.lit("unmatched").alias("outcome")))
