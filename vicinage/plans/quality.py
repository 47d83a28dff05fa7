"""Repeatable data-quality jobs: the same revision gives the report and the new snapshot.

A job adds `_new`, a struct of the revised fields, to every row. `report` lists what would change,
`apply` writes it into the rows; applying twice changes nothing the second time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..config import taxonomy as T
from ..config import vocabulary as V
from ..functions import dates, geo, hints, tags as tagging, text as tx, urls
from ..operators import routes as rt, sets, spatial, towns
from ..operators.filters import day
from ..schema import LANGS
from ..session import with_once


def revise(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Rows with `_new`; absent columns are added as null first, so old and new always compare."""
    missing = {c: F.lit(None) for c in new if c not in df.columns}
    typed = {c: F.when(F.lit(False), new[c]) for c in missing}
    base = df.withColumns(typed) if typed else df
    return base.withColumn("_new", F.struct(*[v.alias(k) for k, v in new.items()]))


def _fields(revised: DataFrame) -> list[str]:
    return revised.schema["_new"].dataType.names


def _shown(c: Column, kind) -> Column:
    return F.to_json(c) if kind.typeName() in ("struct", "array", "map") else c.cast("string")


def report(revised: DataFrame, key: str = "id") -> DataFrame:
    """(key, field, old, new) for every value that would change."""
    entries = []
    for c in _fields(revised):
        kind = revised.schema[c].dataType
        old, new = F.col(c), F.col(f"_new.{c}")
        entries.append(F.when(~old.eqNullSafe(new), F.struct(
            F.lit(c).alias("field"), _shown(old, kind).alias("old"), _shown(new, kind).alias("new"))))
    return revised.select(key, F.inline(F.array_compact(F.array(*entries))))


def apply(revised: DataFrame) -> DataFrame:
    return revised.withColumns({c: F.col(f"_new.{c}") for c in _fields(revised)}).drop("_new")


def changed(revised: DataFrame) -> DataFrame:
    """Only the rows that would change."""
    return revised.filter(reduce(lambda a, b: a | b, [
        ~F.col(c).eqNullSafe(F.col(f"_new.{c}")) for c in _fields(revised)]))


def _let_row(df: DataFrame, **columns: Column) -> DataFrame:
    return with_once(df, **{f"_{k}": v for k, v in columns.items()})


# --- texts ------------------------------------------------------------------------------------

def reread_age_and_price(listings: DataFrame) -> DataFrame:
    """Age and price as all languages of all prose fields state them."""
    prose = hints.all_languages(F.col("title"), F.col("short"), F.col("description"))
    rows = _let_row(listings, text=prose)
    rows = _let_row(rows, age=hints.read_age(F.col("_text")), price=hints.read_price(F.col("_text")))
    stated = F.col("_age.source") == "event"
    out = revise(rows, {
        "age_min": F.when(stated, F.coalesce("_age.age_min", F.lit(0))).otherwise(F.col("age_min")),
        "age_max": F.when(stated, F.coalesce("_age.age_max", F.lit(99))).otherwise(F.col("age_max")),
        "age_source": F.col("_age.source"), "price_adult": F.col("_price.adult"),
        "price_child": F.when(F.col("_price.is_free"), F.col("_price.adult")), "price_free": F.col("_price.is_free"),
        "price_source": F.col("_price.source"),
        "price_label": tx.localized(hints.price_label(F.col("_price.adult"), F.col("_price.is_free")))})
    return out.drop("_text", "_age", "_price")


def dates_from_titles(listings: DataFrame, today, now: Column) -> DataFrame:
    """The day a title ends with replaces a different start; the old day is kept beside it."""
    title = F.coalesce(tx.some_text(F.col("title.de")), tx.some_text(F.col("title.en")), F.lit(""))
    rows = _let_row(listings, stated=dates.date_from_title(title, day(today)))
    moves = F.col("_stated").isNotNull() & ~F.col("_stated").eqNullSafe(F.col("start_date"))
    kept = F.col("date_corrected") if "date_corrected" in listings.columns else F.lit(None)
    note = F.struct(F.col("start_date").alias("was"), F.col("_stated").alias("from_title"), now.alias("at"))
    return revise(rows, {"start_date": F.when(moves, F.col("_stated")).otherwise(F.col("start_date")),
                         "date_corrected": F.when(moves, note).otherwise(kept)}).drop("_stated")


def hide_impossible_dates(listings: DataFrame, today) -> DataFrame:
    """Listings dated in years nobody meant are unpublished, the dates noted."""
    t = day(today)
    bad = lambda c: F.when(~dates.plausible_year(F.col(c), t), F.col(c))
    found = bad("start_date").isNotNull() | bad("end_date").isNotNull()
    kept = F.col("date_flag") if "date_flag" in listings.columns else F.lit(None)
    return revise(listings, {
        "published": F.when(found, F.lit(False)).otherwise(F.col("published")),
        "date_flag": F.when(found, F.struct(bad("start_date").alias("start_date"), bad("end_date").alias("end_date")))
        .otherwise(kept)})


def neutral_defaults(sources: DataFrame) -> DataFrame:
    """Sources whose default says nothing in particular fall back to plain Culture."""
    generic = F.array(*[F.lit(c) for c in ("Culture", "Festivals")])
    neutral = F.array(*[F.lit(c) for c in V.CATEGORY_FALLBACK])
    stated = F.coalesce("category_default", neutral)
    return revise(sources, {"category_default": F.when(stated == generic, neutral).otherwise(stated)})


def recategorise(listings: DataFrame, sources: DataFrame) -> DataFrame:
    """Categories from each listing's own title and teaser over its source's (neutral) default."""
    defaults = apply(neutral_defaults(sources)).select(
        F.col("source_id").cast("string").alias("source_id"), F.col("category_default").alias("_default"))
    rows = listings.join(defaults, "source_id", "left")
    neutral = F.array(*[F.lit(c) for c in V.CATEGORY_FALLBACK])
    text = hints.all_languages(F.col("title"), F.col("short"))
    return revise(rows, {"category": hints.categorise(text, F.coalesce("_default", neutral))}).drop("_default")


def refile_places(places: DataFrame) -> DataFrame:
    """Kind and group as the current taxonomy reads the stored tags; kinds decided by shape stay put."""
    none = F.lit(None).cast("double")
    by_shape = [k for k, v in T.KINDS.items() if v[4].get("relations_only") or v[4].get("min_area_m2")]
    rows = _let_row(places, wanted=tagging.classify(F.col("tags_raw"), none, none))
    moves = F.col("_wanted").isNotNull() & ~F.col("_wanted").isin(by_shape)
    kind = F.when(moves, F.col("_wanted")).otherwise(F.col("kind"))
    return revise(rows, {"kind": kind, "group": F.when(moves, tagging.group_of(kind)).otherwise(F.col("group"))}) \
        .drop("_wanted")


def normalise_towns(listings: DataFrame, communes: DataFrame) -> DataFrame:
    """One spelling per town."""
    rows = towns.canonical_towns(listings, communes, canton="canton", out="_town")
    new = F.when(F.col("_town") != "", F.col("_town")).otherwise(F.col("town"))
    return revise(rows, {"town": new}).drop("_town")


def clean_texts(listings: DataFrame, short: int = 120) -> DataFrame:
    """Builder markup and padding out of all languages; an emptied description falls back to the title."""
    clean = lambda c: tx.normalise_text(tx.strip_page_builder(c))
    title = {x: clean(F.col(f"title.{x}")) for x in LANGS}

    def cleaned(x: str) -> Column:
        stored = F.col(f"description.{x}")
        return dates.let(clean(stored), lambda c: F.when(stored.eqNullSafe(c), stored).otherwise(
            F.coalesce(tx.some_text(c), title[x], F.lit(""))))

    prose = {x: cleaned(x) for x in LANGS}
    rows = _let_row(listings, title=F.struct(*[v.alias(k) for k, v in title.items()]),
                    prose=F.struct(*[v.alias(k) for k, v in prose.items()]))
    touched = reduce(lambda a, b: a | b, [~F.col(f"_prose.{x}").eqNullSafe(F.col(f"description.{x}")) for x in LANGS])

    def teaser(x: str) -> Column:
        # A teaser that is the start of its description stays one, even if it ends in a space.
        own, start = F.col(f"short.{x}"), F.substring(F.col(f"_prose.{x}"), 1, short)
        return F.when(own.isNull(), F.lit(None)).when(touched | (own == start), start).otherwise(clean(own))

    return revise(rows, {"title": F.col("_title"), "description": F.col("_prose"),
                         "short": F.struct(*[teaser(x).alias(x) for x in LANGS])}).drop("_title", "_prose")


def safety_findings(listings: DataFrame, places: DataFrame, listing_text: list[str], place_text: list[str]) -> DataFrame:
    """(collection, id, reason, matched) over both stores."""
    both = sets.for_audit(listings, places, listing_text, place_text)
    return both.withColumn("_v", hints.assess(F.col("text"))).filter(F.col("_v").isNotNull()) \
        .select("collection", "id", F.col("_v.reason").alias("reason"), F.col("_v.matched").alias("matched"))


def hide_unsafe(rows: DataFrame, text: Column, now: Column) -> DataFrame:
    """Explicit rows are unpublished with reason and match."""
    judged = _let_row(rows, verdict=hints.assess(text))
    found = F.col("_verdict").isNotNull()
    flag = F.struct(F.col("_verdict.reason").alias("reason"), F.col("_verdict.matched").alias("matched"), now.alias("at"))
    kept = F.col("family_flag") if "family_flag" in rows.columns else F.lit(None)
    first = F.when(found & F.col("family_flag").isNull(), flag).otherwise(F.col("family_flag")) \
        if "family_flag" in rows.columns else F.when(found, flag).otherwise(kept)
    live = F.col("published") if "published" in rows.columns else F.lit(True)
    return revise(judged, {"published": F.when(found, F.lit(False)).otherwise(live), "family_flag": first}).drop("_verdict")


def blank_stock_images(listings: DataFrame, hosts: list[str] = urls.STOCK_HOSTS) -> DataFrame:
    return revise(listings, {"image": F.when(urls.is_stock(F.col("image"), hosts), F.lit("")).otherwise(F.col("image"))})


# --- shapes -----------------------------------------------------------------------------------

# The box a computed centre has to lie in.
CENTRE_BOX = (49.30, 50.30, 5.60, 6.70)


def fill_centroids(places: DataFrame, ring_points: DataFrame) -> DataFrame:
    """Relations without a position get the mean of their outline, if it lies in the country; routes do not.

    `ring_points`: (osm_id, lat, lng), one row per outline vertex.
    """
    centre = ring_points.groupBy("osm_id").agg(F.avg("lat").alias("_lat"), F.avg("lng").alias("_lng"))
    rows = places.join(centre, "osm_id", "left")
    wanted = ((F.col("osm_type") == "relation") & F.col("lat").isNull() & ~F.col("kind").isin(T.ROUTE_KINDS)
              & geo.plausible(F.col("_lat"), F.col("_lng"), CENTRE_BOX))
    pick = lambda new, old: F.when(wanted, new).otherwise(old)
    kept = F.col("geocode_precision") if "geocode_precision" in places.columns else F.lit(None).cast("string")
    return revise(rows, {"lat": pick(F.col("_lat"), F.col("lat")), "lng": pick(F.col("_lng"), F.col("lng")),
                         "geocode_precision": pick(F.lit("relation_centroid"), kept)}).drop("_lat", "_lng")


def build_route_geometry(places: DataFrame, relations: DataFrame, way_points: DataFrame) -> DataFrame:
    """Route places with their simplified shape and box."""
    wanted = places.filter(F.col("kind").isin(T.ROUTE_KINDS)).select(F.col("osm_id").alias("route_id"))
    built = rt.build_geometry(relations.join(wanted, "route_id", "left_semi"), way_points)
    return places.join(built.withColumnRenamed("route_id", "osm_id"), "osm_id", "left")


def commune_index(boundaries: DataFrame, cantons: DataFrame, size: float = 0.05) -> DataFrame:
    """Communes with spellings, centre and canton; those outside every canton are left out.

    `boundaries`: (osm_id, tags, points array<struct<lat,lng>>); `cantons`: (region_id, name, bounds, rings).
    """
    from ..config.regions import CANTON_NAMES, SPELLING_TAGS
    from ..functions.tags import tag

    t = F.col("tags")
    spelled = F.array_compact(F.array(*[F.nullif(F.trim(tag(t, k)), F.lit("")) for k in SPELLING_TAGS]))
    centre = geo.vertex_mean(F.col("points"))
    site = F.coalesce(F.nullif(tag(t, "website"), F.lit("")), tag(t, "contact:website"), F.lit(""))
    one = lambda key: F.trim(F.coalesce(tag(t, key), F.lit("")))
    communes = boundaries.filter(tag(t, "ref:lau2").isNotNull()).select(
        "osm_id", F.array_sort(F.array_distinct(spelled)).alias("names"), one("name").alias("_own"),
        one("name:lb").alias("name_lb"), one("name:fr").alias("name_fr"), one("name:de").alias("name_de"),
        F.trim(site).alias("website"), F.bround(centre["lat"], 6).alias("lat"), F.bround(centre["lng"], 6).alias("lng"),
    ).filter(F.size("names") > 0)
    named = communes.withColumn("name", F.coalesce(F.nullif("_own", F.lit("")), F.get("names", 0))).drop("_own")
    table = F.create_map(*[F.lit(x) for pair in CANTON_NAMES.items() for x in pair])
    known = cantons.withColumn("_canton", F.try_element_at(table, tx.strip_canton_prefix(F.col("name")))) \
        .filter(F.col("_canton").isNotNull())
    placed = spatial.assign_region(named, known, size=size, out="canton", name="_canton")
    return placed.filter(F.col("canton").isNotNull())


# --- stores and accounts ----------------------------------------------------------------------

def preflight(tables: dict[str, DataFrame], expected: list[str]) -> DataFrame:
    """One row per expected table: present, rows, and what that means for a move."""
    some = next(iter(tables.values()))
    spark = some.sparkSession
    counts = reduce(lambda a, b: a.unionByName(b), [
        df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items() if name in expected])
    names = spark.createDataFrame([(n,) for n in expected], "name string")
    return names.join(counts, "name", "left").select(
        "name", F.col("n").isNotNull().alias("present"), F.coalesce("n", F.lit(0)).alias("n"),
        F.when(F.coalesce("n", F.lit(0)) > 0, "filled").otherwise("empty").alias("advice"))


def erase_users(users: DataFrame, sessions: DataFrame, listings: DataFrame, requests: DataFrame,
                protected_email: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(users, sessions, listings) after erasure: sessions and accounts go, content stays without its author.

    The protected account loses its sessions and authorship like any other, but the row itself stays.
    """
    wanted = requests.select(F.col("user_id")).distinct()
    safe = users.filter(F.lower("email") == protected_email.lower()).select(F.col("id").alias("user_id"))
    gone = wanted.join(safe, "user_id", "left_anti")
    left = users.join(gone.withColumnRenamed("user_id", "id"), "id", "left_anti")
    open_ = sessions.join(wanted, "user_id", "left_anti")
    marked = listings.join(wanted.select(F.col("user_id").alias("created_by"), F.lit(True).alias("_gone")), "created_by", "left")
    content = marked.withColumn("created_by", F.when(F.col("_gone"), F.lit("deleted_user")).otherwise(F.col("created_by"))) \
        .drop("_gone")
    return left, open_, content
