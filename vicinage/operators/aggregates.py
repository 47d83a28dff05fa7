"""Counts, tallies and centres."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from ..config.profiles import FEATURED_PRICE, PLANS
from ..functions import geo, urls
from .filters import day
from .ranking import first_per


def overview(df: DataFrame) -> DataFrame:
    """Totals, published, drafts, featured and views in one pass."""
    live = F.coalesce("published", F.lit(False))
    return df.agg(
        F.count("*").alias("total"), F.count_if(live).alias("published"), F.count_if(~live).alias("drafts"),
        F.count_if(live & F.coalesce("featured", F.lit(False))).alias("featured"),
        F.sum(F.coalesce("view_count", F.lit(0))).alias("total_views"))


def top_listings(df: DataFrame, n: int = 5) -> DataFrame:
    return df.filter("published").orderBy(F.col("view_count").desc(), "id").limit(n).select("id", "title", "view_count")


def revenue(df: DataFrame) -> DataFrame:
    """Projected income of the featured listings."""
    return overview(df).select("featured", (F.col("featured") * FEATURED_PRICE).alias("projected"))


def plan_revenue(grants: DataFrame) -> DataFrame:
    """Sold plans and their price in cents."""
    price = F.create_map(*[F.lit(x) for name, (_, cents) in PLANS.items() for x in (name, cents)])
    return grants.filter(F.col("plan").isin(list(PLANS))).groupBy("plan").agg(
        F.count("*").alias("n"), F.sum(F.try_element_at(price, F.col("plan"))).alias("cents"))


def count_by(df: DataFrame, *keys: str | Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def by_kind(places: DataFrame) -> DataFrame:
    return count_by(places, "kind").orderBy(F.col("n").desc(), "kind")


def by_canton(df: DataFrame) -> DataFrame:
    return count_by(df.filter(F.coalesce("canton", F.lit("")) != ""), "canton")


def moves(changes: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """(old, new) pairs by how often they occur."""
    return count_by(changes, old, new).orderBy(F.col("n").desc(), old, new)


def category_shift(df: DataFrame, old: str, new: str) -> DataFrame:
    """Category counts before and after, one pass over the rows."""
    both = F.concat(
        F.transform(F.coalesce(old, F.array().cast("array<string>")),
                    lambda c: F.struct(c.alias("category"), F.lit(1).alias("was"), F.lit(0).alias("becomes"))),
        F.transform(F.coalesce(new, F.array().cast("array<string>")),
                    lambda c: F.struct(c.alias("category"), F.lit(0).alias("was"), F.lit(1).alias("becomes"))))
    return (df.select(F.inline(both)).groupBy("category")
            .agg(F.sum("was").alias("before"), F.sum("becomes").alias("after")))


def unknown_categories(df: DataFrame, column: str, known: list[str]) -> DataFrame:
    """Categories the reader cannot filter on, with counts."""
    return count_by(df.select(F.explode(column).alias("category")).filter(~F.col("category").isin(known)), "category")


def commune_centres(places: DataFrame, commune: str = "commune", at_least: int = 5) -> DataFrame:
    """Mean position of all located places per commune, only from five on."""
    located = places.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull() & (F.coalesce(commune, F.lit("")) != ""))
    return (located.groupBy(commune).agg(F.avg("lat").alias("lat"), F.avg("lng").alias("lng"), F.count("*").alias("n"))
            .filter(F.col("n") >= at_least))


def vertex_means(points: DataFrame, key: str) -> DataFrame:
    """Centre of each way or ring as the mean of its vertices (partial sums, no gathering)."""
    return points.groupBy(key).agg(F.avg("lat").alias("lat"), F.avg("lng").alias("lng"), F.count("*").alias("n"))


def point_bounds(points: DataFrame, key: str) -> DataFrame:
    """Bounding box of each route from its vertices."""
    return points.groupBy(key).agg(
        F.min("lat").alias("bbox_south"), F.max("lat").alias("bbox_north"),
        F.min("lng").alias("bbox_west"), F.max("lng").alias("bbox_east"))


def snapshot(df: DataFrame, today: str | date | Column) -> DataFrame:
    """Store figures: rows, published from today on, rows without a position."""
    located = geo.valid_point(F.col("lat"), F.col("lng"))
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("published") & (F.col("start_date") >= day(today))).alias("upcoming"),
        F.count_if(~located).alias("unlocated"))


def snapshot_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """after - before for two one-row snapshots."""
    names = before.columns
    signed = before.select(*[(-F.col(c)).alias(c) for c in names]).unionByName(after)
    return signed.agg(*[F.sum(c).alias(c) for c in names])


def run_report(outcomes: DataFrame, source: str = "source_id") -> DataFrame:
    """What each source's run yielded; seeing nothing at all is its own status."""
    n = lambda name: F.count_if(F.col("outcome") == name)
    return outcomes.groupBy(source).agg(
        n("inserted").alias("inserted"), n("skipped").alias("skipped"), n("blocked").alias("blocked")) \
        .withColumn("seen", F.col("inserted") + F.col("skipped") + F.col("blocked")) \
        .withColumn("status", F.when(F.col("seen") > 0, "ok").otherwise("no_events"))


def stock_hosts(df: DataFrame, image: str = "image", hosts: list[str] = urls.STOCK_HOSTS) -> DataFrame:
    """Stock photographs per host."""
    return count_by(df.filter(urls.is_stock(F.col(image), hosts)), urls.photo_host(F.col(image)).alias("host"))


def language_coverage(df: DataFrame, key: list, text: str) -> DataFrame:
    """Share of strings that are filled in, per key."""
    filled = F.count_if(F.coalesce(F.trim(F.col(text)), F.lit("")) != "")
    return df.groupBy(*key).agg(filled.alias("filled"), F.count("*").alias("n")) \
        .withColumn("share", F.round(F.col("filled") / F.col("n"), 4))


def co_located(df: DataFrame, order: list, digits: int = 5) -> DataFrame:
    """Rows sharing one spot: each row with its spot, the spot's size and its first row in list order.

    Long form on purpose: a spot can hold any number of rows, so they are never one array.
    """
    spot = [F.round("lat", digits).alias("spot_lat"), F.round("lng", digits).alias("spot_lng")]
    rows = df.filter(geo.valid_point(F.col("lat"), F.col("lng"))).select("*", *spot)
    key = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    spots = rows.groupBy("spot_lat", "spot_lng").agg(
        F.count("*").alias("at_spot"), F.min_by("id", key).alias("first_id")).filter(F.col("at_spot") > 1)
    return rows.join(spots, ["spot_lat", "spot_lng"])


def ingest_report(rows: DataFrame, kind: str = "kind") -> DataFrame:
    """Raw, kept, written and skipped per kind with a totals row (kind null)."""
    n = lambda flag: F.count_if(F.coalesce(flag, F.lit(False)))
    return rows.rollup(kind).agg(
        F.count("*").alias("raw"), n("kept").alias("deduped"), n("written").alias("upserted"),
        n("skipped").alias("skipped"), n("failed").alias("errors"))


def view_counts(pings: DataFrame, key: str = "listing_id") -> DataFrame:
    return pings.groupBy(key).agg(F.count("*").alias("views"))
