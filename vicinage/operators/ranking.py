"""Orders, pages, top-k, first-per-key and run bookkeeping.

`first_per` is the one dedup used everywhere: `row_number() <= n` over a full order. Catalyst plans
a partial group limit before the shuffle, so a hot key sends at most n rows per map task.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import dates, geo, urls
from ..functions.text import pick_lang
from .filters import day


def _order(keys: list) -> list[Column]:
    return [F.col(k) if isinstance(k, str) else k for k in keys]


def first_per(df: DataFrame, keys: list, order: list, n: int = 1, rank: str | None = None) -> DataFrame:
    """The first `n` rows of each key in a total order; `rank` keeps the position as a column."""
    name = rank or "_position"
    w = Window.partitionBy(*_order(keys)).orderBy(*_order(order))
    out = df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def relevance_keys(today: str | date | Column) -> list[Column]:
    """Featured first, then the first day still ahead, then the later start, then id."""
    return [F.col("featured").desc(), dates.relevant_from(F.col("start_date"), day(today)).asc(),
            F.col("start_date").desc(), F.col("id").asc()]


def by_relevance(df: DataFrame, today: str | date | Column) -> DataFrame:
    return df.orderBy(*relevance_keys(today))



def by_score(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("family_score").desc(), F.col("id").asc())


def page(df: DataFrame, order: list, skip: int = 0, limit: int = 20) -> tuple[DataFrame, DataFrame]:
    """(one page of a total order, a one-row total). Offset and limit stay in one top-k plan."""
    rows = df.orderBy(*_order(order)).offset(skip).limit(limit)
    return rows, df.agg(F.count("*").alias("total"))


def with_distance(df: DataFrame, position: tuple[float, float] | None) -> DataFrame:
    """`distance_km` when both a position and a coordinate exist, else null."""
    if position is None:
        return df.withColumn("distance_km", F.lit(None).cast("double"))
    parts = F.col("path_parts") if "path_parts" in df.columns else None
    return df.withColumn("distance_km", geo.distance_km(
        F.lit(float(position[0])), F.lit(float(position[1])), F.col("lat"), F.col("lng"), parts))


def nearest_places(df: DataFrame, lat: float, lng: float, radius_km: float, limit: int | None = None) -> DataFrame:
    """Nearest first inside the circle, the shown distance at one decimal."""
    from .filters import within_radius

    out = within_radius(df, lat, lng, radius_km, sort=False).orderBy("distance_km", "id")
    out = out if limit is None else out.limit(limit)
    return out.withColumn("distance_km", F.bround("distance_km", 1))


def near_you(df: DataFrame, position: tuple[float, float], n: int = 3) -> DataFrame:
    return with_distance(df, position).filter(F.col("distance_km").isNotNull()).orderBy("distance_km", "id").limit(n)


def featured3(df: DataFrame, chip: str, order: list, n: int = 3) -> DataFrame:
    """First rows of the list for a chip: "All", a setting, or an age band."""
    if chip in ("Indoor", "Outdoor"):
        df = df.filter(F.col("type") == chip)
    elif chip != "All":
        low, high = (int(x) for x in chip.split("-"))
        df = df.filter((F.col("age_min") <= high) & (F.col("age_max") >= low))
    return df.orderBy(*_order(order)).limit(n)


def admin_list(df: DataFrame, skip: int = 0, limit: int = 100) -> DataFrame:
    return df.orderBy("start_date", "id").offset(skip).limit(limit)


def partner_list(df: DataFrame, cap: int = 500) -> DataFrame:
    """Newest submissions first; the cap is the size of the admin screen."""
    return df.orderBy(F.col("created_at").desc(), "id").limit(cap)


def grouped_by_month(df: DataFrame, today: str | date | Column, lang: str) -> DataFrame:
    """Rows in reading order with their heading: months by relevance, then the always-open venues.

    The heading is a column and the order a sort, so no group is ever gathered in one place.
    """
    venue = F.coalesce(F.col("source_name").startswith("Curated"), F.lit(False))
    relevant = dates.relevant_from(F.col("start_date"), day(today))
    headed = df.withColumns({
        "section": F.when(venue, F.lit("always_open")).otherwise(F.lit("dated")),
        "month": F.when(~venue, F.trunc(relevant, "MM")),
        "sort_title": F.when(venue, F.lower(pick_lang(F.col("title"), lang))),
    })
    return headed.orderBy(
        F.col("section").desc(), F.when(F.col("section") == "dated", F.col("featured")).desc_nulls_last(),
        F.when(F.col("section") == "dated", relevant), F.when(F.col("section") == "dated", F.col("start_date")).desc(),
        "sort_title", "id")


def month_headings(headed: DataFrame) -> DataFrame:
    """One row per heading with its number of rows."""
    return headed.groupBy("section", "month").agg(F.count("*").alias("n"))


def grouped_by_day(df: DataFrame, date_from: Column, date_to: Column) -> DataFrame:
    """Rows starting in the window, in day order, the day being the heading."""
    return df.filter(F.col("start_date").between(date_from, date_to)).orderBy("start_date", "id")


def freshest(entries: DataFrame, n: int, source: str = "source_id") -> DataFrame:
    """The `n` most recently changed distinct urls per source; an unknown change date comes last."""
    distinct = first_per(entries, [source, "url"], ["position"])
    return first_per(distinct, [source], [F.col("lastmod").desc(), F.col("position").asc()], n, rank="rank")


def rotate(items: DataFrame, cursors: DataFrame, budget: int, source: str = "source_id") -> DataFrame:
    """The `budget` items that follow the stored cursor, wrapping around.

    `items`: (source, position from 0 without gaps, ...); `cursors`: (source, crawl_cursor).
    """
    listed = items.groupBy(source).agg(F.count("*").alias("listed")).join(cursors, source, "left")
    start = F.pmod(F.coalesce("crawl_cursor", F.lit(0)), F.col("listed"))
    turned = items.join(listed, source).withColumn("turn", F.pmod(F.col("position") - start, F.col("listed")))
    return turned.filter(F.col("turn") < budget)


def next_cursors(visited: DataFrame, source: str = "source_id") -> DataFrame:
    """Where the next run starts: the cursor moved on by what was visited."""
    per = visited.groupBy(source).agg(
        F.count("*").alias("visited"), F.max("listed").alias("listed"),
        F.max(F.coalesce("crawl_cursor", F.lit(0))).alias("cursor"))
    return per.select(source, F.pmod(F.pmod(F.col("cursor"), F.col("listed")) + F.col("visited"), F.col("listed"))
                      .alias("crawl_cursor"))


def empty_streak(runs: DataFrame, source: str = "source_id", at: str = "run_at", seen: str = "seen",
                 warn_from: int = 3) -> DataFrame:
    """Consecutive runs without anything at the end of each source's history.

    Two aggregations (last run that saw something, runs after it) instead of a window over a
    source's whole history, which one busy source would make a single task.
    """
    last_seen = runs.groupBy(source).agg(F.max(F.when(F.col(seen) > 0, F.col(at))).alias("last_seen"))
    after = F.col("last_seen").isNull() | (F.col(at) > F.col("last_seen"))
    return (runs.select(source, at).join(last_seen, source)
            .groupBy(source).agg(F.count_if(after).alias("empty_runs"))
            .withColumn("warn", F.col("empty_runs") >= warn_from))


def url_rank(url: Column) -> Column:
    """Sort key of an example page: a calendar section, not a shop, shallow, short."""
    path = urls.path_of(url)
    return F.struct(
        F.when(path.rlike(urls.STRONG_SECTION), 0).otherwise(1).alias("section"),
        F.when(path.rlike(urls.NOT_A_LISTING), 1).otherwise(0).alias("shop"),
        (F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))).alias("depth"),
        F.length(path).alias("length"), url.alias("url"))


def best_urls(df: DataFrame, site: list, n: int = 1, url: str = "url") -> DataFrame:
    """The best-ranked `n` urls per site."""
    return first_per(df, site, [url_rank(F.col(url))], n, rank="rank")


def hydrate(ranked: DataFrame, wide: DataFrame, key: str = "id") -> DataFrame:
    """Wide columns for a ranked page only, in the page's order; the page is the small side."""
    return ranked.join(wide.select(key, *[c for c in wide.columns if c not in ranked.columns]), key) \
        .orderBy("rank")
