"""Projections and filters over listings and places."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import taxonomy as T
from ..functions import dates, geo, tags as tagging
from ..schema import LANGS, SUMMARY_COLS

ALL = lambda conditions: reduce(lambda a, b: a & b, conditions, F.lit(True))
LISTING_TYPES = ["Event", "Indoor", "Outdoor", "Educational"]


def day(value: str | date | Column) -> Column:
    """A clock argument as a date Column."""
    return value if isinstance(value, Column) else F.lit(str(value)).cast("date")


def closed_ages(df: DataFrame) -> DataFrame:
    """Open age ends are 0 and 99, not holes."""
    return df.withColumns({"age_min": F.coalesce("age_min", F.lit(0)), "age_max": F.coalesce("age_max", F.lit(99))})


def summary(df: DataFrame) -> DataFrame:
    """The list projection; everything else is pruned at the scan."""
    return closed_ages(df.select(*[c for c in SUMMARY_COLS if c in df.columns]))


def place_rows(df: DataFrame, geometry: bool = False) -> DataFrame:
    """Places without their raw tags, and without shapes unless asked for."""
    return df.drop("tags", "tags_raw", *([] if geometry else ["path_parts"]))


def row_problems() -> Column:
    """What makes a listing unusable in a list, in field order."""
    required = ["id", "title", "short", "canton", "town", "start_date", "lat", "lng"]
    found = [F.when(F.col(c).isNull(), F.lit(f"{c} missing")) for c in required]
    found.append(F.when(~F.col("type").isin(LISTING_TYPES), F.lit("type not known")))
    found.append(F.when(F.col("end_date") < F.col("start_date"), F.lit("end_date before start_date")))
    return F.array_compact(F.array(*found))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable rows, quarantine of (id, all its problems)): one bad row costs one row."""
    marked = df.withColumn("_problems", row_problems())
    good = marked.filter(F.size("_problems") == 0).drop("_problems")
    bad = marked.filter(F.size("_problems") > 0).select("id", F.col("_problems").alias("problems"))
    return good, bad


def published(df: DataFrame) -> DataFrame:
    return df.filter("published")


def age_overlaps(want_min: int | None, want_max: int | None) -> Column:
    """Ranges that meet, each side optional."""
    parts = []
    if want_max is not None:
        parts.append(F.coalesce("age_min", F.lit(0)) <= want_max)
    if want_min is not None:
        parts.append(F.coalesce("age_max", F.lit(99)) >= want_min)
    return ALL(parts)


def needs(wheelchair: bool = False, sensory: bool = False, free_parking: bool = False) -> Column:
    """Needs only narrow: a need that is off means "do not care"."""
    flags = {"accessibility_wheelchair": wheelchair, "sensory_friendly": sensory, "free_parking": free_parking}
    return ALL([F.col(name) for name, wanted in flags.items() if wanted])


def search(q: str, langs: Iterable[str] = LANGS) -> Column:
    """Literal, case-insensitive substring in title, teaser or town."""
    needle = F.lower(F.lit(q.strip()))
    fields = [F.col(part)[lang] for part in ("title", "short") for lang in langs] + [F.col("town")]
    return reduce(lambda a, b: a | b, [F.coalesce(F.lower(f).contains(needle), F.lit(False)) for f in fields])


def still_current(today: str | date | Column) -> Column:
    return dates.still_current(F.col("start_date"), F.col("end_date"), day(today))


def filter_listings(
    df: DataFrame, *, today: str | date | Column, canton: str | None = None, category: list[str] | None = None,
    type_: str | None = None, age_min: int | None = None, age_max: int | None = None, wheelchair: bool = False,
    sensory: bool = False, free_parking: bool = False, date_from: str | None = None, date_to: str | None = None,
    q: str | None = None, upcoming: bool = False, near: tuple[float, float] | None = None, radius_km: float = 10.0,
) -> DataFrame:
    """The listing query: every given part narrows, all parts hold together.

    An explicit `date_from` replaces the "not finished yet" rule. `near` keeps the circle; its box is
    stated as well because plain comparisons reach the parquet scan and the distance formula cannot.
    """
    parts = [F.col("published")]
    if canton:
        parts.append(F.col("canton") == canton)
    if category:
        parts.append(F.arrays_overlap("category", F.array(*[F.lit(c) for c in category])))
    if type_:
        parts.append(F.col("type") == type_)
    parts.append(age_overlaps(age_min, age_max))
    parts.append(needs(wheelchair, sensory, free_parking))
    if upcoming and not date_from:
        parts.append(still_current(today))
    if date_from:
        parts.append(F.col("start_date") >= day(date_from))
    if date_to:
        parts.append(F.col("start_date") <= day(date_to))
    if q and q.strip():
        parts.append(search(q))
    out = df.filter(ALL(parts))
    if near is not None:
        out = within_radius(out, *near, radius_km, sort=False)
    return out


def filter_places(df: DataFrame, *, min_score: int | None = None, kind: str | None = None,
                  group: str | None = None, layer: str | None = None) -> DataFrame:
    parts = []
    if "published" in df.columns:
        parts.append(F.coalesce("published", F.lit(True)))
    if min_score is not None:
        parts.append(F.col("family_score") >= min_score)
    if kind:
        parts.append(F.col("kind") == kind)
    if group:
        parts.append(F.col("group") == group)
    if layer:
        parts.append(tagging.layer_of(F.col("kind")) == layer)
    return df.filter(ALL(parts))


def near_prefilter(df: DataFrame, lat: float, lng: float, radius_km: float) -> DataFrame:
    """Point in the box, or a route whose own box overlaps it."""
    box = geo.bounding_box(lat, lng, radius_km)
    inside = geo.in_box(F.col("lat"), F.col("lng"), box)
    if "bbox_south" in df.columns:
        south, north, west, east = box
        overlap = ((F.col("bbox_south") <= north) & (F.col("bbox_north") >= south)
                   & (F.col("bbox_west") <= east) & (F.col("bbox_east") >= west))
        inside = F.coalesce(inside, F.lit(False)) | F.coalesce(overlap, F.lit(False))
    return df.filter(inside)


def within_radius(df: DataFrame, lat: float, lng: float, radius_km: float, sort: bool = True) -> DataFrame:
    """Rows truly inside the circle with `distance_km`; neither point nor path means out."""
    parts = F.col("path_parts") if "path_parts" in df.columns else None
    d = geo.distance_km(F.lit(float(lat)), F.lit(float(lng)), F.col("lat"), F.col("lng"), parts)
    out = near_prefilter(df, lat, lng, radius_km).withColumn("distance_km", d) \
        .filter(F.col("distance_km") <= radius_km)
    return out.orderBy("distance_km", "id") if sort and "id" in df.columns else out


def within_view(df: DataFrame, centre: tuple[float, float], radius_km: float, zoom: float) -> DataFrame:
    return df.filter(geo.within_view(F.col("lat"), F.col("lng"), centre, radius_km, zoom))


def pending_geocode(df: DataFrame, now: datetime, batch: int | None = None) -> DataFrame:
    """Imprecise or missing positions not tried within seven days; `batch` is the size of one pass."""
    vague = ["", "canton", "commune", "fallback", "source_default"]
    missing = F.col("lat").isNull() | (F.col("lat") == 0) | F.col("geocode_precision").isNull() \
        | F.col("geocode_precision").isin(vague)
    cutoff = F.lit(now - timedelta(days=7)).cast("timestamp")
    rested = F.col("geocoded_at").isNull() | (F.col("geocoded_at") < cutoff)
    out = df.filter(missing & rested)
    return out if batch is None else out.orderBy(F.col("geocoded_at").asc_nulls_first(), "id").limit(batch)


def fresh(df: DataFrame, today: str | date | Column, horizon_days: int | None = None) -> DataFrame:
    """Import freshness: nothing older than yesterday; calendars also end after a year."""
    t = day(today)
    keep = F.col("start_date") >= F.date_sub(t, 1)
    if horizon_days is not None:
        keep = keep & (F.col("start_date") <= F.date_add(t, horizon_days))
    return df.filter(keep)


def saved(df: DataFrame, ids: DataFrame, tab: str | None = None) -> DataFrame:
    """The listings in a saved-id table, optionally of one type; "Places" is every type but Event."""
    out = df.join(ids.select("id").distinct(), "id", "left_semi")
    if tab == "Events":
        return out.filter(F.col("type") == "Event")
    if tab == "Places":
        return out.filter(F.col("type") != "Event")
    return out


def get(df: DataFrame, id_: str, admin: bool = False) -> DataFrame:
    hit = F.col("id") == id_
    return df.filter(hit if admin else hit & F.col("published"))


def taxonomy(spark: SparkSession) -> DataFrame:
    """Groups, kinds, labels and base scores as a table."""
    rows = [(v[0], kind, *T.GROUPS[v[0]], *v[2], v[1]) for kind, v in T.KINDS.items()]
    names = ["group", "kind", *[f"group_{x}" for x in ("lb", "de", "fr", "en")],
             *[f"label_{x}" for x in ("lb", "de", "fr", "en")], "base_score"]
    return spark.createDataFrame(rows, ", ".join(f"`{n}` {'int' if n == 'base_score' else 'string'}" for n in names))


def calendar_window(option: str, today: Column) -> Column:
    """struct(date_from, date_to) of the calendar screen: weekend, seven days, rest of the month."""
    wd = F.weekday(today)
    saturday = F.date_add(today, F.when(wd == 6, F.lit(-1)).otherwise(5 - wd).cast("int"))
    windows = {
        "weekend": (F.greatest(saturday, today), F.date_add(saturday, 1)),
        "week": (today, F.date_add(today, 7)),
        "month": (today, F.last_day(today)),
    }
    start, end = windows[option]
    return F.struct(start.alias("date_from"), end.alias("date_to"))
