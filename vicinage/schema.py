"""Table shapes: listings, their list projection, places and sources."""

from __future__ import annotations

from pyspark.sql import types as T

LANGS = ("en", "de", "fr")
PLACE_LANGS = ("lb", "de", "fr", "en")

LOCALIZED = T.StructType([T.StructField(lang, T.StringType()) for lang in LANGS])
EMPTY_TEXT = {lang: "" for lang in LANGS}

# The stored listing. (column, type, default where a stored row lacks the field)
LISTING_FIELDS: list[tuple[str, T.DataType, object]] = [
    ("id", T.StringType(), None),
    ("title", LOCALIZED, None),
    ("short", LOCALIZED, None),
    ("description", LOCALIZED, None),
    ("type", T.StringType(), "Event"),
    ("canton", T.StringType(), None),
    ("town", T.StringType(), None),
    ("category", T.ArrayType(T.StringType()), []),
    ("age_min", T.IntegerType(), 0),
    ("age_max", T.IntegerType(), 99),
    ("start_date", T.DateType(), None),
    ("end_date", T.DateType(), None),
    ("time", T.StringType(), ""),
    ("price_adult", T.DoubleType(), None),
    ("price_child", T.DoubleType(), None),
    ("price_free", T.BooleanType(), False),
    ("price_source", T.StringType(), "unknown"),
    ("age_source", T.StringType(), "unknown"),
    ("price_label", LOCALIZED, None),
    ("accessibility", LOCALIZED, None),
    ("weather_fit", LOCALIZED, None),
    ("image", T.StringType(), ""),
    ("lat", T.DoubleType(), None),
    ("lng", T.DoubleType(), None),
    ("bookable", T.BooleanType(), False),
    ("published", T.BooleanType(), True),
    ("rating", T.DoubleType(), 4.5),
    ("featured", T.BooleanType(), False),
    ("featured_until", T.DateType(), None),
    ("view_count", T.LongType(), 0),
    ("source_id", T.StringType(), None),
    ("source_name", T.StringType(), None),
    ("external_id", T.StringType(), None),
    ("website_url", T.StringType(), ""),
    ("accessibility_wheelchair", T.BooleanType(), False),
    ("sensory_friendly", T.BooleanType(), False),
    ("free_parking", T.BooleanType(), False),
    ("sensory_notes", LOCALIZED, EMPTY_TEXT),
    ("parking", LOCALIZED, EMPTY_TEXT),
    ("food_allowed", T.BooleanType(), True),
    ("food_onsite", LOCALIZED, EMPTY_TEXT),
    ("preparation_tips", LOCALIZED, EMPTY_TEXT),
    ("payment_methods", T.ArrayType(T.StringType()), []),
    ("opening_hours", LOCALIZED, EMPTY_TEXT),
    ("peak_hours", LOCALIZED, EMPTY_TEXT),
    ("changing_facilities", T.BooleanType(), False),
    ("restrooms", T.BooleanType(), True),
    ("geocode_precision", T.StringType(), None),
    ("geocode_source", T.StringType(), None),
    ("geocoded_at", T.TimestampType(), None),
    ("created_at", T.TimestampType(), None),
    ("updated_at", T.TimestampType(), None),
    ("created_by", T.StringType(), None),
]

LISTING_SCHEMA = T.StructType([T.StructField(n, t) for n, t, _ in LISTING_FIELDS])
LISTING_DEFAULTS = {n: d for n, _, d in LISTING_FIELDS if d is not None}

# The columns a list screen reads.
SUMMARY_COLS = [
    "id", "title", "short", "type", "canton", "town", "category", "age_min", "age_max",
    "start_date", "end_date", "time", "price_adult", "price_child", "price_free", "price_source",
    "age_source", "image", "lat", "lng", "featured", "published", "rating", "view_count",
    "source_name", "accessibility_wheelchair", "sensory_friendly", "free_parking",
]

# The two listing fields a patch may set back to null.
CLEARABLE_FIELDS = {"end_date", "featured_until"}

LAT_LNG = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lng", T.DoubleType())])
PATH_PARTS = T.ArrayType(T.ArrayType(LAT_LNG))

ELEMENT_SCHEMA = T.StructType([
    T.StructField("osm_id", T.LongType()),
    T.StructField("osm_type", T.StringType()),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lng", T.DoubleType()),
    T.StructField("area_m2", T.DoubleType()),
])

# The header of the discovery result table.
CANDIDATE_COLUMNS = [
    "Status", "Gemeinde", "Website", "robots", "Crawl-Delay", "Sitemap",
    "Veranstaltungsseiten", "Beispiel-URL", "JSON-LD", "Hinweis",
]
