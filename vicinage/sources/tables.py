"""Stored tables: listings, map elements, the discovery result, curated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..config import regions as R
from ..functions import hints, text as tx
from ..operators.towns import canton_of
from ..schema import CANDIDATE_COLUMNS, ELEMENT_SCHEMA, LISTING_DEFAULTS, LISTING_SCHEMA


def _default(name: str, value) -> Column:
    kind = LISTING_SCHEMA[name].dataType
    if isinstance(kind, T.StructType):
        return F.struct(*[F.lit(value[f.name]).alias(f.name) for f in kind])
    if isinstance(kind, T.ArrayType):
        return F.array().cast(kind)
    return F.lit(value).cast(kind)


def with_listing_defaults(df: DataFrame) -> DataFrame:
    """All listing columns; an absent field takes its default, except where null means "not stated"."""
    present = set(df.columns)
    out = []
    for field in LISTING_SCHEMA:
        stored = F.col(field.name) if field.name in present else F.lit(None).cast(field.dataType)
        if field.name in LISTING_DEFAULTS:
            stored = F.coalesce(stored.cast(field.dataType), _default(field.name, LISTING_DEFAULTS[field.name]))
        out.append(stored.alias(field.name))
    return df.select(*out)


def read_listings(spark: SparkSession, path: str, format_: str = "parquet") -> DataFrame:
    """Stored listings under the fixed schema. JSON rows that do not fit are kept as nulls for `split_valid`."""
    reader = spark.read.schema(LISTING_SCHEMA)
    df = reader.option("mode", "PERMISSIVE").json(path) if format_ == "json" else reader.parquet(path)
    return with_listing_defaults(df)


def read_osm_elements(spark: SparkSession, path: str) -> DataFrame:
    """The decoded element table; an explicit schema, so only needed columns are scanned."""
    return spark.read.schema(ELEMENT_SCHEMA).parquet(path)


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """The discovery result table; a byte-order mark before the header is tolerated."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in CANDIDATE_COLUMNS])
    return (spark.read.schema(schema).option("header", True).option("encoding", "UTF-8")
            .option("enforceSchema", True).csv(path).na.fill(""))


def accepted(candidates: DataFrame) -> DataFrame:
    """Sites that cleared discovery and carry structured events."""
    return candidates.filter((F.col("Status") == "KANDIDAT") & (F.col("JSON-LD") == "ja"))


def from_curated(rows: DataFrame, communes: DataFrame, today: Column, now: Column) -> DataFrame:
    """Curated seed rows as listings.

    `rows`: (id, name, commune, region, category, indoor_outdoor, age_range, description_de, image_url, source_url).
    """
    lookup = lambda table, key, default: F.coalesce(F.try_element_at(F.create_map(*[
        x for k, v in table.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]) if isinstance(v, list) else F.lit(v))]),
        F.col(key)), default)
    placed = canton_of(rows, communes, "commune", "region")
    ages = hints.parse_age_range(F.col("age_range"))
    prose = F.coalesce("description_de", F.lit(""))
    name = F.trim("name")
    head = tx.parse_commune(F.col("commune"))
    listing = placed.select(
        F.sha2(F.concat_ws("\u0001", F.lit("curated"), F.col("id").cast("string")), 256).alias("id"),
        F.col("id").cast("string").alias("external_id"), tx.localized(name).alias("title"), tx.localized(prose).alias("short"),
        tx.localized(prose).alias("description"),
        lookup(R.CURATED_TYPES, "indoor_outdoor", F.lit("Outdoor")).alias("type"), "canton",
        F.coalesce(tx.some_text(head), tx.some_text(F.col("region")), F.lit(R.DEFAULT_TOWN)).alias("town"),
        lookup(R.CURATED_CATEGORIES, "category", F.array(F.lit("Culture"))).alias("category"),
        ages["age_min"].alias("age_min"), ages["age_max"].alias("age_max"), today.alias("start_date"),
        F.lit(0.0).alias("price_adult"), F.lit(0.0).alias("price_child"),
        F.struct(F.lit("Free").alias("en"), F.lit("Gratis").alias("de"), F.lit("Gratuit").alias("fr")).alias("price_label"),
        F.coalesce("image_url", F.lit("")).alias("image"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lng"),
        F.lit(4.6).alias("rating"), F.lit("Curated").alias("source_name"),
        F.coalesce("source_url", F.lit("")).alias("website_url"), now.alias("created_at"), now.alias("updated_at"))
    return with_listing_defaults(listing)
