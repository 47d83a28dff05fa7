"""Town and venue names to places: spellings, names in free text, positions by the best source.

`communes` everywhere: (name, names array<string>, canton, lat, lng). Joins carry no broadcast
hints: the optimizer broadcasts a side only under its size threshold, and adaptive execution
splits a town that holds a large share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import regions as R
from ..functions import text as tx
from .containment import containment_join, longest, prefixes
from .ranking import first_per


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def spelling_index(communes: DataFrame) -> DataFrame:
    """(spelling, display): every folded spelling once; the last display name in order wins."""
    every = F.explode(F.array_union(F.coalesce("names", F.array().cast("array<string>")), F.array("name")))
    folded = communes.select(F.col("name").alias("display"), every.alias("_s")) \
        .select("display", tx.fold(F.col("_s")).alias("spelling")).filter(F.col("spelling") != "")
    return folded.groupBy("spelling").agg(F.max("display").alias("display"))


def canonical_towns(df: DataFrame, communes: DataFrame, town: str = "town", canton: str | None = None,
                    out: str = "town_canonical") -> DataFrame:
    """One spelling per town; unknown names pass through.

    Order: known spelling, short form, short form settled by the canton, name without its suffix.
    """
    index = spelling_index(communes)
    raw = F.trim(F.coalesce(town, F.lit("")))
    folded = tx.fold(raw)
    bare = tx.strip_town_suffix(raw)
    place = tx.fold(F.coalesce(canton, F.lit(""))) if canton else F.lit("")
    settled = F.lit(None).cast("string")
    for short, choices in R.AMBIGUOUS_TOWNS.items():
        settled = F.when(folded == short, F.coalesce(_lookup(choices, place), raw)).otherwise(settled)
    # Two lookups, one after the other, only for keys that exist: null keys never meet in a join.
    keyed = df.withColumns({
        "_raw": raw, "_whole": F.nullif(folded, F.lit("")),
        "_bare": F.when((bare != raw), F.nullif(tx.fold(bare), F.lit(""))),
        "_alias": _lookup(R.TOWN_ALIASES, folded), "_settled": settled,
    })
    a = index.select(F.col("spelling").alias("_whole"), F.col("display").alias("_hit"))
    b = index.select(F.col("spelling").alias("_bare"), F.col("display").alias("_bare_hit"))
    found = keyed.join(a, "_whole", "left").join(b, "_bare", "left")
    name = F.coalesce("_hit", "_alias", "_settled", "_bare_hit", "_raw")
    return found.withColumn(out, name).drop("_raw", "_whole", "_bare", "_alias", "_settled", "_hit", "_bare_hit")


def is_commune(df: DataFrame, communes: DataFrame, name: str, out: str = "is_commune") -> DataFrame:
    index = spelling_index(communes).select(F.col("spelling").alias("_k"), F.lit(True).alias("_yes"))
    return (df.withColumn("_k", tx.fold(F.coalesce(name, F.lit("")))).join(index, "_k", "left")
            .withColumn(out, F.coalesce("_yes", F.lit(False))).drop("_k", "_yes"))


def towns_in_text(df: DataFrame, communes: DataFrame, key: str, text: str,
                  min_length: int = R.MIN_SPELLING) -> DataFrame:
    """(key, town): the longest spelling found in each text; ties go to the first display name."""
    index = spelling_index(communes).filter(F.length("spelling") >= min_length)
    folded = df.select(key, tx.fold(F.col(text)).alias("_folded"))
    hits = containment_join(folded, "_folded", index, "spelling", min_length, longest(index, "spelling"), [key])
    best = F.min_by("display", F.struct((-F.length("spelling")).alias("n"), F.col("display").alias("d")))
    return hits.groupBy(key).agg(best.alias("town"))


def match_commune(candidates: DataFrame, communes: DataFrame, name: str = "name") -> DataFrame:
    """Candidates with `commune`: exact on any spelling, else the only commune one contains, else null."""
    spell = communes.select(F.col("name").alias("commune"), F.explode("names").alias("_n")) \
        .select("commune", tx.fold(F.col("_n")).alias("spelling")).filter(F.col("spelling") != "").distinct()
    keyed = candidates.withColumn("_target", F.nullif(tx.fold(F.col(name)), F.lit("")))
    targets = keyed.select("_target").filter(F.col("_target").isNotNull()).distinct()
    exact = spell.groupBy("spelling").agg(F.min("commune").alias("_exact"))
    hit = targets.join(exact, targets["_target"] == exact["spelling"], "left").drop("spelling")
    open_ = hit.filter(F.col("_exact").isNull()).select("_target")

    k = 3
    reach = max(longest(spell, "spelling"), longest(open_, "_target"))
    inside_target = containment_join(open_, "_target", spell, "spelling", k, reach, ["_target"]) \
        .select("_target", "commune")
    inside_name = containment_join(spell, "spelling", open_, "_target", k, reach, ["commune"]) \
        .select("_target", "commune")
    partial = (inside_target.unionByName(inside_name).groupBy("_target")
               .agg(F.min("commune").alias("_a"), F.max("commune").alias("_b"))
               .filter(F.col("_a") == F.col("_b")).select("_target", F.col("_a").alias("_partial")))
    resolved = hit.join(partial, "_target", "left") \
        .select("_target", F.coalesce("_exact", "_partial").alias("commune"))
    return keyed.join(resolved, "_target", "left").drop("_target")


def local_places(df: DataFrame, places: DataFrame, key: str, venue: str, commune: str | None = None,
                 order: list | None = None, min_length: int = 4) -> DataFrame:
    """(key, name, lat, lng): our own place whose name starts with the venue's, in its commune first.

    Places are reduced to one best row per wanted prefix before anything meets a venue, so a name
    that starts a third of all places costs one row.
    """
    rank = F.struct(*[F.col(c) if isinstance(c, str) else c for c in (order or ["id"])])
    wanted = df.select(F.lower(F.col(venue)).alias("_venue")).filter(F.length("_venue") >= min_length).distinct()
    located = places.filter((F.coalesce("lat", F.lit(0.0)) != 0) & (F.coalesce("lng", F.lit(0.0)) != 0))
    best_row = F.struct("name", "lat", "lng")
    by_prefix = (located.withColumn("_rank", rank)
                 .select("commune", "_rank", best_row.alias("_place"),
                         F.explode(prefixes(F.lower(F.col("name")), min_length)).alias("_venue"))
                 .join(wanted, "_venue", "left_semi"))
    anywhere = by_prefix.groupBy("_venue").agg(F.min_by("_place", "_rank").alias("_any"))
    venues = df.withColumn("_venue", F.lower(F.col(venue)))
    out = venues.join(anywhere, "_venue")
    if commune:
        inside = by_prefix.filter(F.col("commune").isNotNull()).groupBy("_venue", "commune") \
            .agg(F.min_by("_place", "_rank").alias("_near")).withColumnRenamed("commune", "_commune")
        out = out.join(inside, (out["_venue"] == inside["_venue"]) & (out[commune] == inside["_commune"]), "left") \
            .withColumn("_any", F.coalesce("_near", "_any"))
    return out.select(key, F.col("_any.name").alias("place_name"), F.col("_any.lat").alias("lat"),
                      F.col("_any.lng").alias("lng"))


def canton_of(df: DataFrame, communes: DataFrame, commune: str, region: str | None = None,
              source_name: str | None = None, out: str = "canton",
              regions: dict[str, str] = R.REGION_CANTON,
              fragments: list[tuple[str, str]] = R.CANTON_FRAGMENTS) -> DataFrame:
    """Canton by commune name (any case), by region, by the first fragment of a source name, else the default."""
    known = communes.select(F.lower("name").alias("_k"), F.col("canton").alias("_canton")) \
        .groupBy("_k").agg(F.min("_canton").alias("_canton"))
    steps = [F.col("_canton")]
    if region:
        steps.append(_lookup(regions, F.col(region)))
    if source_name:
        lower = F.lower(F.col(source_name))
        steps.append(F.coalesce(*[F.when(lower.contains(part), F.lit(canton)) for part, canton in fragments]))
    keyed = df.withColumn("_k", F.lower(tx.parse_commune(F.col(commune))))
    return (keyed.join(known, "_k", "left")
            .withColumn(out, F.coalesce(*steps, F.lit(R.DEFAULT_CANTON))).drop("_k", "_canton"))


def address_queries(df: DataFrame, communes: DataFrame) -> DataFrame:
    """`query` = the bare town; `narrowed` = "town, canton" for towns that are no commune, else ""."""
    bare = df.withColumn("query", tx.clean_town(F.col("town")))
    flagged = is_commune(bare, communes, "query")
    canton = F.trim(F.coalesce("canton", F.lit("")))
    narrowed = F.when((F.col("query") != "") & ~F.col("is_commune") & (canton != ""),
                      F.concat(F.col("query"), F.lit(", "), canton)).otherwise(F.lit(""))
    return flagged.withColumn("narrowed", narrowed)


def precision_of(accuracy: Column) -> Column:
    """8 and up is a house, 6 and 7 a street, less a locality."""
    return F.when(accuracy >= 8, "address").when(accuracy >= 6, "street").otherwise("locality")


def usable_addresses(addresses: DataFrame) -> DataFrame:
    """Address answers (query, address, accuracy, lat, lng) that relate to their question, best first per query."""
    judged = addresses.withColumn("precision", precision_of(F.coalesce("accuracy", F.lit(0)))) \
        .filter((F.col("precision") != "locality") | tx.shares_token(F.col("query"), F.col("address")))
    return first_per(judged, ["query"], [F.col("accuracy").desc(), "address", "lat", "lng"])


def resolve_locations(df: DataFrame, places: DataFrame, addresses: DataFrame, communes: DataFrame,
                      centres: DataFrame, order: list | None = None,
                      cantons: dict[str, tuple[float, float]] = R.CANTON_CENTRES) -> DataFrame:
    """Listings with lat, lng, geocode_precision and geocode_source from the best source that answers.

    Place named like the town; place named like the title (its commune first); address table by town,
    then by "town, canton"; centre of the commune's places; canton centre; country centre. `centres`:
    (commune, lat, lng). Every step joins distinct names, not listings.
    """
    named = address_queries(df, communes).withColumns(
        {"_title": tx.clean_title(F.col("title")), "_town": F.col("query")})
    by_town = local_places(
        named.select("_town").filter(F.col("_town") != "").distinct(), places, "_town", "_town", None, order)
    titles = named.select("_title", "_town").distinct().withColumn("_pair", F.struct("_title", "_town"))
    by_title = local_places(titles, places, "_pair", "_title", "_town", order) \
        .select(F.col("_pair._title").alias("_title"), F.col("_pair._town").alias("_town"), "lat", "lng")
    answers = usable_addresses(addresses)

    def stage(frame: DataFrame, precision: str | Column, source: str, name: str) -> DataFrame:
        keep = [c for c in frame.columns if c not in ("lat", "lng", "precision", "place_name", "address", "accuracy", "n")]
        value = F.struct(F.col("lat"), F.col("lng"), (F.lit(precision) if isinstance(precision, str) else precision)
                         .alias("precision"), F.lit(source).alias("source"))
        return frame.select(*keep, value.alias(name))

    one = stage(by_town, "address", "places", "_s1")
    two = stage(by_title, "address", "places", "_s2")
    three = stage(answers.withColumnRenamed("query", "query"), F.col("precision"), "addresses", "_s3")
    four = stage(answers.withColumnRenamed("query", "narrowed"), F.col("precision"), "addresses", "_s4")
    five = stage(centres.withColumnRenamed("commune", "_town"), "commune", "places", "_s5")
    out = (named.join(one, "_town", "left").join(two, ["_title", "_town"], "left").join(three, "query", "left")
           .join(four, "narrowed", "left").join(five, "_town", "left"))
    at = lambda i, default: F.coalesce(F.try_element_at(F.create_map(
        *[x for k, v in cantons.items() for x in (F.lit(k), F.lit(v[i]))]), F.trim(F.col("canton"))), F.lit(default))
    last = F.struct(at(0, R.COUNTRY_CENTRE[0]).alias("lat"), at(1, R.COUNTRY_CENTRE[1]).alias("lng"),
                    F.lit("canton").alias("precision"), F.lit("fallback").alias("source"))
    # A town equal to the title is looked up once, as a title.
    first = F.when(F.col("_town") != F.col("_title"), F.col("_s1"))
    best = F.coalesce(first, "_s2", "_s3", "_s4", "_s5", last)
    return out.withColumn("_best", best).withColumns({
        "lat": F.col("_best.lat"), "lng": F.col("_best.lng"), "geocode_precision": F.col("_best.precision"),
        "geocode_source": F.col("_best.source"),
    }).select(*dict.fromkeys([*df.columns, "lat", "lng", "geocode_precision", "geocode_source"]))


def match_index(sources: DataFrame, pages: DataFrame, url: str = "url", index: str = "index_url") -> DataFrame:
    """Sources with the one index page they stand for: same url, else the first page above it, else an error.

    `pages`: (index_url, position). A url's parent folders are its possible pages, so this is an equi join.
    """
    trim = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "/+$", "")
    keyed = sources.withColumn("_url", trim(F.col(url)))
    known = pages.withColumn("_page", trim(F.col(index)))
    parts = F.split("_url", "/")
    parents = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    candidates = (keyed.select("_url").distinct()
                  .select("_url", F.explode(parents).alias("_page")).join(known, "_page"))
    best = candidates.groupBy("_url").agg(F.min_by(
        F.col(index), F.struct((F.col("_page") != F.col("_url")).alias("below"), F.col("position").alias("at"))
    ).alias(index))
    return keyed.join(best, "_url", "left").drop("_url") \
        .withColumn("error", F.when(F.col(index).isNull(), F.lit("matches no known index page")))
