"""What a site publishes, from stored robots files, sitemaps and pages: one evidence row per site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import urls
from ..operators.ranking import first_per, url_rank
from ..session import cut
from ..sources import feeds

# Paths tried without a sitemap, the marker of event data.
FALLBACK_PATHS = ["/agenda", "/events", "/evenements", "/manifestations", "/veranstaltungen", "/actualites",
                  "/aktuelles", "/kalender"]
EVENT_MARKUP = r"(?i)\"@type\"\s*:\s*\"?\[?\s*\"?Event"


def robots_rules(robots: Column, path: Column) -> Column:
    """struct(allowed, delay) for any crawler: the first rule of the general group that fits the path decides."""
    lines = F.filter(F.transform(F.split(F.coalesce(robots, F.lit("")), r"\r\n|\r|\n"), lambda x: F.trim(
        F.regexp_replace(x, "#.*$", ""))), lambda x: x.rlike(r"(?i)^(user-agent|allow|disallow|crawl-delay)\s*:"))
    parsed = F.transform(lines, lambda x: F.struct(
        F.lower(F.trim(F.substring_index(x, ":", 1))).alias("key"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value")))
    state = F.struct(F.lit(False).alias("general"), F.lit(False).alias("naming"), F.lit(None).cast("boolean").alias("allowed"),
                     F.lit(None).cast("string").alias("delay"))

    def step(s: Column, rule: Column) -> Column:
        naming = rule["key"] == "user-agent"
        star = rule["value"] == "*"
        general = F.when(naming, F.when(s["naming"], s["general"] | star).otherwise(star)).otherwise(s["general"])
        fits = s["general"] & rule["key"].isin("allow", "disallow") & path.startswith(rule["value"])
        verdict = (rule["key"] == "allow") | (rule["value"] == "")
        return F.struct(
            general.alias("general"), naming.alias("naming"),
            F.coalesce(s["allowed"], F.when(fits & ~naming, verdict)).alias("allowed"),
            F.coalesce(s["delay"], F.when(s["general"] & (rule["key"] == "crawl-delay"), rule["value"])).alias("delay"))

    end = F.aggregate(parsed, state, step)
    return F.struct(F.coalesce(end["allowed"], F.lit(True)).alias("allowed"), F.coalesce(end["delay"], F.lit("")).alias("delay"))


def site_evidence(sites: DataFrame, robots: DataFrame, sitemaps: DataFrame, pages: DataFrame,
                  vocabulary: str = "discovery") -> DataFrame:
    """One row per site (name, website) in the shape of the discovery result.

    `robots`: (host, robots); `sitemaps`: (doc_url, xml); `pages`: (url, html).
    """
    w = F.col("website")
    origin = F.concat(F.coalesce(F.nullif(urls.scheme(w), F.lit("")), F.lit("https")), F.lit("://"), urls.netloc(w))
    path = F.coalesce(F.nullif(urls.path_of(w), F.lit("")), F.lit("/"))
    # Sites, parsed sitemaps and the candidates are each used several times: written once, read back.
    base = cut(sites.withColumns({"_host": urls.netloc(w), "_origin": origin}).join(
        robots.withColumnRenamed("host", "_host"), "_host", "left").withColumn("_rules", robots_rules(F.col("robots"), path)))
    open_ = base.filter((F.col("_host") != "") & F.col("_rules.allowed"))

    # The first declared sitemap that lists something, else the usual place.
    declared = feeds.robots_sitemaps(open_.select(F.col("_host").alias("host"), "robots")).select(
        F.col("host").alias("_host"), "position", "sitemap")
    usual = open_.join(declared.select("_host").distinct(), "_host", "left_anti").select(
        "_host", F.lit(0).alias("position"), F.concat("_origin", F.lit("/sitemap.xml")).alias("sitemap"))
    wanted = declared.unionByName(usual).distinct()
    is_index = F.col("xml").rlike("(?i)<sitemapindex").alias("_index")
    entries = feeds.sitemap_entries(sitemaps.select("doc_url", is_index, "xml"))
    child = urls.path_of(F.lower("url")).rlike(r"\.xml(\.gz)?$")
    own = cut(entries.select(F.col("doc_url").alias("sitemap"), "url", child.alias("_nested"), "_index"))
    nested = (own.filter("_nested")
              .filter(F.col("_index") | urls.discoverable(F.col("url"), vocabulary))
              .select("sitemap", F.col("url").alias("_child"))
              .join(own.filter(~F.col("_nested")).select(F.col("sitemap").alias("_child"), "url"), "_child").select("sitemap", "url"))
    listed = own.filter(~F.col("_nested")).select("sitemap", "url").unionByName(nested)
    all_ = cut(wanted.join(listed, "sitemap"))
    first = all_.groupBy("_host").agg(F.min_by("sitemap", "position").alias("sitemap"))
    used = all_.join(first, ["_host", "sitemap"])
    found = used.filter(urls.discoverable(F.col("url"), vocabulary)).select("_host", "url")

    guesses = F.array(*[F.lit(p) for p in FALLBACK_PATHS])
    guessed = (open_.join(first.select("_host"), "_host", "left_anti")
               .select("_host", "_origin", F.posexplode(guesses).alias("_at", "_path"))
               .withColumn("url", F.concat("_origin", "_path")).join(pages.select("url").distinct(), "url"))
    guessed = first_per(guessed, ["_host"], ["_at"]).select("_host", "url", F.lit(True).alias("_guess"))

    candidates = cut(found.withColumn("_guess", F.lit(False)).unionByName(guessed))
    counts = candidates.groupBy("_host").agg(F.count("*").alias("_n"), F.bool_or("_guess").alias("_guess"))
    blocks = F.regexp_extract_all("html", F.lit(feeds.LD_BLOCK), F.lit(1))
    asked = pages.join(candidates.select("url").distinct(), "url", "left_semi")   # only their pages are searched
    marked = asked.select("url", F.exists(blocks, lambda b: b.rlike(EVENT_MARKUP)).alias("_marked")) \
        .groupBy("url").agg(F.bool_or("_marked").alias("_marked"))
    # Every candidate with a stored page is judged; the best marked one is the example, else the best of all.
    judged = candidates.select("_host", "url").join(marked, "url", "left").withColumn("_marked", F.coalesce("_marked", F.lit(False)))
    example = judged.groupBy("_host").agg(
        F.min_by("url", F.struct((~F.col("_marked")).alias("m"), url_rank(F.col("url")).alias("r"))).alias("_example"),
        F.bool_or("_marked").alias("_marked"))

    out = base.join(first, "_host", "left").join(counts, "_host", "left").join(example, "_host", "left")
    broken, shut = F.col("_host") == "", ~F.col("_rules.allowed")
    going = ~(broken | shut)
    when_open = lambda c, other="": F.when(going, c).otherwise(F.lit(other))
    n = F.coalesce("_n", F.lit(0))
    return out.select(
        F.when(broken, "FEHLER").when(shut, "GESPERRT").when(n > 0, "KANDIDAT").otherwise("NICHTS GEFUNDEN").alias("Status"),
        F.col("name").alias("Gemeinde"), F.col("website").alias("Website"),
        F.when(broken, "").when(shut, "verbietet").otherwise("erlaubt").alias("robots"),
        when_open(F.col("_rules.delay")).alias("Crawl-Delay"), when_open(F.coalesce("sitemap", F.lit(""))).alias("Sitemap"),
        when_open(n.cast("string")).alias("Veranstaltungsseiten"), when_open(F.coalesce("_example", F.lit(""))).alias("Beispiel-URL"),
        F.when(going & (n > 0), F.when(F.col("_marked"), "ja").otherwise("nein")).otherwise("").alias("JSON-LD"),
        F.when(broken, "unbrauchbare Adresse").when(shut, "robots.txt untersagt das Crawlen")
        .when(F.coalesce("_guess", F.lit(False)), "keine Sitemap, Pfad geraten").otherwise("").alias("Hinweis"))
