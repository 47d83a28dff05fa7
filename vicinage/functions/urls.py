"""URL parts and predicates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# URL vocabularies, stock-photo hosts, media suffixes.
SITEMAP_EVENTISH = (
    r"(?iU)/(events?|agenda|manifestations?|veranstaltungen?|programme?|programm"
    r"|expo|expositions?|kalender|calendar|whats?[-_]on"
    r"|actualit(e|é)s?|ateliers?|workshops?"
    r"|concerts?|spectacles?|festivals?|kids?|jeunesse|jeunes|enfants?"
    r"|shows?|[ée]v[eè]nements?|[ée]v[ée]nements?"
    r"|familles?|familien?)([/_-]|$)"
)
ANCHOR_EVENTISH = r"(?iU)/(events?|agenda|manifestations?|veranstaltung(en)?|termine?)/"
DISCOVERY_EVENTISH = r"(?iU)event|agenda|manifestation|veranstalt|actualit|aktuell|kalend|termin"
VENUE_EVENTISH = (
    r"(?iU)event|agenda|manifestation|veranstalt|actualit|aktuell|kalend|termin"
    r"|programm|exposition|ausstellung|activite|activit|atelier|workshop"
    r"|visite|fuehrung|führung|spectacle|concert|konzert|vernissage|whats-?on|was-?ist-?los"
)
NOT_EVENTISH = r"(?iU)photo|galerie|gallery|/tag/|/category/|/author/|\.jpe?g|\.png|feed"
NOT_A_PAGE = r"(?iU)\.(jpe?g|png|gif|webp|svg|pdf|zip|mp4|mp3|ics|xml|json)(\?|$)"
STRONG_SECTION = (
    r"(?iU)/(agenda|events?|[ée]v[ée]nements?|manifestations?|veranstaltungen|programme?"
    r"|expositions?|ausstellungen|kalender|termine)(/|$)"
)
NOT_A_LISTING = r"(?iU)/(shop|boutique|store|channel|video|presse?|press|blog|news|archiv\w*)(/|$)"
SECTION_SEGMENT = r"(?iU)^(events?|agenda|[ée]v[ée]nements?|manifestations?|veranstaltungen|actualites?)$"
STOCK_HOSTS = [
    "images.unsplash.com", "source.unsplash.com", "images.pexels.com", "cdn.pixabay.com",
    "via.placeholder.com", "placehold.co", "picsum.photos",
]
VOCABULARIES = {"sitemap": SITEMAP_EVENTISH, "anchor": ANCHOR_EVENTISH,
                "discovery": DISCOVERY_EVENTISH, "venue": VENUE_EVENTISH}


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), netloc(url))


def domain(url: Column) -> Column:
    """Host in lower case without a leading www."""
    return F.regexp_replace(F.lower(netloc(F.coalesce(url, F.lit("")))), r"^www\.", "")


def rstrip_slash(url: Column) -> Column:
    return F.regexp_replace(url, "/+$", "")


def abs_url(base: Column, href: Column) -> Column:
    """Absolute, protocol-relative and root-relative links; anything else stays as written."""
    return (
        F.when(F.coalesce(href, F.lit("")) == "", F.lit(""))
        .when(href.startswith("http"), href)
        .when(href.startswith("//"), F.concat(F.lit("https:"), href))
        .when(href.startswith("/"), F.concat(origin(base), href))
        .otherwise(href)
    )


def eventish(url: Column, vocabulary: str = "sitemap") -> Column:
    """Does a URL look like an event page? `vocabulary` is a name from VOCABULARIES or a pattern."""
    return url.rlike(VOCABULARIES.get(vocabulary, vocabulary))


def discoverable(url: Column, vocabulary: str = "discovery") -> Column:
    return eventish(url, vocabulary) & ~url.rlike(NOT_EVENTISH)


def has_slug(url: Column) -> Column:
    """Something follows the event section: a single event rather than the section itself."""
    rest = F.regexp_extract(url, ANCHOR_EVENTISH + "(.*)$", 3)
    return url.rlike(ANCHOR_EVENTISH) & (F.length(F.regexp_replace(rest, "^/+|/+$", "")) > 0)


def looks_like_sitemap(url: Column) -> Column:
    return F.lower(url).endswith(".xml") | F.lower(url).contains("sitemap")


def photo_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(F.coalesce(url, F.lit(""))), r"(?i)^https?://([^/]*)", 1))


def is_stock(url: Column, hosts: list[str] = STOCK_HOSTS) -> Column:
    """The image sits on one of the stock hosts or a sub-domain of one."""
    host = photo_host(url)
    hit = host.isin(hosts)
    for name in hosts:
        hit = hit | host.endswith("." + name)
    return hit


def has_own_photo(url: Column, hosts: list[str] = STOCK_HOSTS) -> Column:
    return F.trim(F.coalesce(url, F.lit(""))).rlike("(?i)^https?://") & ~is_stock(url, hosts)


def events_section_url(website: Column, example: Column) -> Column:
    """The listing page: path of the example up to its deepest event-section segment, else /events/."""
    home = F.coalesce(F.nullif(website, F.lit("")), example, F.lit(""))
    host = netloc(home)
    parts = F.filter(F.split(path_of(F.coalesce(example, F.lit(""))), "/"), lambda p: F.length(p) > 0)
    deepest = F.aggregate(
        F.transform(parts, lambda p, i: F.when(p.rlike(SECTION_SEGMENT), i + 1).otherwise(0)),
        F.lit(0), lambda acc, v: F.greatest(acc, v))
    section = F.array_join(F.slice(parts, F.lit(1), deepest), "/")
    return F.concat(F.lit("https://"), host, F.lit("/"),
                    F.when(deepest > 0, section).otherwise(F.lit("events")), F.lit("/"))


def map_embed_point(html: Column, box: tuple[float, float, float, float]) -> Column:
    """struct(lat, lng) of the first map embed whose marker, else viewport, lies in the box."""
    from .geo import in_box
    from .text import unescape_html

    links = F.regexp_extract_all(html, F.lit(r"(?i)google\.com/maps/embed[^\"'\s>]*"), F.lit(0))

    def pair(link: Column, key: str) -> Column:
        plain = F.coalesce(F.try_url_decode(unescape_html(link)), link)
        form = rf"[?&]{key}=(-?\d+\.\d+)\s*,\s*(-?\d+\.\d+)"
        return F.struct(F.regexp_extract(plain, form, 1).try_cast("double").alias("lat"),
                        F.regexp_extract(plain, form, 2).try_cast("double").alias("lng"))

    found = F.flatten(F.transform(links, lambda link: F.array(pair(link, "q"), pair(link, "center"))))
    return F.get(F.filter(found, lambda p: F.coalesce(in_box(p["lat"], p["lng"], box), F.lit(False))), 0)
