"""Stored feed payloads to candidate listings.

Readers give the same candidate columns; `kinds` puts them behind one signature.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config.regions import DEFAULT_TOWN, SOURCE_CENTRE
from ..functions import dates, text as tx, urls
from ..functions.dates import let
from ..operators.filters import day
from ..operators.ranking import first_per
from ..session import with_once

CANDIDATE = ["source_id", "external_id", "title", "description", "start_date", "end_date", "time", "town",
             "lat", "lng", "image"]


def with_source_defaults(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with their source's defaults; sources are one row per id."""
    return rows.join(sources, "source_id", "left")


def _text(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


# --- open-data JSON ---------------------------------------------------------------------------

# The field names portals use, best first.
JSON_FIELDS = {
    "external_id": ["id", "uid", "_id"], "title": ["title", "name", "nom"],
    "description": ["description", "description_long"],
    "start": ["start", "start_date", "date", "date_debut"], "end": ["end", "end_date", "date_fin"],
    "time": ["time", "heure"], "lat": ["lat", "latitude"], "lng": ["lng", "lon", "longitude"],
    "town": ["town", "ville", "commune"], "image": ["image", "photo"],
}


def from_open_data_json(payloads: DataFrame, sources: DataFrame, today) -> DataFrame:
    """Portal resources: a list, or records under result.records or records.

    `payloads`: (source_id, payload). Records without an id or a readable start are no listings.
    """
    record = "map<string,string>"
    p = F.col("payload")
    wrapped = F.from_json(p, f"result struct<records:array<{record}>>, records array<{record}>")
    inner = lambda c: F.when(F.size(c) > 0, c)
    rows = F.when(F.ltrim(p).startswith("["), F.from_json(p, f"array<{record}>")).otherwise(let(
        wrapped, lambda w: F.coalesce(inner(w["result"]["records"]), inner(w["records"]))))
    t = day(today)
    told = lambda name: F.coalesce(*[_text(F.try_element_at("r", F.lit(k))) for k in JSON_FIELDS[name]])
    # made once is what decides whether a record stays; all else is read of those that do
    records = with_once(payloads.select("source_id", F.explode(rows).alias("r")), external_id=told("external_id"), _start=told("start"))
    records = with_once(records.filter(F.col("external_id").isNotNull()), start_date=dates.to_iso_date(F.col("_start"), t))
    stated = told
    r = with_source_defaults(records.filter(F.col("start_date").isNotNull()), sources)
    number = lambda name: F.nullif(stated(name).try_cast("double"), F.lit(0.0))
    unreadable = (stated("lat").isNotNull() & stated("lat").try_cast("double").isNull()) \
        | (stated("lng").isNotNull() & stated("lng").try_cast("double").isNull())
    at = lambda name, default, centre: F.when(unreadable, F.lit(centre)).otherwise(
        F.coalesce(number(name), F.col(default), F.lit(centre)))
    title = F.coalesce(stated("title"), F.lit("Event"))
    return r.select(
        "source_id", "external_id", title.alias("title"),
        F.coalesce(stated("description"), title).alias("description"),
        "start_date", dates.to_iso_date(stated("end"), t).alias("end_date"), F.coalesce(stated("time"), F.lit("")).alias("time"),
        F.coalesce(stated("town"), _text(F.col("town_default")), F.lit(DEFAULT_TOWN)).alias("town"),
        at("lat", "lat_default", SOURCE_CENTRE[0]).alias("lat"), at("lng", "lng_default", SOURCE_CENTRE[1]).alias("lng"),
        F.coalesce(stated("image"), F.col("image_default"), F.lit("")).alias("image"),
    )


# --- calendars --------------------------------------------------------------------------------

def vevents(payloads: DataFrame) -> DataFrame:
    """(source_id, position, block): folded lines joined, one row per event block."""
    unfolded = F.regexp_replace(F.regexp_replace("payload", "\r\n", "\n"), "\n[ \t]", "")
    blocks = F.regexp_extract_all(unfolded, F.lit(r"(?s)BEGIN:VEVENT\n(.*?)END:VEVENT"), F.lit(1))
    return payloads.select("source_id", F.posexplode(blocks).alias("position", "block"))


def _property(block: Column, name: str) -> Column:
    return _text(F.trim(F.regexp_extract(block, rf"(?m)^{name}(?:;[^:\n]*)?:(.*)$", 1)))


def _plain(c: Column) -> Column:
    """Calendar text without its escapes."""
    lines = F.regexp_replace(c, r"\\[nN]", "\n")
    return F.trim(F.regexp_replace(lines, r"\\([,;\\])", "$1"))


STAMP = r"^(\d{4})(\d{2})(\d{2})(?:T(\d{2})(\d{2}))?"


def from_ical(payloads: DataFrame, sources: DataFrame, today) -> DataFrame:
    """Calendar events with an id and a start; the time label is as written."""
    t = day(today)
    b = F.col("block")

    def stamped(v: Column) -> Column:
        date = F.when(v.rlike(STAMP), F.concat_ws("-", F.substring(v, 1, 4), F.substring(v, 5, 2), F.substring(v, 7, 2)).try_cast("date"))
        return F.when(dates.plausible_year(date, t), date)

    def clock(v: Column) -> Column:
        return F.when(F.regexp_extract(v, STAMP, 4) != "", F.concat_ws(":", F.regexp_extract(v, STAMP, 4), F.regexp_extract(v, STAMP, 5)))

    e = with_once(vevents(payloads), external_id=_property(b, "UID"), _from=_property(b, "DTSTART"))
    e = with_once(e.filter(F.col("external_id").isNotNull()), start_date=stamped(F.col("_from"))).filter(F.col("start_date").isNotNull())
    e = with_source_defaults(e, sources)
    till = _property(b, "DTEND")
    title = F.coalesce(_plain(_property(b, "SUMMARY")), F.lit("Untitled event"))
    return e.select(
        "source_id", "external_id", title.alias("title"),
        F.coalesce(_text(_plain(_property(b, "DESCRIPTION"))), title).alias("description"),
        "start_date", let(till, stamped).alias("end_date"),
        let(F.col("_from"), lambda v: F.when(clock(v).isNull(), F.lit("")).otherwise(F.concat_ws(" - ", clock(v), let(till, clock)))).alias("time"),
        F.coalesce(_text(_plain(_property(b, "LOCATION"))), _text(F.col("town_default")), F.lit(DEFAULT_TOWN)).alias("town"),
        F.coalesce("lat_default", F.lit(SOURCE_CENTRE[0])).alias("lat"),
        F.coalesce("lng_default", F.lit(SOURCE_CENTRE[1])).alias("lng"),
        F.coalesce("image_default", F.lit("")).alias("image"),
    )


# --- JSON-LD ----------------------------------------------------------------------------------

LD_BLOCK = r"(?is)<script[^>]+type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
LD_CHILDREN = ["@graph", "itemListElement", "item", "subEvent", "workPerformed"]
LD_LINK_CHILDREN = LD_CHILDREN[:4]
# Levels read as expressions; pages nested deeper go through `_deep_nodes`.
LD_DEPTH = 4


def _listed(v: Column) -> Column:
    """A node or a list of nodes as a list."""
    none = F.array().cast("array<variant>")
    listed = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), none)
    return F.when(v.isNull(), none).when(F.schema_of_variant(v).startswith("ARRAY"), listed).otherwise(F.array(v))


def _each(values: Column, body) -> Column:
    return F.flatten(F.transform(values, body))


def _flat(v: Column) -> Column:
    """The nodes of a list, lists inside the list opened as well."""
    return _each(_listed(v), _listed)


def _children(node: Column, keys: list[str]) -> Column:
    return F.flatten(F.array(*[_flat(F.try_variant_get(node, f"$['{k}']", "variant")) for k in keys]))


def _is_event(node: Column) -> Column:
    kind = F.coalesce(F.try_variant_get(node, "$['@type']", "variant"), F.try_variant_get(node, "$.type", "variant"))
    names = F.transform(_listed(kind), lambda k: F.coalesce(F.try_variant_get(k, "$", "string"), F.lit("")))
    return F.exists(names, lambda n: n.contains("Event"))


def _deep_nodes(keys: list[str]) -> Callable:
    """Event nodes below the last expressed level, for the few pages nested that deep."""
    def events(block: str) -> list[str]:
        """Events of a block in its order; a node the JSON module finds too deep to read or write is left out."""
        found: list[str] = []
        try:
            todo = [(json.loads(block), 0)]
        except (ValueError, RecursionError):
            return found
        while todo:
            node, depth = todo.pop()
            if isinstance(node, list):
                todo += [(item, depth) for item in reversed(node)]
            elif isinstance(node, dict):
                kind = node.get("@type") or node.get("type")
                names = [kind] if isinstance(kind, str) else kind if isinstance(kind, list) else []
                if depth > LD_DEPTH and any(isinstance(n, str) and "Event" in n for n in names):
                    try:
                        found.append(json.dumps(node, ensure_ascii=False))
                    except RecursionError:
                        pass
                todo += [(node[key], depth + 1) for key in reversed(keys) if key in node]
        return found

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page, block, at in zip(batch["page_id"], batch["json"], batch["block"]):
                rows += [(page, at, LD_DEPTH + 1, n, node) for n, node in enumerate(events(block))]
            yield pd.DataFrame(rows, columns=["page_id", "block", "level", "position", "json"])

    return run


def json_ld_events(pages: DataFrame, keys: list[str] = LD_CHILDREN) -> DataFrame:
    """(page_id, block, level, position, node): every Event node at any depth; broken blocks are skipped."""
    blocks = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(LD_BLOCK), F.lit(1)))
                          .alias("block", "raw"))
    # Wrapped in a list, so text after the first value makes a block unreadable, as it should.
    wrapped = F.try_parse_json(F.concat(F.lit("["), "raw", F.lit("]")))
    parsed = (blocks.withColumn("w", wrapped)
              .filter(F.size(F.try_variant_get("w", "$", "array<variant>")) == 1)
              .withColumn("v", F.try_variant_get("w", "$[0]", "variant")).drop("w", "raw"))
    # Each level is a column of its own, so deeper levels are built from it and not from the page again.
    frame = parsed.withColumn("l0", _flat(F.col("v")))
    for i in range(1, LD_DEPTH + 2):
        frame = frame.withColumn(f"l{i}", _each(F.col(f"l{i - 1}"), lambda n: _children(n, keys)))

    def at_level(i: int) -> Column:
        return F.transform(F.filter(F.col(f"l{i}"), _is_event), lambda n, at: F.struct(
            F.lit(i).alias("level"), at.alias("position"), n.alias("node")))

    tagged = F.flatten(F.array(*[at_level(i) for i in range(LD_DEPTH + 1)]))
    near = frame.select("page_id", "block", F.inline(tagged))
    types = dict(pages.dtypes)
    deep_pages = frame.filter(F.size(f"l{LD_DEPTH + 1}") > 0).select("page_id", "block", F.to_json("v").alias("json"))
    deep = deep_pages.mapInPandas(_deep_nodes(keys), f"page_id {types['page_id']}, block int, level int, position int, json string")
    return near.unionByName(deep.select("page_id", "block", "level", "position", F.try_parse_json("json").alias("node")))


def _ld(node: Column, path: str) -> Column:
    """A text leaf: numbers as text, entities decoded, lists by their first element."""
    at = F.try_variant_get(node, path, "variant")
    first = F.when(F.schema_of_variant(at).startswith("ARRAY"), F.try_variant_get(at, "$[0]", "variant")).otherwise(at)
    return tx.unescape_html(F.try_variant_get(first, "$", "string"))


def from_json_ld(pages: DataFrame, sources: DataFrame, today, nodes: DataFrame | None = None) -> DataFrame:
    """Candidates from Event nodes. `pages`: (page_id, source_id, url, html); `nodes`: their Event nodes, if at hand."""
    t = day(today)
    found = json_ld_events(pages) if nodes is None else nodes
    nodes = found.join(pages.select("page_id", "source_id", "url"), "page_id")
    e = with_source_defaults(nodes, sources)
    n = F.col("node")
    one = lambda v: F.get(_listed(v), 0)
    place = one(F.try_variant_get(n, "$.location", "variant"))
    image = one(F.try_variant_get(n, "$.image", "variant"))
    picture = F.when(F.schema_of_variant(image).startswith("OBJECT"), F.try_variant_get(image, "$.url", "string")) \
        .otherwise(F.try_variant_get(image, "$", "string"))
    start, end = _ld(n, "$.startDate"), _ld(n, "$.endDate")
    clock = lambda c: F.nullif(F.regexp_extract(c, r"T(\d{2}:\d{2})", 1), F.lit(""))
    geo_lat = F.try_variant_get(place, "$.geo.latitude", "double")
    geo_lng = F.try_variant_get(place, "$.geo.longitude", "double")
    rows = with_once(e, _start=start)
    rows = with_once(rows, start_date=dates.to_iso_date(F.col("_start"), t)).filter(F.col("start_date").isNotNull())
    rows = with_once(rows, title=F.coalesce(_text(_ld(n, "$.name")), F.lit("Event"))).withColumns({
        "end_date": dates.to_iso_date(end, t), "_clock": clock(F.col("_start")), "_clock_end": clock(end)})
    fallback_id = F.concat_ws(":", F.col("source_id").cast("string"), F.col("start_date").cast("string"),
                              F.col("title"))
    return rows.select(
        "source_id",
        F.coalesce(_text(_ld(n, "$['@id']")), _text(_ld(n, "$.url")), _text(_ld(n, "$.identifier")), fallback_id).alias("external_id"),
        "title", F.coalesce(_ld(n, "$.description"), F.lit("")).alias("description"), "start_date", "end_date",
        F.when(F.col("_clock").isNull(), F.lit("")).otherwise(F.concat_ws(" - ", "_clock", "_clock_end")).alias("time"),
        F.coalesce(_text(_ld(place, "$.address.addressLocality")), _text(F.col("town_default")), F.lit(DEFAULT_TOWN)).alias("town"),
        F.coalesce(geo_lat, "lat_default", F.lit(SOURCE_CENTRE[0])).alias("lat"),
        F.coalesce(geo_lng, "lng_default", F.lit(SOURCE_CENTRE[1])).alias("lng"),
        urls.abs_url(F.col("url"), tx.unescape_html(picture)).alias("image"),
    )


# --- pages without structured data ------------------------------------------------------------

def raw_meta(html: Column, prop: str) -> Column:
    """Content of a meta tag as written, by property and then by name."""
    def by(attribute: str) -> Column:
        tags = F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0))
        wanted = F.filter(tags, lambda m: m.rlike(rf"(?i)\b{attribute}\s*=\s*[\"']{prop.replace('.', '[.]')}[\"']"))
        content = F.regexp_extract(F.get(wanted, 0), r"(?is)\bcontent\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", 0)
        return F.regexp_replace(content, r"(?is)^content\s*=\s*[\"']|[\"']$", "")
    return F.coalesce(_text(by("property")), _text(by("name")))


def meta(html: Column, prop: str) -> Column:
    return tx.unescape_html(raw_meta(html, prop))


def visible_text(html: Column) -> Column:
    """Text between the tags, scripts and styles left out."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1>|<!--.*?-->", " ")
    return tx.unescape_html(F.regexp_replace(bare, r"(?s)<[^>]*>", " "))


# Meta tags that state a date, best first.
META_DATES = ["event:start_time", "article:published_time", "event:start_date", "startDate"]


def from_open_graph(pages: DataFrame, today) -> DataFrame:
    """(page_id, external_id, title, description, start_date, image) of pages on which a date is found.

    The date comes from the title, the url, a time tag, a meta tag, or the text, in this order.
    """
    t = day(today)
    html = F.col("html")
    heading = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    title = F.trim(tx.unescape_html(F.coalesce(raw_meta(html, "og:title"), heading)))
    times = F.regexp_extract_all(html, F.lit(r"(?is)<time\b[^>]*>.*?</time>"), F.lit(0))

    def of_tag(tag: Column) -> Column:
        attribute = F.regexp_extract(tag, r"(?is)^<time\b[^>]*\bdatetime\s*=\s*[\"']([^\"']*)[\"']", 1)
        return F.coalesce(_text(attribute), F.regexp_replace(tag, r"(?s)<[^>]*>", ""))

    in_text = _text(F.regexp_extract(visible_text(html), dates.TEXT_DATE, 1))
    written = F.concat(F.transform(times, of_tag), F.array(*[raw_meta(html, p) for p in META_DATES], in_text))
    read = F.transform(written, lambda text: dates.to_iso_date(text, t))
    on_page = F.get(F.filter(read, lambda d: d.isNotNull()), 0)
    rows = with_once(pages, title=title).filter(F.coalesce("title", F.lit("")) != "")
    start = F.coalesce(dates.date_from_title(F.col("title"), t), dates.date_from_url(F.col("url")), on_page)
    return with_once(rows, start_date=start).filter(F.col("start_date").isNotNull()).select(
        "page_id", F.col("url").alias("external_id"), "title", F.coalesce(meta(html, "og:description"), F.lit("")).alias("description"),
        "start_date", F.coalesce(meta(html, "og:image"), F.lit("")).alias("image"),
    )


def _element(selector: str) -> str:
    """Pattern of one element for a simple selector: tag, .class or tag.class (elements not nested in themselves)."""
    name, _, cls = selector.partition(".")
    tag = name or r"[a-zA-Z][a-zA-Z0-9]*"
    attribute = rf"(?=[^>]*\bclass\s*=\s*[\"'][^\"']*(?<![\w-]){cls}(?![\w-])[^\"']*[\"'])" if cls else ""
    return rf"(?is)<({tag})\b{attribute}[^>]*+(?:(?<=/)>|>.*?</\1\s*>)" if name not in ("img", "meta", "link", "br") \
        else rf"(?is)<({tag})\b{attribute}[^>]*>"


def select_all(html: Column, selector: str) -> Column:
    """Elements a descendant selector ("li a", ".card h3") names, in order."""
    found = F.regexp_extract_all(html, F.lit(_element(selector.split()[0])), F.lit(0))
    for step in selector.split()[1:]:
        inside = F.transform(found, lambda h: F.regexp_replace(h, r"(?is)\A\s*<[^>]*>", ""))
        pattern = F.lit(_element(step))
        found = F.flatten(F.transform(inside, lambda h: F.regexp_extract_all(h, pattern, F.lit(0))))
    return found


def select_first(html: Column, selector: str) -> Column:
    """The first of `select_all`, for a single step without a search for the others."""
    if len(selector.split()) > 1:
        return F.get(select_all(html, selector), 0)
    return _text(F.regexp_extract(html, _element(selector), 0))


def select_text(html: Column, selector: str) -> Column:
    hit = select_first(html, selector)
    return F.trim(F.regexp_replace(tx.unescape_html(F.regexp_replace(hit, r"(?s)<[^>]*>", " ")), r"\s+", " "))


def select_attr(html: Column, selector: str, name: str) -> Column:
    hit = select_first(html, selector)
    return tx.unescape_html(F.trim(F.regexp_extract(hit, rf"(?is)^<[^>]*\b{name}\s*=\s*[\"']([^\"']*)[\"']", 1)))


def from_listing_blocks(pages: DataFrame, sources: DataFrame, selectors: dict[str, str], today) -> DataFrame:
    """Candidates from repeated blocks of a listing page.

    `selectors`: item, title, date, and optionally date_attr, location, description, image, link.
    """
    t = day(today)
    items = pages.select("page_id", "source_id", "url", F.posexplode(select_all(F.col("html"), selectors["item"]))
                         .alias("position", "item"))
    rows = with_source_defaults(items, sources)
    item = F.col("item")
    pick = lambda name: select_text(item, selectors[name]) if name in selectors else F.lit("")
    raw_date = select_attr(item, selectors["date"], selectors["date_attr"]) if "date_attr" in selectors else pick("date")
    attr = lambda name, a: F.coalesce(select_attr(item, selectors[name], a), F.lit("")) if name in selectors else F.lit("")
    rows = with_once(rows, title=pick("title"), _day=raw_date).filter(F.coalesce("title", F.lit("")) != "")
    rows = with_once(rows, start_date=dates.to_iso_date(F.col("_day"), t)).filter(F.col("start_date").isNotNull())
    rows = with_once(rows, _link=attr("link", "href"))
    made_id = F.concat_ws(":", F.col("source_id").cast("string"), F.col("start_date").cast("string"), F.col("title"))
    return rows.select(
        "source_id", F.coalesce(_text(F.col("_link")), made_id).alias("external_id"), "title",
        F.coalesce(_text(pick("description")), F.col("title")).alias("description"), "start_date",
        F.lit(None).cast("date").alias("end_date"), F.lit("").alias("time"),
        F.coalesce(_text(tx.clean_location(pick("location"))), _text(F.col("town_default")), F.lit(DEFAULT_TOWN)).alias("town"),
        F.coalesce("lat_default", F.lit(SOURCE_CENTRE[0])).alias("lat"),
        F.coalesce("lng_default", F.lit(SOURCE_CENTRE[1])).alias("lng"),
        F.coalesce(_text(let(attr("image", "src"), lambda v: urls.abs_url(F.col("url"), v))), F.col("image_default"), F.lit("")).alias("image"),
        "page_id", "position",
    )


# --- sitemaps, robots, links ------------------------------------------------------------------

def sitemap_entries(docs: DataFrame) -> DataFrame:
    """(doc_url, in_index, position, url, lastmod) of url and sitemap nodes; bare locations when there are none."""
    nodes = F.regexp_extract_all("xml", F.lit(r"(?is)<(url|sitemap)>(.*?)</\1>"), F.lit(2))
    bare = F.regexp_extract_all("xml", F.lit(r"(?is)<loc[^>]*>.*?</loc>"), F.lit(0))
    inner = lambda node, tag: F.trim(F.regexp_replace(
        F.regexp_extract(node, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1), r"(?s)^\s*<!\[CDATA\[|\]\]>\s*$", ""))
    entry = lambda list_: F.filter(F.transform(list_, lambda n: F.struct(
        inner(n, "loc").alias("url"), inner(n, "lastmod").alias("lastmod"))), lambda e: F.length(e["url"]) > 0)
    chosen = docs.withColumn("in_index", F.col("xml").rlike("(?i)<sitemapindex")).withColumn("_e", entry(nodes))
    chosen = chosen.withColumn("_e", F.when(F.size("_e") > 0, F.col("_e")).otherwise(entry(bare)))
    keep = [c for c in docs.columns if c != "xml"]
    return chosen.select(*keep, "in_index", F.posexplode("_e").alias("position", "_x")).select(
        *keep, "in_index", "position", tx.unescape_html(F.trim("_x.url")).alias("url"), F.col("_x.lastmod").alias("lastmod"))


def expand_index(entries: DataFrame, docs: DataFrame) -> DataFrame:
    """Entries that name stored sitemaps are replaced by what those hold; one level deep.

    Of a <sitemapindex> the whole list is replaced, once something is found; a <urlset> keeps its other entries.
    `entries`: of the root documents (doc_url, in_index, ...); `docs`: all stored documents (doc_url, xml).
    """
    nested = (entries.filter(urls.looks_like_sitemap(F.col("url")))
              .select("doc_url", F.col("position").alias("_at"), F.col("url").alias("_child")))
    inside = sitemap_entries(docs).withColumnsRenamed({"doc_url": "_child", "position": "_pos"})
    found = nested.join(inside, "_child").select("doc_url", "_at", "_pos", "url", "lastmod")
    opened = found.select("doc_url", F.col("_at").alias("position")).distinct()
    whole = opened.select(F.col("doc_url").alias("_whole")).distinct()
    kept = entries.join(opened, ["doc_url", "position"], "left_anti")
    kept = kept.join(whole, F.col("in_index") & (F.col("doc_url") == F.col("_whole")), "left_anti").select(
        "doc_url", F.col("position").alias("_at"), F.lit(0).alias("_pos"), "url", "lastmod")
    return kept.unionByName(found)


def robots_sitemaps(docs: DataFrame) -> DataFrame:
    """(host, position, sitemap): declared sitemaps in order."""
    lines = F.regexp_extract_all("robots", F.lit(r"(?im)^[ \t]*sitemap:[ \t]*(\S[^\r\n]*)"), F.lit(1))
    return docs.select("host", F.posexplode(F.transform(lines, lambda s: F.trim(s))).alias("position", "sitemap"))


HREF = r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"']"


def hrefs(html: Column) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit(HREF), F.lit(1)), lambda h: tx.unescape_html(h))


def event_links(pages: DataFrame) -> DataFrame:
    """(page_id, rank, url): Event-node urls of a page, else its event-like anchors.

    Media files and the page itself are left out, repeats keep their first place, single events
    come before sections.
    """
    nodes = json_ld_events(pages, LD_LINK_CHILDREN)
    own = F.coalesce(_text(F.try_variant_get("node", "$.url", "string")), F.try_variant_get("node", "$['@id']", "string"))
    stated = nodes.select("page_id", own.alias("url"), F.struct("block", "level", "position").alias("at")) \
        .filter(F.col("url").startswith("http"))
    with_nodes = stated.select("page_id").distinct()
    anchors = pages.join(with_nodes, "page_id", "left_anti").select(
        "page_id", F.col("url").alias("base"), F.posexplode(hrefs(F.col("html"))).alias("position", "href"))
    listed = anchors.filter(urls.eventish(F.col("href"), "anchor")).select(
        "page_id", urls.abs_url(F.col("base"), F.col("href")).alias("url"),
        F.struct(F.lit(0).alias("block"), F.lit(0).alias("level"), "position").alias("at"))
    base = pages.select("page_id", urls.rstrip_slash(F.col("url")).alias("base"))
    all_ = stated.unionByName(listed).join(base, "page_id").filter(
        (F.col("url") != "") & ~F.col("url").rlike(urls.NOT_A_PAGE) & (urls.rstrip_slash(F.col("url")) != F.col("base")))
    once = first_per(all_, ["page_id", "url"], ["at"])
    order = Window.partitionBy("page_id").orderBy(urls.has_slug(F.col("url")).desc(), "at")
    return once.select("page_id", F.row_number().over(order).alias("rank"), "url")


def detail_links(pages: DataFrame, parent_path: str) -> DataFrame:
    """(page_id, url): distinct links exactly one segment below a path of the page's own host, sorted."""
    rows = pages.select("page_id", F.col("url").alias("base"), F.explode(hrefs(F.col("html"))).alias("href"))
    full = rows.withColumn("link", urls.abs_url(F.col("base"), F.col("href")))
    host = urls.netloc(F.col("link"))
    same = (host == "") | (host == urls.netloc(F.col("base")))
    path = F.regexp_replace(urls.path_of(F.col("link")), "^(?!/)", "/")
    rest = F.regexp_replace(F.substr(path, F.lit(len(parent_path) + 1)), "^/+|/+$", "")
    kept = full.filter(same & path.startswith(parent_path) & (rest != "") & (rest != "-") & ~rest.contains("/"))
    return kept.select("page_id", F.concat(urls.origin(F.col("base")), F.lit(parent_path), rest, F.lit("/")).alias("url")) \
        .distinct().orderBy("page_id", "url")


# Where a page keeps its picture, best first; what counts as event-like in a probe.
IMAGE_META = ["og:image:secure_url", "og:image", "twitter:image:src", "twitter:image"]
IMAGE_LINKS = ["apple-touch-icon", "apple-touch-icon-precomposed", "icon", "shortcut icon"]
PROBE_ANCHORS = r"(?i)/event|/agenda|/manifestation|/veranstaltung|/expositions/"


def page_image(pages: DataFrame) -> DataFrame:
    """(page_id, image): the best picture of a page, absolute; null without one."""
    html = F.col("html")
    links = F.regexp_extract_all(html, F.lit(r"(?is)<link\b[^>]*>"), F.lit(0))
    by_rel = lambda rel: _text(F.regexp_extract(F.get(F.filter(links, lambda tag: tag.rlike(
        rf"(?i)\brel\s*=\s*[\"']{rel}[\"']")), 0), r"(?is)\bhref\s*=\s*[\"']([^\"']*)[\"']", 1))
    best = F.coalesce(*[_text(F.trim(raw_meta(html, m))) for m in IMAGE_META], *[by_rel(r) for r in IMAGE_LINKS])
    found = pages.select("page_id", "url", tx.unescape_html(best).alias("_best"))
    return found.select("page_id", F.when(F.col("_best").isNotNull(), urls.abs_url(F.col("url"), F.col("_best"))).alias("image"))


def probe_pages(pages: DataFrame) -> DataFrame:
    """What a page publishes: structured blocks, Event nodes, feeds, calendars, event-like anchors."""
    html = F.col("html")
    events = json_ld_events(pages).groupBy("page_id").agg(F.count("*").alias("jsonld_events"))
    links = F.regexp_extract_all(html, F.lit(r"(?is)<link\b[^>]*>"), F.lit(0))
    count = lambda list_, test: F.size(F.filter(list_, test))
    facts = pages.select(
        "page_id", F.size(F.regexp_extract_all(html, F.lit(LD_BLOCK), F.lit(1))).alias("jsonld_blocks"),
        count(links, lambda tag: tag.rlike(r"(?i)\btype\s*=\s*[\"'][^\"']*(rss|atom)")).alias("rss_links"),
        count(hrefs(html), lambda h: F.lower(h).contains(".ics") | F.lower(h).contains("webcal://")).alias("ical_links"),
        count(hrefs(html), lambda h: h.rlike(PROBE_ANCHORS)).alias("event_anchors"))
    return facts.join(events, "page_id", "left").withColumn("jsonld_events", F.coalesce("jsonld_events", F.lit(0)))

