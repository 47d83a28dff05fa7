"""Cleaning, folding and localising text, as Column expressions."""

from __future__ import annotations

import html
import json
import unicodedata

from pyspark.sql import Column, functions as F

# What counts as padding, page-builder markup and a site's own signature.
PADDING = "[\\s\\u00a0\\u200b\\ufeff]+"
BUILDER_TAGS = (
    r"(?i)\[/?(?:et_pb_|vc_|fusion_|av_|dt_|mk_)[a-z0-9_]*(?:\s[^\]]*)?\]"
    r"|\[/?(?:caption|gallery|embed|audio|video|playlist|vc_row|vc_column)(?:\s[^\]]*)?\]"
)
MUNICIPAL_TAIL = (
    r"(?iU)\s*[-–—|]\s*(?:(?:administration\s+)?commune\s+de\s+[\w'’\- ]+"
    r"|ville\s+d[eu]\s*[\w'’\- ]*|gemeng\s+[\w'’\- ]+|stad\s+[\w'’\- ]+)\s*$"
)
SECTION_TITLE = (
    r"(?iU)^(?:archives?(?:\s+des?)?\s+)?(?:actualit[ée]s?|news|agenda|archives?|"
    r"veranstaltungen|manifestations|events?)\s*$"
)
TOWN_SUFFIX = r"(?iU)[\s,-]*(stadt|city|ville|stad|centre|zentrum)\s*$"
CANTON_PREFIX = "^(Canton|Kanton) "
SEPARATORS = "-–—|"


def _accent_pairs() -> tuple[str, str]:
    """Every accented Latin letter and the plain letter under it, by Unicode decomposition."""
    source, plain = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = [c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)]
        if len(base) == 1 and base[0] != chr(code) and base[0].isascii():
            source.append(chr(code))
            plain.append(base[0])
    return "".join(source), "".join(plain)


ACCENTED, PLAIN = _accent_pairs()


def strip_accents(c: Column) -> Column:
    return F.translate(c, ACCENTED, PLAIN)


def normalise_text(c: Column) -> Column:
    """Runs of padding (incl. nbsp, zero-width, BOM) become one space; the ends are trimmed."""
    return F.trim(F.regexp_replace(c, PADDING, " "))


def strip_page_builder(c: Column) -> Column:
    """Page-builder shortcodes out, the text they wrap stays."""
    stripped = F.trim(F.regexp_replace(F.regexp_replace(c, BUILDER_TAGS, " "), r"\s{2,}", " "))
    return F.when(c.contains("["), stripped).otherwise(c)


def site_identity(source_name: Column) -> Column:
    """What a source signs its pages with: its name up to a spaced dash or a bracket."""
    head = F.trim(F.element_at(F.split(source_name, r"\s[—–-]\s|\s\(", 2), 1))
    return F.nullif(head, F.lit(""))


def strip_site_tail(title: Column, site: Column | None = None) -> Column:
    """Remove a municipal signature, then exactly `site`, from the end; never empties a title."""
    whole = F.trim(F.coalesce(title, F.lit("")))
    cut_one = F.trim(F.regexp_replace(whole, MUNICIPAL_TAIL, ""))
    if site is None:
        result = cut_one
    else:
        # Column-valued tail: compared as text, so no pattern is built per row.
        name = F.lower(F.trim(site))
        head = F.rtrim(F.substring(cut_one, F.lit(1), F.length(cut_one) - F.length(name)))
        separator = F.right(head, F.lit(1))
        signed = (
            (F.length(name) > 0)
            & F.lower(cut_one).endswith(name)
            & (F.length(separator) > 0)
            & (F.instr(F.lit(SEPARATORS), separator) > 0)
        )
        bare = F.rtrim(F.substring(head, F.lit(1), F.length(head) - F.lit(1)))
        result = F.when(F.coalesce(signed, F.lit(False)), bare).otherwise(cut_one)
    return F.when(F.length(result) > 0, result).otherwise(whole)


def is_not_an_event(title: Column, site: Column | None = None) -> Column:
    """True for the title of a website section rather than of something happening."""
    return strip_site_tail(title, site).rlike(SECTION_TITLE)


def clean_location(c: Column) -> Column:
    """A labelled field: the text after the last bar."""
    return F.trim(F.substring_index(c, "|", -1))


def fold(c: Column) -> Column:
    """Comparable name: lower case, no accents, letters only."""
    return F.regexp_replace(strip_accents(F.lower(c)), "[^a-z]", "")


def slugify(c: Column) -> Column:
    ascii_only = F.regexp_replace(strip_accents(F.coalesce(c, F.lit(""))), "[^\\x00-\\x7F]", "")
    slug = F.lower(F.regexp_replace(F.regexp_replace(ascii_only, "[^A-Za-z0-9]+", "-"), "^-+|-+$", ""))
    return F.when(F.length(slug) > 0, slug).otherwise(F.lit("poi"))


def localized(c: Column) -> Column:
    """One text for all three stored languages."""
    return F.struct(*[c.alias(lang) for lang in ("en", "de", "fr")])


def some_text(c: Column) -> Column:
    """The text, or null when it is empty."""
    return F.nullif(c, F.lit(""))


def pick_lang(field: Column, lang: str, has_lb: bool = False) -> Column:
    """Text in the reader's language: lb falls to de, en; others to en, de; last resort is empty."""
    if lang == "lb":
        chain = (["lb"] if has_lb else []) + ["de", "en"]
    else:
        chain = [lang, "en", "de"]
    return F.coalesce(*[some_text(field[x]) for x in chain], F.lit(""))


def with_lb(field: Column) -> Column:
    """The stored three languages plus a Luxembourgish one borrowed from German, then English."""
    borrowed = F.coalesce(some_text(field["de"]), some_text(field["en"]), F.lit(""))
    return F.struct(borrowed.alias("lb"), *[field[x].alias(x) for x in ("de", "fr", "en")])


def short_text(c: Column, length: int = 120) -> Column:
    return F.substring(c, 1, length)


def strip_town_suffix(c: Column) -> Column:
    """"X-Stadt", "X City" -> "X"."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), TOWN_SUFFIX, ""), "^[ ,-]+|[ ,-]+$", "")


def parse_commune(c: Column) -> Column:
    """The head before a bracket or a slash."""
    return F.trim(F.element_at(F.split(F.coalesce(c, F.lit("")), r"[\(/]", 2), 1))


def normalize_town(c: Column, known: Column) -> Column:
    """The bracketed locality when `known` (a predicate on it) holds, else the head."""
    inner = bracketed(c)
    return (
        F.when(c.contains("(") & c.contains(")"),
               F.when(known, inner).otherwise(F.trim(F.substring_index(c, "(", 1))))
        .otherwise(F.trim(F.substring_index(F.coalesce(c, F.lit("")), "/", 1)))
    )


def bracketed(c: Column) -> Column:
    return F.trim(F.regexp_extract(c, r"\(([^)]+)\)", 1))


def clean_town(c: Column) -> Column:
    """"Town-Stadt (Quarter)" -> "Quarter"; no brackets, no change."""
    town = F.trim(F.coalesce(c, F.lit("")))
    return F.when(town.rlike(r"\([^)]+\)"), bracketed(town)).otherwise(town)


def clean_title(title: Column) -> Column:
    """Venue name without the tail after a spaced dash or bar; German first, then English."""
    text = F.coalesce(some_text(title["de"]), some_text(title["en"]), F.lit(""))
    return F.trim(F.element_at(F.split(text, " [—\\-–|]", 2), 1))


def strip_canton_prefix(c: Column) -> Column:
    """"Canton X" -> "X"; only the first word goes, so "Canton de X" keeps "de X"."""
    return F.trim(F.regexp_replace(c, CANTON_PREFIX, ""))


# Entities: names come from the HTML standard's own table, most frequent first.
_COMMON = ["amp", "lt", "gt", "quot", "apos", "nbsp", "eacute", "egrave", "agrave", "ecirc", "ccedil",
           "uuml", "ouml", "auml", "euml", "ndash", "mdash", "rsquo", "lsquo", "hellip", "euro"]
_NAMED = {n: html.entities.html5[n + ";"] for n in _COMMON}
_NAMED.update({n[:-1]: v for n, v in html.entities.html5.items() if n.endswith(";")})
_BARE = "|".join(sorted((n for n in html.entities.html5 if not n.endswith(";")), key=len, reverse=True))
ENTITY = rf"&(?:#[xX][0-9a-fA-F]+;?|#[0-9]+;?|[A-Za-z][A-Za-z0-9]*;|(?:{_BARE}))"
_CUT = "\x01"
_WINDOWS = {n: html.unescape(f"&#{n};") for n in range(128, 160)}


def _decode_entity(e: Column) -> Column:
    hexed = F.regexp_extract(e, "^&#[xX]([0-9a-fA-F]+)", 1)
    number = F.coalesce(
        F.when(F.length(hexed) > 0, F.conv(hexed, 16, 10).try_cast("bigint")),
        F.regexp_extract(e, "^&#([0-9]+)", 1).try_cast("bigint"),
    )
    names = F.from_json(F.lit(json.dumps(_NAMED)), "map<string,string>")
    windows = F.from_json(F.lit(json.dumps({str(k): v for k, v in _WINDOWS.items()})), "map<string,string>")
    character = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    valid = (number > 0) & (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    by_number = (
        F.when(number.between(128, 159), F.element_at(windows, number.cast("string")))
        .when(valid, character)
        .otherwise(F.lit("�"))
    )
    by_name = F.coalesce(F.element_at(names, F.regexp_extract(e, "^&([A-Za-z0-9]+)", 1)), e)
    return F.when(e.startswith("&#"), by_number).otherwise(by_name)


def unescape_html(c: Column) -> Column:
    """Decode named and numeric HTML entities once, as a browser would."""
    def decoded(text: Column) -> Column:
        # split() compiles a long pattern for every row, a single sign it needs no pattern for
        cut = F.lit(_CUT)
        pieces = F.when(text.contains(cut), F.split(text, ENTITY, -1)).otherwise(F.split(F.regexp_replace(text, F.lit(ENTITY), cut), _CUT, -1))
        found = F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))
        joined = F.array_join(
            F.zip_with(pieces, F.transform(found, _decode_entity),
                       lambda piece, mark: F.concat(F.coalesce(piece, F.lit("")), F.coalesce(mark, F.lit("")))), "")
        return F.when(text.contains("&"), joined).otherwise(text)

    return F.get(F.transform(F.array(c), decoded), 0)       # however often the text is used, it is made once


def tokens(c: Column, min_length: int = 4) -> Column:
    """Comparable words: accent-free, lower case, `min_length` letters or digits and up."""
    words = F.split(strip_accents(F.lower(c)), "[^a-z0-9]+")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= min_length))


def shares_token(a: Column, b: Column) -> Column:
    """Does an answer echo at least one word of the question?"""
    return F.coalesce(F.arrays_overlap(tokens(a), tokens(b)), F.lit(False))


def int32_hash(c: Column) -> Column:
    """Stable non-negative integer of an id: 31-polynomial over code units, wrapped to 32 bits."""
    chars = F.filter(F.split(c, ""), lambda ch: F.length(ch) > 0)
    wrap = lambda v: F.pmod(v + F.lit(2147483648), F.lit(4294967296)) - F.lit(2147483648)
    return F.abs(F.aggregate(chars, F.lit(0).cast("bigint"),
                             lambda acc, ch: wrap(acc * 31 + F.ascii(ch))))


def hash_client(client: Column, salt: str) -> Column:
    """Salted, truncated SHA-256: enough to tell clients apart, not to name one."""
    return F.substring(F.sha2(F.concat_ws(":", F.lit(salt), client.cast("string")), 256), 1, 16)
