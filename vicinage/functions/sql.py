"""The most used functions for SQL users: SQL functions the optimizer inlines, scalar ones and table functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .geo import EARTH_KM
from .text import ACCENTED, PLAIN


def register(spark: SparkSession) -> None:
    """Temporary functions haversine_km, fold, domain, valid_point; table functions sitemap_entries(xml), vevents(ics)."""
    double = lambda *names: ", ".join(f"{n} DOUBLE" for n in names)
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION haversine_km({double('lat1', 'lng1', 'lat2', 'lng2')}) RETURNS DOUBLE RETURN
      {2 * EARTH_KM} * asin(sqrt(least(pow(sin(radians(lat2 - lat1) / 2), 2)
        + pow(sin(radians(lng2 - lng1) / 2), 2) * cos(radians(lat1)) * cos(radians(lat2)), 1.0D)))""")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION fold(name STRING) RETURNS STRING RETURN
      regexp_replace(translate(lower(name), '{ACCENTED}', '{PLAIN}'), '[^a-z]', '')""")
    spark.sql(r"""CREATE OR REPLACE TEMPORARY FUNCTION domain(url STRING) RETURNS STRING RETURN
      regexp_replace(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)), '^www[.]', '')""")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION valid_point({double('lat', 'lng')}) RETURNS BOOLEAN RETURN
      coalesce(lat IS NOT NULL AND lng IS NOT NULL AND NOT (lat = 0 AND lng = 0), false)""")
    inner = lambda tag: rf"trim(regexp_extract(node, '(?is)<{tag}[^>]*>(.*?)</{tag}>', 1))"
    spark.sql(rf"""CREATE OR REPLACE TEMPORARY FUNCTION sitemap_entries(xml STRING) RETURNS TABLE (url STRING, lastmod STRING) RETURN
      SELECT {inner('loc')}, {inner('lastmod')}
      FROM explode(regexp_extract_all(xml, '(?is)<(url|sitemap)>(.*?)</\\1>', 2)) AS t(node) WHERE {inner('loc')} <> ''""")
    stated = lambda name: rf"nullif(trim(regexp_extract(block, '(?m)^{name}(?:;[^:\\n]*)?:(.*)$', 1)), '')"
    spark.sql(rf"""CREATE OR REPLACE TEMPORARY FUNCTION vevents(ics STRING) RETURNS TABLE (uid STRING, start STRING, summary STRING) RETURN
      SELECT {stated('UID')}, {stated('DTSTART')}, {stated('SUMMARY')}
      FROM explode(regexp_extract_all(regexp_replace(replace(ics, '\r\n', '\n'), '\n[ \t]', ''),
        '(?s)BEGIN:VEVENT\\n(.*?)END:VEVENT', 1)) AS t(block)""")
