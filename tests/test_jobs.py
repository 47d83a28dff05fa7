"""Jobs that may run twice, pages that cover everything, plans that stay what they should be."""

from pyspark.sql import functions as F

from vicinage.functions import sql, text as tx
from vicinage.operators import filters, ranking
from vicinage.plans import quality
from vicinage.plans.checks import feeds, quality as fixtures
from vicinage.plans.views import CENTRE, TODAY
from vicinage.sources import feeds as readers, sinks


def test_second_run_changes_nothing(tables):
    docs = tables.documents.select(F.col("doc_id").alias("id"), F.concat("text", F.lit(" Peep-Show")).alias("text"), F.lit(True).alias("published"))
    jobs = [(fixtures.hinted(tables), quality.reread_age_and_price), (fixtures.padded(tables), quality.clean_texts),
            (docs, lambda df: quality.hide_unsafe(df, F.col("text"), feeds.now()))]
    for rows, job in jobs:
        first = job(rows)
        assert quality.report(first).count() > 0
        assert quality.report(job(quality.apply(first))).count() == 0


def test_upsert_twice_writes_nothing(spark):
    batch = spark.createDataFrame([("a", 1, "new"), ("b", 2, "new")], "id string, n int, created_at string")
    target = batch.filter("id = 'a'").withColumn("created_at", F.lit("old"))
    once = sinks.upsert(target, batch, "id", order=["n"]).drop("_written")
    again = sinks.upsert(once, batch, "id", order=["n"]).orderBy("id").collect()
    assert [(r.id, r.created_at, r._written) for r in again] == [("a", "old", False), ("b", "new", False)]


def test_pages_neither_repeat_nor_drop(tables):
    hits = filters.filter_listings(tables.listings, today=TODAY, upcoming=True, category=["Water"]).cache()
    n, seen = hits.count(), []
    for skip in range(0, n, 60):
        rows, _ = ranking.page(hits, ranking.relevance_keys(TODAY), skip, 60)
        seen += [r.id for r in rows.select("id").collect()]
    assert len(seen) == n == len(set(seen))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_list_filters_reach_the_scan(spark, tables, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    path = str(tmp_path / "listings")
    sinks.write_snapshot(tables.listings, path)
    shown = plan(filters.summary(filters.filter_listings(
        spark.read.parquet(path), today=TODAY, canton="NATION_3", near=CENTRE, radius_km=10)))
    for pushed in ("EqualTo(canton,NATION_3)", "GreaterThanOrEqual(lat", "LessThanOrEqual(lng"):
        assert pushed in shown
    assert "description" not in shown.split("ReadSchema")[1]


def test_first_per_key_is_limited_before_the_shuffle(tables):
    shown = plan(ranking.first_per(tables.listings, ["canton"], ["start_date", "id"]))
    assert "WindowGroupLimit" in shown and "Partial" in shown


def test_sql_functions(spark):
    sql.register(spark)
    row = spark.sql("SELECT haversine_km(49.6, 6.1, 49.7, 6.1) AS km, fold('Péiteng-2') AS f, domain('https://WWW.x.lu/a') AS d, valid_point(0D, 0D) AS v").first()
    assert abs(row.km - 11.119) < 0.01 and (row.f, row.d, row.v) == ("peiteng", "x.lu", False)
    assert spark.sql("SELECT * FROM sitemap_entries('<url><loc>a</loc></url>')").collect() == [("a", "")]
    xml = "<sitemap>\n<loc> b </loc><lastmod>2024</lastmod></sitemap><url><loc></loc></url>"
    ics = "BEGIN:VEVENT\r\nUID:1\r\nDTSTART;VALUE=DATE:20240102\r\nSUMMARY:Long\r\n er\r\nEND:VEVENT\r\nBEGIN:VEVENT\nUID:2\nEND:VEVENT"
    spark.createDataFrame([(xml, ics), (None, None)], "xml string, ics string").createOrReplaceTempView("stored_feeds")
    assert spark.sql("SELECT e.* FROM stored_feeds, LATERAL sitemap_entries(xml) e").collect() == [("b", "2024")]
    found = spark.sql("SELECT v.* FROM stored_feeds, LATERAL vevents(ics) v ORDER BY uid").collect()
    assert found == [("1", "20240102", "Longer"), ("2", None, None)]


def test_mixed_sitemap_keeps_its_pages(spark):
    loc = lambda tag, *us: "".join(f"<{tag}><loc>{u}</loc></{tag}>" for u in us)
    pages = [f"https://x.lu/p{k}" for k in range(40)]
    roots = spark.createDataFrame([("mixed", f"<urlset>{loc('url', *pages, 'https://x.lu/a.xml', 'https://x.lu/gone.xml')}</urlset>"),
                                   ("index", f"<sitemapindex>{loc('sitemap', 'https://x.lu/a.xml', 'https://x.lu/gone.xml')}</sitemapindex>"),
                                   ("lost", f"<sitemapindex>{loc('sitemap', 'https://x.lu/gone.xml')}</sitemapindex>")], "doc_url string, xml string")
    stored = spark.createDataFrame([("https://x.lu/a.xml", f"<urlset>{loc('url', 'https://x.lu/in1', 'https://x.lu/in2')}</urlset>")], "doc_url string, xml string")
    rows = readers.expand_index(readers.sitemap_entries(roots), stored).orderBy("doc_url", "_at", "_pos").collect()
    of = lambda doc: [r.url for r in rows if r.doc_url == doc]
    assert of("mixed") == [*pages, "https://x.lu/in1", "https://x.lu/in2", "https://x.lu/gone.xml"]
    assert of("index") == ["https://x.lu/in1", "https://x.lu/in2"] and of("lost") == ["https://x.lu/gone.xml"]


def test_words_of_a_hot_text_stay_whole(spark):
    """A third of all rows share one title: one of them is kept, and the others fall with it."""
    from vicinage.operators.personal import collapse_similar

    rows = [(i, 1, "Grousst Summerfest" if i % 3 == 0 else f"Eenzel{i:05d}") for i in range(90)]
    df = spark.createDataFrame(rows, "id int, g int, title string")
    kept = sorted(r.id for r in collapse_similar(df, ["g"], ["id"], "title").collect())
    assert kept == [0] + [i for i in range(90) if i % 3]
    assert tx.ACCENTED and len(tx.ACCENTED) == len(tx.PLAIN)


def test_deep_pages_are_walked_without_recursion():
    import json

    import pandas as pd

    from vicinage.sources.feeds import _deep_nodes
    nested = lambda n: '{"item": ' * n + '{"@type": "Event", "name": "x"}' + "}" * n
    batch = pd.DataFrame({"page_id": [1, 2, 3, 4], "block": [0, 0, 0, 0], "json": [nested(60), nested(200_000), "{", "[]"]})
    found = pd.concat(_deep_nodes(["item"])(iter([batch])))
    assert found["page_id"].tolist() == [1] and json.loads(found["json"][0])["name"] == "x"
