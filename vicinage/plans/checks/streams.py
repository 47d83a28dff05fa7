"""Streams run to the end of their input, compared with the same question asked of the table."""

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from ...session import fresh_path
from ...sources import feeds
from ...streaming import grants, harvest, views
from ..views import TODAY
from .base import check
from .feeds import now, json_payloads, sources
from .towns import addresses, place_rows

TS = "yyyy-MM-dd HH:mm:ss"
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(t):
    """The events file as a stream."""
    return t.spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(t.folder)


def pings(t):
    """Each event twice, ten seconds apart, as view pings."""
    twice = F.explode(F.array(F.lit(0), F.lit(10)))
    e = event_stream(t).select((F.col("event_id") % 500).alias("listing_id"), F.col("user_id").alias("client"),
                               F.col("ts").cast("timestamp").alias("ts"), twice.alias("later"))
    return e.withColumn("ts", F.col("ts") + F.make_dt_interval(secs=F.col("later"))).drop("later")


def finish(t, rows, label):
    """Run a stream into a new table and read it back."""
    out = fresh_path(t.spark, label)
    writer = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", fresh_path(t.spark, "state"))
    views.run_to_end(writer)
    return t.spark.read.schema(rows.schema).parquet(out)


@check("t01_dedupe_pings", """
SELECT DISTINCT listing_id, substr(sha256('s:' || CAST(user_id AS VARCHAR)), 1, 16) AS client, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS minute FROM pings_v""")
def dedupe(t):
    rows = finish(t, views.dedupe_pings(pings(t), "s"), "pings")
    return rows.select("listing_id", "client", F.date_format("minute", TS).alias("minute"))


@check("t02_view_counters", """
SELECT listing_id, count(*) AS views FROM (SELECT DISTINCT listing_id, user_id, date_trunc('minute', ts) AS minute FROM pings_v)
WHERE listing_id IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0) GROUP BY listing_id""")
def counters(t):
    known = t.orders.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"))
    rows = views.known_pings(views.dedupe_pings(pings(t), "s"), known)
    out = fresh_path(t.spark, "counts")
    views.run_to_end(views.count_views(rows, out, fresh_path(t.spark, "state")))
    return views.current_counts(t.spark.read.parquet(out))


STATS = """SELECT date_trunc('minute', ts) AS s, listing_id, count(*) AS n FROM pings_v GROUP BY s, listing_id"""


@check("t03_view_statistics", f"""
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, listing_id, n FROM ({STATS}) WHERE s + INTERVAL 1 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) FROM pings_v) - INTERVAL 1 HOUR""")
def statistics(t):
    rows = finish(t, views.view_statistics(pings(t)), "stats")
    return rows.select(F.date_format("start", TS).alias("start"), "listing_id", "n")


@check("t03_roll_up_days", """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, listing_id, count(*) AS n FROM pings_v GROUP BY 1, 2""")
def days(t):
    table = t.pings_v.select("listing_id", F.col("ts").cast("timestamp").alias("ts"))
    rows = views.roll_up(views.view_statistics(table), "day")
    return rows.select(F.date_format("start", TS).alias("start"), "listing_id", F.col("n").cast("bigint").alias("n"))


GRANTS = """s AS (SELECT user_id AS listing_id, CAST(ts AS DATE) AS d, CASE event_id % 3 WHEN 0 THEN 30 WHEN 1 THEN 90 ELSE 180 END AS n, ts, event_id
    FROM events WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY event_id % 300 ORDER BY ts, event_id) = 1),
g AS (SELECT listing_id, list({'d': date_diff('day', DATE '1970-01-01', d), 'n': CAST(n AS BIGINT)} ORDER BY ts, event_id) AS l FROM s GROUP BY listing_id),
f AS (SELECT listing_id, list_reduce(l, lambda a, b: {'d': greatest(a.d + a.n, b.d), 'n': b.n}) AS r FROM g)"""


def payments(e):
    k = F.col("event_id")
    plan = F.when(k % 3 == 0, "1month").when(k % 3 == 1, "3months").otherwise("6months")
    return e.filter("event_type = 'purchase'").select((k % 300).alias("session_id"), F.col("user_id").alias("listing_id"), plan.alias("plan"), "ts", "event_id")


@check("t04_featured_until", f"""
WITH {GRANTS} SELECT listing_id, CAST(DATE '1970-01-01' + CAST(r.d + r.n AS INT) AS VARCHAR) AS featured_until FROM f""")
def until(t):
    rows = grants.featured_until(grants.first_sessions(payments(t.events)))
    return rows.select("listing_id", F.col("featured_until").cast("string").alias("featured_until"))


def paid_batches(t):
    """The payments in two files by time, one micro-batch each."""
    parts = fresh_path(t.spark, "payments")
    middle = F.lit("2024-01-16").cast("timestamp_ntz")
    t.events.filter(F.col("ts") < middle).coalesce(1).write.parquet(parts)
    t.events.filter(F.col("ts") >= middle).coalesce(1).write.mode("append").parquet(parts)
    return payments(t.spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(parts))


@check("t04_grant_stream", f"""
WITH {GRANTS} SELECT listing_id, CAST(DATE '1970-01-01' + CAST(r.d + r.n AS INT) AS VARCHAR) AS featured_until FROM f""")
def grant_stream(t):
    log = fresh_path(t.spark, "grants")
    views.run_to_end(grants.grant_stream(paid_batches(t), log, fresh_path(t.spark, "state")))
    rows = grants.paid_until(t.spark.read.parquet(log))
    return rows.select("listing_id", F.col("featured_until").cast("string").alias("featured_until"))


# Every third customer's listing has an end already, some of them past.
STORED = "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN DATE '2023-12-20' + CAST(c_custkey % 90 AS INT) END AS stored FROM customer"
BEFORE = "{'d': date_diff('day', DATE '1970-01-01', any_value(coalesce(stored, DATE '1970-01-01'))), 'n': 0::BIGINT}"
STORED_GRANTS = f"k AS ({STORED}), " + GRANTS.replace("list({'d'", f"list_prepend({BEFORE}, list({{'d'").replace(
    ") AS l FROM s GROUP", ")) AS l FROM s JOIN k ON id = listing_id GROUP")


@check("t04_stored_ends", f"""
WITH {STORED_GRANTS}
SELECT id, listing_id IS NOT NULL AS featured, CAST(coalesce(DATE '1970-01-01' + CAST(r.d + r.n AS INT), stored) AS VARCHAR) AS featured_until FROM k LEFT JOIN f ON id = listing_id""")
def stored_ends(t):
    """Ends that listings had before stack with what is paid for in two batches; written twice, they stay."""
    k = F.col("c_custkey")
    listings = t.customer.select(k.alias("id"), F.lit(False).alias("featured"), F.when(
        k % 3 == 0, F.date_add(F.lit("2023-12-20").cast("date"), (k % 90).cast("int"))).alias("featured_until"))
    log = fresh_path(t.spark, "grants")
    views.run_to_end(grants.grant_stream(paid_batches(t), log, fresh_path(t.spark, "state"), stored=listings))
    ends = grants.paid_until(t.spark.read.parquet(log))
    rows = grants.apply_ends(grants.apply_ends(listings, ends), ends)
    return rows.select("id", "featured", F.col("featured_until").cast("string").alias("featured_until"))


@check("t04_apply_grants", f"""
WITH {STORED_GRANTS}
SELECT id, CAST(coalesce(DATE '1970-01-01' + CAST(r.d + r.n AS INT), stored) AS VARCHAR) AS featured_until FROM k LEFT JOIN f ON id = listing_id""")
def applied_grants(t):
    """The closed form over the whole table of payments, applied three times."""
    k = F.col("c_custkey")
    rows = t.customer.select(k.alias("id"), F.lit(False).alias("featured"), F.when(
        k % 3 == 0, F.date_add(F.lit("2023-12-20").cast("date"), (k % 90).cast("int"))).alias("featured_until"))
    granted = grants.grants(grants.first_sessions(payments(t.events)))
    for _ in range(3):
        rows = grants.apply_grants(rows, granted)
    return rows.select("id", F.col("featured_until").cast("string").alias("featured_until"))


HARVESTED = f"""SELECT DISTINCT CAST(o_custkey % 50 AS VARCHAR) AS source_id, CAST(o_orderkey AS VARCHAR) AS external_id, o_orderpriority AS title,
  true AS published, CASE WHEN o_custkey % 50 % 2 = 0 THEN 49.9663 ELSE 49.75 END::DOUBLE AS lat, 'canton' AS geocode_precision
FROM orders WHERE o_orderkey % 3 < 2 AND o_orderdate >= DATE '{TODAY}' - 1 AND year(o_orderdate) <= 2003"""


class Once:
    """A step that fails the first time it is asked."""

    def __init__(self, step):
        self.step, self.asked = step, 0

    def __call__(self, rows):
        self.asked += 1
        if self.asked == 1:
            raise OSError("not reachable")
        return self.step(rows)


def harvested(t, disturbed):
    """The table after a harvest of all payloads, each of which arrives twice, in three files."""
    raw, out, state = (fresh_path(t.spark, x) for x in ("payloads", "harvest", "state"))
    p = json_payloads(t)
    p.unionByName(p).repartition(3).write.parquet(raw)
    src = sources(t)
    none = t.communes_v.select(F.col("name").alias("commune"), "lat", "lng").filter("false")
    steps = {"read": lambda b: feeds.from_open_data_json(b, src, TODAY), "audit": harvest.auditor(now()),
             "locate": harvest.locator(place_rows(t), addresses(t), t.communes, none)}
    if disturbed:
        steps = {name: Once(step) for name, step in steps.items()}
    for attempt in range(2):
        stream = harvest.payload_stream(t.spark, raw, "source_id long, payload string", files=1)
        try:
            views.run_to_end(harvest.harvest(stream, out, state, sources=src, communes=t.communes, places=place_rows(t), addresses=addresses(t),
                                             centres=none, today=TODAY, now=now(), **steps))
            break
        except StreamingQueryException:
            if attempt or not disturbed:
                raise
    return out


def shown(rows):
    return rows.select("source_id", "external_id", F.col("title.en").alias("title"), "published", "lat", "geocode_precision")


@check("t05_harvest", HARVESTED)
def incremental(t):
    """The second arrival of a payload adds nothing."""
    return shown(harvest.current(t.spark, harvested(t, disturbed=False)))


@check("t05_failing_stages", HARVESTED)
def disturbed(t):
    """Import, locating and audit fail once each; the import is repeated, the other rows are taken up by the next batch."""
    out = harvested(t, disturbed=True)
    if {r.stage for r in harvest.failures(t.spark, out).select("stage").distinct().collect()} != {"imported", "located", "audited"}:
        raise RuntimeError("a stage has not failed")
    harvest.compact(t.spark, out)
    return shown(harvest.current(t.spark, out).filter(F.col("state") == harvest.DONE))


# What comes in the last file is late if it lies an hour or more before the newest row of the first.
LATE = """e AS (SELECT *, event_id % 50 = 0 AS second FROM events), w AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR AS w FROM e WHERE NOT second)"""


@check("t06_late_rows", f"""
WITH {LATE} SELECT count(DISTINCT (event_id % 500, user_id, date_trunc('minute', ts))) FILTER (NOT second OR ts > w) AS kept,
  count(*) FILTER (second AND ts <= w) AS late FROM e, w""")
def late(t):
    """Pings that come an hour and more after newer ones are dropped and counted."""
    parts = fresh_path(t.spark, "late")
    e = t.events.withColumn("late", (F.col("event_id") % 50 == 0).cast("int"))
    # a batch is judged by the watermark of the one before it, so some rows come again in between
    for wanted in ("late = 0", "event_id % 50 = 1", "late = 1"):
        e.filter(wanted).coalesce(1).drop("late").write.mode("append").parquet(parts)
    s = t.spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(parts)
    rows = views.dedupe_pings(s.select((F.col("event_id") % 500).alias("listing_id"), F.col("user_id").alias("client"), F.col("ts").cast("timestamp").alias("ts")), "s")
    out, log = fresh_path(t.spark, "pings"), views.ProgressLog(t.spark, fresh_path(t.spark, "progress"))
    views.run_to_end(rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", fresh_path(t.spark, "state")), log)
    kept = t.spark.read.schema(rows.schema).parquet(out)
    return kept.agg(F.count("*").alias("kept")).join(views.late_rows(log.table()).select("late"))


LIMITS = " UNION ALL ".join(
    f"SELECT '{w}' AS width, {n} AS allowed, strftime(date_trunc('{w.split()[1]}', ts), '%Y-%m-%d %H:%M:%S') AS start, client, count(*) AS n FROM r GROUP BY start, client HAVING count(*) > {n}"
    for w, n in [("1 minute", 5), ("1 minute", 10), ("1 hour", 10), ("1 hour", 60)])


@check("t07_over_limit", f"""
WITH r AS (SELECT user_id % 3 AS client, TIMESTAMP '2024-01-01 00:00:00' + CAST((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) // 60000000 AS BIGINT) * INTERVAL 1 SECOND AS ts FROM events)
{LIMITS}""")
def limits(t):
    # A month of events squeezed into half a day.
    squeezed = F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, (unix_micros(cast(ts as timestamp)) - unix_micros(timestamp'2024-01-01 00:00:00')) div 60000000)")
    rows = views.over_limit(t.events.select((F.col("user_id") % 3).alias("client"), squeezed.alias("ts")))
    return rows.select("width", "allowed", F.date_format("start", TS).alias("start"), "client", "n")
