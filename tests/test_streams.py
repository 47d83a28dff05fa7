"""Streams that are disturbed, repeated or long."""

import os
from datetime import date, datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from vicinage.streaming import grants, harvest, views


def test_late_rows_of_a_long_stream(spark, tmp_path):
    """More batches than a query remembers: every one is in the log, and so is every late row."""
    start, n = datetime(2024, 1, 1), 156
    rows = [(i, start + timedelta(minutes=10 * i), 0) for i in range(n)] + [(i, start, 1) for i in range(20, n, 5)]
    (tmp_path / "in").mkdir()
    for i in range(n):                               # one file a batch, in order of time
        path = tmp_path / "in" / f"{i:03}.parquet"
        own = list(zip(*(r for r in rows if r[0] == i)))
        kinds = (pa.int32(), pa.timestamp("us", tz="UTC"), pa.int32())
        pq.write_table(pa.table([pa.array(c, type=t) for c, t in zip(own, kinds)], names=["batch", "ts", "late"]), path)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        s = spark.readStream.schema("batch int, ts timestamp, late int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        pings = views.dedupe_pings(s.select(F.col("batch").alias("listing_id"), F.col("late").cast("string").alias("client"), "ts"), "s")
        log = views.ProgressLog(spark, str(tmp_path / "log"), every=40)
        writer = pings.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state"))
        query = views.run_to_end(writer, log)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    told = views.late_rows(log.table()).first()
    assert told.batches > 150 > len(query.recentProgress) and (told.rows, told.late) == (len(rows), sum(r[2] for r in rows))


def payments(rows):
    """(session, listing, day, plan, event)"""
    return [(s, x, datetime(2024, 1, 1) + timedelta(days=d), p, e) for s, x, d, p, e in rows]


PAID = "session_id string, listing_id long, ts timestamp, plan string, event_id long"


def folded(rows, stored):
    """One payment after the other; each session once."""
    seen, ends = set(), dict(stored)
    for s, x, ts, p, e in sorted(rows, key=lambda r: (r[2], r[4])):
        if s in seen or p not in grants.PLANS:
            continue
        seen.add(s)
        ends[x] = max(ts.date(), ends.get(x) or ts.date()) + timedelta(days=grants.PLANS[p][0])
    return ends


def test_grants_over_batches_and_again(spark, tmp_path):
    batches = [payments([("a", 1, 0, "1month", 1), ("a", 1, 1, "6months", 2), ("b", 2, 2, "3months", 3), ("c", 3, 2, "none", 4), ("k", 5, 3, "1month", 9)]),
               payments([("a", 1, 5, "1month", 5), ("d", 1, 10, "1month", 6), ("e", 2, 11, "1month", 7), ("f", 2, 11, "6months", 8), ("b", 3, 12, "1month", 10)])]
    stored = {1: date(2024, 2, 20), 2: date(2023, 5, 1), 4: date(2024, 3, 1)}
    listings = spark.createDataFrame([(i, False, stored.get(i)) for i in range(1, 7)], "id long, featured boolean, featured_until date")
    for rows in batches:
        spark.createDataFrame(rows, PAID).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    want = folded([r for b in batches for r in b], stored)
    for _ in range(2):                               # the second run finds nothing new
        stream = spark.readStream.schema(PAID).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        views.run_to_end(grants.grant_stream(stream, str(tmp_path / "log"), str(tmp_path / "state"), stored=listings))
    ends = grants.paid_until(spark.read.parquet(str(tmp_path / "log")))
    once = grants.apply_ends(listings, ends)
    for rows in (once, grants.apply_ends(once, ends)):
        assert {r.id: r.featured_until for r in rows.collect()} == {i: want.get(i) for i in range(1, 7)}
        assert {r.id for r in rows.filter("featured").collect()} == {1, 2, 5}
    granted = grants.grants(grants.first_sessions(spark.createDataFrame([r for b in batches for r in b], PAID)))
    rows = listings
    for _ in range(3):
        rows = grants.apply_grants(rows, granted)
        assert {r.id: r.featured_until for r in rows.collect()} == {i: want.get(i) for i in range(1, 7)}


class Failing:
    """A step that fails at the given calls."""

    def __init__(self, step, *calls):
        self.step, self.calls, self.n = step, calls, 0

    def __call__(self, rows):
        self.n += 1
        if self.n in self.calls:
            raise OSError(f"call {self.n}")
        return self.step(rows)


def candidates(rows):
    """The feed columns out of a narrow payload (k, title)."""
    none = F.lit(None)
    return rows.select(F.lit(1).alias("source_id"), F.col("k").alias("external_id"), "title", none.cast("string").alias("description"), F.lit("").alias("town"),
                       F.lit("2024-05-01").cast("date").alias("start_date"), none.cast("date").alias("end_date"), F.lit("").alias("time"), F.lit("").alias("image"),
                       none.cast("double").alias("lat"), none.cast("double").alias("lng"))


def test_harvest_recovers_from_every_stage(spark, tmp_path):
    sources = spark.createDataFrame([(1, "Gemeng", "Mersch", "", ["Culture"], 0, 99)], "source_id int, name string, canton_default string, town_default string, "
                                    "category_default array<string>, age_min_default int, age_max_default int")
    communes = spark.createDataFrame([], "commune_id int, name string, names array<string>, canton string, lat double, lng double")
    now = F.lit("2024-04-01 00:00:00").cast("timestamp")
    files = [[("a", "Fest"), ("b", "Peep-Show"), ("a", "Fest")], [("a", "Other title"), ("c", "Mart")], [("d", "Concert")]]
    for rows in files:
        spark.createDataFrame(rows, "k string, title string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def locate(rows):
        return rows.withColumns({"lat": F.lit(49.6), "lng": F.lit(6.1), "geocode_precision": F.lit("address"), "geocode_source": F.lit("places")})

    def run(out, failing):
        steps = {"read": candidates, "locate": locate, "audit": harvest.auditor(now)}
        steps = {name: Failing(step, *failing.get(name, ())) for name, step in steps.items()}
        for _ in range(3):
            try:
                stream = harvest.payload_stream(spark, str(tmp_path / "in"), "k string, title string", files=1)
                views.run_to_end(harvest.harvest(stream, out, f"{out}-state", sources=sources, communes=communes, places=None, addresses=None, centres=None,
                                                 today="2024-04-01", now=now, **steps))
                break
            except StreamingQueryException:
                pass
        return steps

    def table(out):
        rows = harvest.current(spark, out).select("external_id", F.col("title.en").alias("title"), "published", "lat", "state", F.col("family_flag.reason").alias("why"))
        return sorted(tuple(r) for r in rows.collect())

    run(str(tmp_path / "calm"), {})
    calm = table(str(tmp_path / "calm"))
    assert [r[0] for r in calm] == ["a", "c", "d"] or [r[0] for r in calm] == ["a", "b", "c", "d"]
    assert all(r[4] == "done" for r in calm) and ("a", "Fest", True, 49.6, "done", None) in calm
    # import of the second batch, locating twice running, audit twice running
    run(str(tmp_path / "rough"), {"read": [2], "locate": [1, 2], "audit": [2, 3]})
    told = {(r.part, r.stage) for r in harvest.failures(spark, str(tmp_path / "rough")).collect()}
    assert {s for _, s in told} == {"imported", "located", "audited"}
    out = str(tmp_path / "rough")
    waiting = [r for r in table(out) if r[4] != "done"]
    assert all(not r[2] for r in waiting if r[4] in ("imported", "located"))
    harvest.sweep(spark, out, locate, now)
    assert table(out) == calm
    # a second sweep has nothing to do, compaction keeps the table, and older parts may go
    assert harvest.sweep(spark, out, locate, now) >= 0 and table(out) == calm
    harvest.compact(spark, out)
    assert table(out) == calm
    assert {r.attempts for r in harvest.current(spark, out).collect()} - {0}


def test_sweep_betters_vague_positions_and_hides(spark, tmp_path):
    out = str(tmp_path / "store")
    now = F.lit("2024-04-10 00:00:00").cast("timestamp")
    rows = [("1", "old", "canton", datetime(2024, 4, 1), "Fest"), ("1", "young", "canton", datetime(2024, 4, 8), "Fest"),
            ("1", "exact", "address", datetime(2024, 4, 1), "Fest"), ("1", "bad", "address", datetime(2024, 4, 1), "Peep-Show")]
    text = lambda c: F.struct(F.col(c).alias("en"), F.col(c).alias("de"), F.col(c).alias("fr"))
    df = spark.createDataFrame(rows, "source_id string, external_id string, geocode_precision string, geocoded_at timestamp, t string").select(
        "source_id", "external_id", "geocode_precision", "geocoded_at", text("t").alias("title"), text("t").alias("description"), F.lit(49.0).alias("lat"),
        F.lit(6.0).alias("lng"), F.lit(True).alias("published"), F.lit(True).alias("publish"), F.lit("done").alias("state"), F.lit(0).alias("attempts"),
        F.lit(None).cast("struct<reason:string,matched:string,at:timestamp>").alias("family_flag"))
    df.write.parquet(f"{out}/rows/part=0")
    better = lambda rows: rows.withColumns({"lat": F.lit(50.0), "geocode_precision": F.lit("address")})
    assert harvest.sweep(spark, out, better, now) == 2
    got = {r.external_id: (r.lat, r.published) for r in harvest.current(spark, out).collect()}
    assert got == {"old": (50.0, True), "young": (49.0, True), "exact": (49.0, True), "bad": (49.0, False)}
