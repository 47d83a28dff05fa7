"""View pings: dedup, counters, per-minute statistics, request limits, late rows.

The duplicate bucket of a ping is (listing, client, minute) and lives for an hour, so an hour is
also how late a ping may be.
"""

from __future__ import annotations

from threading import Event

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery, StreamingQueryListener

from ..config.profiles import REQUEST_LIMITS
from ..functions.text import hash_client
from ..operators.ranking import first_per

LATENESS = "1 hour"


def bucketed(pings: DataFrame, salt: str) -> DataFrame:
    """Pings (listing_id, client, ts) with the pseudonym of the client and the minute."""
    return pings.select("listing_id", hash_client(F.col("client"), salt).alias("client"), "ts",
                        F.date_trunc("minute", "ts").alias("minute"))


def dedupe_pings(pings: DataFrame, salt: str) -> DataFrame:
    """One ping per listing, client and minute; works on a stream (bounded state) and on a table."""
    keys = ["listing_id", "client", "minute"]
    rows = bucketed(pings, salt)
    if rows.isStreaming:
        return rows.withWatermark("ts", LATENESS).dropDuplicatesWithinWatermark(keys)
    return rows.groupBy(*keys).agg(F.min("ts").alias("ts"))


def known_pings(pings: DataFrame, listings: DataFrame, key: str = "id") -> DataFrame:
    """Pings of listings that exist."""
    known = listings.select(F.col(key).alias("listing_id")).distinct()
    return pings.join(known, "listing_id", "left_semi")


def count_views(pings: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Writer that keeps view counts as additions per micro-batch; a replayed batch overwrites its own part."""
    def add(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy("listing_id").agg(F.count("*").alias("views"))
        counts.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return pings.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)


def current_counts(additions: DataFrame) -> DataFrame:
    return additions.groupBy("listing_id").agg(F.sum("views").alias("views"))


def view_statistics(pings: DataFrame, width: str = "1 minute") -> DataFrame:
    """Pings per listing and tumbling window; a stream emits a window once it can no longer change."""
    rows = pings.withWatermark("ts", LATENESS) if pings.isStreaming else pings
    return (rows.groupBy(F.window("ts", width), "listing_id").agg(F.count("*").alias("n"))
            .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "listing_id", "n"))


def roll_up(statistics: DataFrame, unit: str) -> DataFrame:
    """Hours or days out of the minutes."""
    return statistics.groupBy(F.date_trunc(unit, "start").alias("start"), "listing_id").agg(F.sum("n").alias("n"))


def over_limit(requests: DataFrame, limits: list[tuple[str, int]] = REQUEST_LIMITS) -> DataFrame:
    """(width, allowed, start, client, n) of clients above a limit in a fixed window.

    Rows are counted once per distinct window width; limits of the same width share the count.
    """
    widths = sorted({w for w, _ in limits})
    parts = []
    for width in widths:
        counts = requests.groupBy(F.window("ts", width), "client").agg(F.count("*").alias("n"))
        allowed = F.explode(F.array(*[F.lit(n) for w, n in limits if w == width]))
        parts.append(counts.select(F.lit(width).alias("width"), allowed.alias("allowed"), F.col("window.start").alias("start"),
                                   "client", "n").filter(F.col("n") > F.col("allowed")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


class ProgressLog(StreamingQueryListener):
    """A table of what every batch reports, for queries of any length: a query itself remembers its last hundred only.

    Rows (query_id, run_id, batch_id, at, rows, late) are held until there are `every` of them or a query ends, and then
    written below `path`, so a listener holds a bounded number whatever the stream. A batch that is replayed reports again;
    `late_rows` counts its last report.
    """

    SCHEMA = "query_id string, run_id string, batch_id long, at string, rows long, late long"

    def __init__(self, spark: SparkSession, path: str, every: int = 1000):
        self.spark, self.path, self.every = spark, path, every
        self.held: list[tuple] = []
        self.ended: dict[str, Event] = {}

    def onQueryStarted(self, event) -> None:
        self.ended.setdefault(str(event.runId), Event())

    def onQueryProgress(self, event) -> None:
        p = event.progress
        late = sum(int(op.numRowsDroppedByWatermark) for op in p.stateOperators)
        self.held.append((str(p.id), str(p.runId), int(p.batchId), str(p.timestamp), int(p.numInputRows), late))
        if len(self.held) >= self.every:
            self.flush()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.flush()
        self.ended.setdefault(str(event.runId), Event()).set()

    def flush(self) -> None:
        rows, self.held = self.held, []
        if rows:
            self.spark.createDataFrame(rows, self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)


def late_rows(progress: DataFrame) -> DataFrame:
    """(query_id, batches, rows, late): what each query has read, and dropped for being later than the watermark."""
    last = first_per(progress, ["query_id", "batch_id"], [F.col("at").desc(), F.col("late").desc()])
    return last.groupBy("query_id").agg(F.count("*").alias("batches"), F.sum("rows").alias("rows"), F.sum("late").alias("late"))


def run_to_end(writer: DataStreamWriter, log: ProgressLog | None = None) -> StreamingQuery:
    """Process everything there is, in as many micro-batches as the source gives, then stop; with `log`, what it reports is written."""
    if log is not None:
        log.spark.streams.addListener(log)
    try:
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        if log is not None and not log.ended.setdefault(str(query.runId), Event()).wait(60):
            raise RuntimeError("the end of the query was not reported")
    finally:
        if log is not None:
            log.spark.streams.removeListener(log)
    return query
