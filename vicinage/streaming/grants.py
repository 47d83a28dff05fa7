"""Paid sponsorships: each session counts once, grants of a listing stack."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..config.profiles import PLANS
from ..operators.ranking import first_per

ARRIVAL = ["ts", "event_id"]
LATENESS_DAYS = 30


def first_sessions(payments: DataFrame) -> DataFrame:
    """The first payment event of every session, of a known plan."""
    return first_per(payments.filter(F.col("plan").isin(list(PLANS))), ["session_id"], ARRIVAL)


def plan_days(plan: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for name, (days, _) in PLANS.items() for x in (name, days)]), plan)


def grants(sessions: DataFrame) -> DataFrame:
    """(listing_id, featured_until, days) after folding until = max(day, until) + days over a listing's payments.

    Payments of one day commute, so they are summed per day first; over days the fold has a closed
    form: total days so far plus the largest (day minus days before it). What a window sees per
    listing is at most one row per calendar day, however many payments there are.
    """
    days = sessions.groupBy("listing_id", F.to_date("ts").alias("day")).agg(F.sum(plan_days(F.col("plan"))).alias("days"))
    w = Window.partitionBy("listing_id").orderBy("day")
    before = F.coalesce(F.sum("days").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lead = days.withColumn("_start", F.unix_date("day") - before)
    return lead.groupBy("listing_id").agg(
        F.date_from_unix_date((F.sum("days") + F.max("_start")).cast("int")).alias("featured_until"),
        F.sum("days").cast("int").alias("days"))


def featured_until(sessions: DataFrame) -> DataFrame:
    """(listing_id, featured_until): the end days of `grants`."""
    return grants(sessions).drop("days")


def apply_grants(listings: DataFrame, granted: DataFrame) -> DataFrame:
    """Listings with the flag and the end day after all `grants`, which stack on the end stored before any of them.

    That end is kept in `stored_until`, so applying the same grants again, or more of them later, starts from it.
    """
    u = granted.withColumnsRenamed({"listing_id": "id", "featured_until": "_until", "days": "_days"})
    none = F.lit(None).cast("date")
    stored = next((F.col(c) for c in ("stored_until", "featured_until") if c in listings.columns), none)
    rows = listings.withColumn("stored_until", stored).join(u, "id", "left")
    stacked = F.greatest(F.date_add("stored_until", F.col("_days")), F.col("_until"))
    return rows.withColumns({"featured": F.col("featured") | F.col("_until").isNotNull(),
                             "featured_until": F.coalesce(stacked, "stored_until")}).drop("_until", "_days")


def apply_ends(listings: DataFrame, ends: DataFrame) -> DataFrame:
    """Listings with the flag and the end day that `grant_stream` has reached; an end is a day, so again changes nothing."""
    u = ends.select(F.col("listing_id").alias("id"), F.col("featured_until").alias("_until"))
    return listings.join(u, "id", "left").withColumns({
        "featured": F.col("featured") | F.col("_until").isNotNull(),
        "featured_until": F.greatest("_until", "featured_until")}).drop("_until")


def featured_on(listings: DataFrame, today: Column) -> DataFrame:
    """Featured listings whose paid time has not run out."""
    return listings.filter(F.col("featured") & (F.col("featured_until").isNull() | (F.col("featured_until") >= today)))


def _day(ms: int) -> int:
    return ms // 86_400_000


class _FirstPayment(StatefulProcessor):
    """Per session: its first payment, once. A session is remembered for `days` after that."""

    def __init__(self, days: int):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.seen = handle, handle.getValueState("seen", "day int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:                            # one row of the session at a time is held
            best = part.sort_values(ARRIVAL).head(1)
            first = best if first is None or tuple(best[ARRIVAL].iloc[0]) < tuple(first[ARRIVAL].iloc[0]) else first
        if first is None or self.seen.exists():
            return
        day = int(first["day"].iloc[0])
        self.seen.update((day,))
        self.handle.registerTimer((day + self.days) * 86_400_000)
        yield first

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


class _PaidTime(StatefulProcessor):
    """Per listing: the day its paid time ends. It begins with the stored end and goes once it lies in the past."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.end = handle, handle.getValueState("end", "until int")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._hold(int(initialState["until"].max()))

    def _hold(self, until: int) -> None:
        self.end.update((until,))
        self.handle.registerTimer((until + 1) * 86_400_000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        per_day: dict[int, int] = {}                 # payments of one day commute
        for part in rows:
            for day, days in part.groupby("day")["days"].sum().items():
                per_day[int(day)] = per_day.get(int(day), 0) + int(days)
        if not per_day:
            return
        until = self.end.get()[0] if self.end.exists() else None
        for day in sorted(per_day):
            until = max(day, day if until is None else until) + per_day[day]
        self._hold(until)
        yield pd.DataFrame({"listing_id": [key[0]], "until": [until], "days": [sum(per_day.values())]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.end.exists() and self.end.get()[0] < _day(expiredTimerInfo.getExpiryTimeInMs()):
            self.end.clear()                         # an end in the past extends nothing
        return iter(())

    def close(self) -> None:
        pass


def grant_stream(payments: DataFrame, path: str, checkpoint: str, stored: DataFrame | None = None, lateness_days: int = LATENESS_DAYS) -> DataStreamWriter:
    """Writer of the log of ends: for each batch, the end day of every listing that was paid for in it.

    The state is keyed, on disk, and bounded: sessions are forgotten `lateness_days` after their first payment, which is also
    how late a payment may come, and ends once they are past. `stored` (id, featured_until): ends before the stream's first batch.
    `paid_until` over the log is the result. A replayed batch rewrites its part.
    """
    spark = payments.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = payments.schema["listing_id"].dataType.simpleString()
    known = payments.filter(F.col("plan").isin(list(PLANS))).select(
        F.col("session_id").cast("string").alias("session_id"), "listing_id", F.col("ts").cast("timestamp").alias("ts"),
        "event_id", F.unix_date(F.to_date("ts")).alias("day"), plan_days(F.col("plan")).alias("days"))
    first = known.withWatermark("ts", f"{lateness_days} days").groupBy("session_id").transformWithStateInPandas(
        _FirstPayment(lateness_days), known.schema, "append", "EventTime", eventTimeColumnName="ts")
    before = None
    if stored is not None:
        before = stored.filter(F.col("featured_until").isNotNull()).select(
            F.col("id").cast(kind).alias("listing_id"), F.unix_date("featured_until").alias("until")).groupBy("listing_id")
    ends = first.groupBy("listing_id").transformWithStateInPandas(
        _PaidTime(), f"listing_id {kind}, until int, days int", "append", "EventTime", initialState=before)

    def add(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("listing_id", F.date_from_unix_date("until").alias("featured_until"), "days")
        rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return ends.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)


def paid_until(log: DataFrame) -> DataFrame:
    """(listing_id, featured_until): the last end of every listing in the log; ends only grow."""
    return log.groupBy("listing_id").agg(F.max("featured_until").alias("featured_until"))
