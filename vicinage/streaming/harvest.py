"""Incremental import: new payload files become listings, are located and judged, batch by batch.

Every stored row has a state. A stage that fails leaves its rows where they are and in a queue, and the next batch, or
`sweep`, takes them up again; so a disturbed run ends with the table of an undisturbed one.

    imported -> located -> done      located: has its position, waits for the audit, is not published
    imported -> audited -> done      audited: was judged, keeps the position it arrived with, waits for a better one

Layout below `path`: rows/part=N what batch or sweep N wrote, queue/part=N what is unfinished after it, base/part=N all
rows up to N in one table, failures/part=N/stage=... A batch has an even part, the sweep after it the odd one. A replayed
part is written again from earlier parts only, so it comes out the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import hints
from ..operators.filters import fresh
from ..operators.ranking import first_per
from ..operators.towns import resolve_locations
from ..plans.builder import build_listings
from ..plans.quality import apply, changed, hide_unsafe

KEYS = ["source_id", "external_id"]
# Of repeated keys in a batch the earliest date counts, then the text: the same row wherever it lay.
FIRST = ["start_date", "end_date", "title", "description", "town"]
STATES = IMPORTED, LOCATED, AUDITED, DONE = "imported", "located", "audited", "done"
# Tasks a batch is read by; precisions that a later run may better, and how long such a row rests between tries.
TASKS_PER_CORE = 4
VAGUE, REST_DAYS = ["", "canton", "commune", "fallback", "source_default"], 7

Step = Callable[[DataFrame], DataFrame]


def payload_stream(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def parts(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the parts of a folder that were written to their end."""
    at, files = _folder(spark, folder)
    names = [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []
    numbers = sorted(int(n.removeprefix("part=")) for n in names if n.startswith("part="))
    done = lambda n: files.exists(_folder(spark, f"{folder}/part={n}/_SUCCESS")[0])
    return [n for n in numbers if done(n)]


def _read(spark: SparkSession, folder: str, numbers: list[int]) -> DataFrame:
    return spark.read.option("mergeSchema", True).option("basePath", folder).parquet(*[f"{folder}/part={n}" for n in numbers])


def _write(rows: DataFrame, target: str) -> DataFrame:
    rows.write.mode("overwrite").parquet(target)
    return rows.sparkSession.read.parquet(target)


def current(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The latest row of every key, of parts below `before`; None if there is none yet.

    Rows of the compacted base stay where they are unless a later part has their key.
    """
    below = lambda ns: [n for n in ns if before is None or n < before]
    bases = below(parts(spark, f"{path}/base"))
    newer = [n for n in below(parts(spark, f"{path}/rows")) if not bases or n > bases[-1]]
    if not newer:
        return _read(spark, f"{path}/base", bases[-1:]).drop("part") if bases else None
    rows = _read(spark, f"{path}/rows", newer)
    latest = first_per(rows, KEYS, [F.col("part").desc()]).drop("part")
    if not bases:
        return latest
    base = _read(spark, f"{path}/base", bases[-1:]).drop("part")
    return base.join(rows.select(*KEYS).distinct(), KEYS, "left_anti").unionByName(latest, allowMissingColumns=True)


def compact(spark: SparkSession, path: str) -> None:
    """Fold all parts so far into a new base; older parts are not read after that."""
    written = parts(spark, f"{path}/rows")
    if written:
        rows = current(spark, path)
        rows.repartition(*KEYS).sortWithinPartitions(*KEYS).write.mode("overwrite").parquet(f"{path}/base/part={written[-1]}")


def _failed(spark: SparkSession, path: str, number: int, stage: str, exc: Exception) -> None:
    spark.createDataFrame([(str(exc),)], "error string").write.mode("overwrite").parquet(f"{path}/failures/part={number}/stage={stage}")


def failures(spark: SparkSession, path: str) -> DataFrame:
    """(part, stage, error) of every stage that failed."""
    return spark.read.schema("error string, part long, stage string").parquet(f"{path}/failures")


def _work(path: str, number: int, stage: str) -> str:
    return f"{path}/work/part={number}/{stage}"


def _moved(rows: DataFrame, ahead: dict[str, str]) -> Column:
    """The state after a stage: `ahead` maps states to those that follow."""
    state = F.col("state")
    out = F.when(F.lit(False), state)
    for old, new in ahead.items():
        out = out.when(state == old, new)
    return out.otherwise(state)


def advance(rows: DataFrame, path: str, number: int, locate: Step, audit: Step, now: Column) -> DataFrame:
    """Rows one step further where the stage succeeds; where it fails they keep their state and count a try.

    Stages see only the rows that wait for them. Rows that wait for the audit are not published.
    """
    spark = rows.sparkSession

    def stage(rows: DataFrame, name: str, waiting: Column, step: Step, ahead: dict[str, str]) -> DataFrame:
        due, rest = rows.filter(waiting), rows.filter(~waiting)
        try:
            made = _write(step(due).withColumn("state", _moved(due, ahead)), _work(path, number, name))
        except Exception as exc:  # noqa: BLE001 - recorded; the rows wait for the next batch
            _failed(spark, path, number, name, exc)
            made = due.withColumn("attempts", F.col("attempts") + 1)
        return rest.unionByName(made, allowMissingColumns=True)

    state = F.col("state")
    placed = stage(rows, "located", state.isin(IMPORTED, AUDITED), lambda r: locate(r).withColumn("geocoded_at", now),
                   {IMPORTED: LOCATED, AUDITED: DONE})
    judged = stage(placed, "audited", state.isin(IMPORTED, LOCATED), lambda r: audit(r.withColumn("published", F.col("publish"))),
                   {IMPORTED: AUDITED, LOCATED: DONE})
    return judged.withColumn("published", F.col("published") & state.isin(AUDITED, DONE))


def _finish(spark: SparkSession, path: str, number: int, rows: DataFrame, queue: DataFrame | None = None) -> None:
    """A part's rows and its queue; the working tables go."""
    written = _write(rows, f"{path}/rows/part={number}")
    waiting = written.filter(F.col("state") != DONE)
    (waiting if queue is None else queue.unionByName(waiting, allowMissingColumns=True)).write.mode("overwrite").parquet(f"{path}/queue/part={number}")
    at, files = _folder(spark, f"{path}/work/part={number}")
    files.delete(at, True)


def harvest(payloads: DataFrame, path: str, checkpoint: str, *, read: Step, sources: DataFrame, communes: DataFrame,
            places: DataFrame, addresses: DataFrame, centres: DataFrame, today, now: Column, order: list | None = None,
            locate: Step | None = None, audit: Step | None = None) -> DataStreamWriter:
    """Writer of the listing table, which `current` reads.

    Three stages per batch: import (read, freshness, build, unknown rows only), locate, audit; `locate` and `audit` stand
    in for the last two. A stage that fails is recorded. If it is the import, the batch fails with it: it is not
    committed, and a restart reads its payloads again. The rows of the others wait in the queue, which every batch takes up with its own.
    """
    locate = locate or locator(places, addresses, communes, centres, order)
    audit = audit or auditor(now)

    def imported(batch: DataFrame, number: int) -> DataFrame:
        spark = batch.sparkSession
        # A file of payloads comes as one task, so its payloads are dealt out before they are read.
        dealt = batch.repartition(TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
        made, _ = build_listings(fresh(read(dealt), today), sources, communes, now)
        marked = made.withColumns({"publish": F.col("published"), "state": F.lit(IMPORTED), "attempts": F.lit(0), "geocoded_at": F.lit(None).cast("timestamp")})
        once = _write(first_per(marked, KEYS, FIRST), _work(path, number, "imported"))
        known = current(spark, path, number)
        if known is None:
            return once
        # The batch's few keys go to the many known ones, not the other way round.
        met = known.select(*KEYS).join(once.select(*KEYS), KEYS, "left_semi")
        return once.join(met, KEYS, "left_anti")

    def add(batch: DataFrame, batch_id: int) -> None:
        spark, number = batch.sparkSession, 2 * batch_id
        try:
            rows = _write(imported(batch, number), _work(path, number, "new"))
        except Exception as exc:
            _failed(spark, path, number, "imported", exc)
            raise RuntimeError(f"import of batch {batch_id} failed; see {path}/failures") from exc
        queues = [n for n in parts(spark, f"{path}/queue") if n < number]
        if queues:
            rows = rows.unionByName(_read(spark, f"{path}/queue", queues[-1:]).drop("part"), allowMissingColumns=True)
        _finish(spark, path, number, advance(rows, path, number, locate, audit, now))

    return payloads.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)


def locator(places: DataFrame, addresses: DataFrame, communes: DataFrame, centres: DataFrame, order: list | None = None) -> Step:
    return lambda rows: resolve_locations(rows, places, addresses, communes, centres, order)


def auditor(now: Column) -> Step:
    text = hints.all_languages(F.col("title"), F.col("description"))
    return lambda rows: apply(hide_unsafe(rows, text, now))


def sweep(spark: SparkSession, path: str, locate: Step, now: Column, audit: Step | None = None) -> int:
    """The pass over the whole store after a run; returns how many rows it wrote.

    Waiting rows go on. Finished rows with a vague position get another try a week after the last one. Everything stored
    is judged again, as rules may have changed since; what is found is hidden, never deleted. Only rows that change are written; done twice, the second pass writes
    nothing new.
    """
    written = parts(spark, f"{path}/rows")
    if not written:
        return 0
    number = written[-1] if written[-1] % 2 else written[-1] + 1
    rows = current(spark, path, number)
    vague = F.col("lat").isNull() | (F.col("lat") == 0) | F.coalesce("geocode_precision", F.lit("")).isin(VAGUE)
    rested = F.coalesce(F.col("geocoded_at") < F.date_sub(now, REST_DAYS), F.lit(True))
    again = (F.col("state") == DONE) & vague & rested
    open_ = _write(rows.withColumn("state", F.when(again, AUDITED).otherwise(F.col("state"))).filter(F.col("state") != DONE), _work(path, number, "open"))
    moved = advance(open_, path, number, locate, audit or auditor(now), now)
    text = hints.all_languages(F.col("title"), F.col("description"))
    found = apply(changed(hide_unsafe(rows.filter((F.col("state") == DONE) & ~again), text, now)))
    _finish(spark, path, number, moved.unionByName(found, allowMissingColumns=True))
    return spark.read.parquet(f"{path}/rows/part={number}").count()
