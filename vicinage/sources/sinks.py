"""Snapshot sinks: insert, upsert, patch, delete, compare, copy.

Each gives the new snapshot as a DataFrame; `write_snapshot` puts it down under a new path, so a
lost executor or a failed run never leaves a half-written table behind.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ranking import first_per
from ..schema import CLEARABLE_FIELDS


def new_rows(batch: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Batch rows whose key is not known yet."""
    return batch.join(known.select(*keys).distinct(), keys, "left_anti")


def insert_new(target: DataFrame, batch: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Target plus the batch rows it lacks; repeats inside the batch collapse to the first."""
    fresh = new_rows(first_per(batch, keys, order), target, keys)
    return target.unionByName(fresh.select(*[c for c in target.columns if c in fresh.columns]), allowMissingColumns=True)


def _differs(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def upsert(target: DataFrame, batch: DataFrame, key: str, order: list, insert_only: tuple[str, ...] = ("created_at",),
           ignore: tuple[str, ...] = ("updated_at",)) -> DataFrame:
    """The new snapshot with `_written`: null for untouched rows, true for new or changed, false for identical.

    All batch fields are set; `insert_only` fields keep their stored value; a row that differs only
    in `ignore` fields counts as identical. Of repeated keys in the batch the first row in `order` counts.
    """
    once = first_per(batch, [key], order)
    old = target.select(F.col(key), F.struct(*target.columns).alias("_old"))
    new = once.select(F.col(key), F.struct(*once.columns).alias("_new"))
    both = old.join(new, key, "full_outer")
    isold, isnew = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    names = list(dict.fromkeys([*target.columns, *once.columns]))
    compared = [c for c in once.columns if c in target.columns and c not in insert_only and c not in ignore and c != key]
    changed = reduce(lambda a, b: a | b, [_differs(F.col(f"_old.{c}"), F.col(f"_new.{c}")) for c in compared], F.lit(False))
    written = F.when(~isnew, F.lit(None).cast("boolean")).when(~isold, F.lit(True)).otherwise(changed)
    both = both.withColumn("_written", written)
    values = []
    for c in names:
        stored = F.col(f"_old.{c}") if c in target.columns else F.lit(None)
        sent = F.col(f"_new.{c}") if c in once.columns else None
        if c == key:
            values.append(F.col(key))
        elif sent is None:
            values.append(stored.alias(c))
        elif c in insert_only:
            values.append(F.when(isold, stored).otherwise(sent).alias(c))
        elif c in ignore:
            values.append(F.when(F.col("_written"), sent).otherwise(stored).alias(c))
        else:
            values.append(F.when(isnew, sent).otherwise(stored).alias(c))
    return both.select(*values, "_written")


def apply_patches(target: DataFrame, patches: DataFrame, now: Column, order: str, key: str = "id",
                  clearable: set[str] = CLEARABLE_FIELDS) -> DataFrame:
    """Only the fields a patch names in `sent` change; null is taken only for clearable fields.

    Patches of one id are folded first, by partial aggregates: of each field the last value that counts, in `order`, a
    column of `patches` that tells them apart.
    """
    fields = [c for c in patches.columns if c not in (key, "sent", order)]
    def last(c: str) -> Column:
        counts = F.array_contains("sent", c)
        counts = counts if c in clearable else counts & F.col(c).isNotNull()
        return F.max_by(F.struct(c), F.when(counts, F.col(order)))[c].alias(c)

    named = [F.max(F.array_contains("sent", c)).alias(f"_sent_{c}") for c in fields]
    folded = patches.groupBy(key).agg(*named, *map(last, fields))
    p = folded.select(F.col(key), F.struct(*[f"_sent_{c}" for c in fields], *fields).alias("_p"))
    joined = target.join(p, key, "left")
    values = []
    for c in target.columns:
        if c in fields and c != "updated_at":
            sent = F.col(f"_p._sent_{c}")
            take = sent if c in clearable else sent & F.col(f"_p.{c}").isNotNull()
            values.append(F.when(F.coalesce(take, F.lit(False)), F.col(f"_p.{c}")).otherwise(F.col(c)).alias(c))
        elif c == "updated_at":
            values.append(F.when(F.col("_p").isNotNull(), now).otherwise(F.col(c)).alias(c))
        else:
            values.append(F.col(c))
    return joined.select(*values)


def append_submissions(target: DataFrame, batch: DataFrame, natural_key: list[str], now: Column, creator: Column) -> DataFrame:
    """Submissions as pending rows; the id follows from the natural key, so a replay adds nothing."""
    id_ = F.sha2(F.concat_ws("\u0001", *[F.col(c).cast("string") for c in natural_key]), 256)
    rows = batch.withColumns({"id": id_, "status": F.lit("pending"), "created_at": now, "updated_at": now,
                              "created_by": creator})
    return insert_new(target, rows, ["id"], natural_key) if target is not None else first_per(rows, ["id"], natural_key)


def delete_ids(target: DataFrame, ids: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(what remains, ids that matched nothing)."""
    wanted = ids.select(key).distinct()
    return target.join(wanted, key, "left_anti"), wanted.join(target.select(key), key, "left_anti")


def reconcile(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many rows each side has and how many keys only one of them has."""
    a = source.groupBy(*keys).agg(F.count("*").alias("_s"))
    b = target.groupBy(*keys).agg(F.count("*").alias("_t"))
    both = a.join(b, keys, "full_outer")
    return both.agg(
        F.sum(F.coalesce("_s", F.lit(0))).alias("in_source"), F.sum(F.coalesce("_t", F.lit(0))).alias("in_target"),
        F.count_if(F.col("_t").isNull()).alias("only_source"), F.count_if(F.col("_s").isNull()).alias("only_target")) \
        .withColumn("same", (F.col("only_source") == 0) & (F.col("only_target") == 0)
                    & (F.col("in_source") == F.col("in_target")))


def copy_table(source: DataFrame, target_path: str, replace: bool = False) -> None:
    """Copy into an empty place; a filled one is only touched with `replace`."""
    source.write.mode("overwrite" if replace else "errorifexists").parquet(target_path)


def write_snapshot(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


def write_listings(df: DataFrame, path: str, files_per_month: int = 8) -> None:
    """Listings by month of their start, sorted by canton: months prune folders, cantons skip row groups.

    Rows are spread by month and id, so a month that holds a third of all rows still has many writers.
    """
    month = F.date_format(F.coalesce("start_date", F.lit("1970-01-01").cast("date")), "yyyy-MM")
    spread = F.pmod(F.xxhash64("id"), F.lit(files_per_month))
    (df.withColumns({"month": month, "_part": spread}).repartition("month", "_part").drop("_part")
     .sortWithinPartitions("month", "canton", "start_date")
     .write.mode("errorifexists").partitionBy("month").parquet(path))


def register_sources(target: DataFrame, found: DataFrame, now: Column, activate: bool = False) -> DataFrame:
    """Registry upsert by name: everything is refreshed but the switch, the id and the creation time."""
    id_ = F.sha2(F.col("name"), 256)
    batch = found.withColumns({"id": id_, "active": F.lit(activate), "created_at": now})
    return upsert(target, batch, "name", order=[F.to_json(F.struct(*batch.columns))], insert_only=("id", "active", "created_at"))
