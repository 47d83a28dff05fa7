"""Mixing sources to target weights: random keys, a range sort, distributed prefix sums, an exact cut per source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinage.session import cut

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5                   # of all words, what the mix takes
MOST_EPOCHS = 2.0             # of a source's words, what its target may reach
SEED = 17


def words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows of the same keys that come before.

    Rows are range-partitioned by (keys, order), so one hot key spreads over many tasks. Each task sums its own rows;
    what came before a task is a running sum over one row per task and key. keys and order hold no nulls.
    """
    placed = cut(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    sums = placed.groupBy("_part", *keys).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_part", *keys, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return local.join(offsets, ["_part", *keys]).withColumn(out, F.col("_offset") + F.col("_inside")).drop(
        "_part", "_offset", "_inside")


def targets(sizes: DataFrame, *, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
            most: float = MOST_EPOCHS) -> DataFrame:
    """Adds `target` to (_none, _src, source_size): weights repeat over the sources in code point order, null last.

    A target above `most` times its source is cut there and the excess goes to the others by weight, until none is
    above. Only the two sums of each round reach the driver.
    """
    if share > most:
        raise ValueError(f"a share of {share} can't be met with {most} epochs at most")
    ranked = running_total(sizes.withColumn("_one", F.lit(1)).withColumn("_all", F.lit(0)), ["_all"], ["_none", "_src"],
                           "_one", "_rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("_rank", F.lit(len(weights))) + 1).cast("int"))
    ranked = cut(ranked.select("_none", "_src", "source_size", weight.alias("_weight")))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    full, held = most * F.col("source_size"), -1
    level = None
    while True:
        capped = F.lit(False) if level is None else F.lit(level) * F.col("_weight") >= full
        row = ranked.agg(F.sum(F.when(capped, full)).alias("taken"), F.sum(F.when(~capped, F.col("_weight"))).alias("open"),
                         F.count(F.when(capped, 1)).alias("n")).first()
        if row["n"] == held or not row["open"]:
            break
        held, level = row["n"], (share * total - (row["taken"] or 0.0)) / row["open"]
    level = level if level is not None else 0.0
    return ranked.select("_none", "_src", "source_size", F.least(F.lit(level) * F.col("_weight"), full).alias("target"))


def mix(docs: DataFrame, *, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS,
        seed: int = SEED, text: str = "text", source: str = "source", id_col: str = "doc_id") -> DataFrame:
    """(id, source, size, source_size, target, epochs, taken) for every row of `docs`: how many words the mix takes of it.

    Every document gets a hash-random key. Whole epochs of a source are taken while its budget lasts; the rest of the
    budget cuts the random order exactly where it is used up, so a source's words add up to its target, rounded down. The
    document at the cut is taken in part, from its start. Null text: size 0, nothing taken. Null source: a source of its
    own, last. Null ids and repeated rows are rows like any other; equal rows are interchangeable. Empty table: empty
    result. Other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"), F.col(source).isNull().alias("_none"),
                       F.coalesce(F.col(source), F.lit("")).alias("_src"), words(F.col(text)).alias("size"))
    rows = rows.withColumn("_key", F.xxhash64(F.lit(seed), "id", "size")).withColumn("_tie", F.coalesce(F.col("id").cast("long"), F.lit(-(1 << 63))))
    placed = running_total(rows, ["_none", "_src"], ["_key", "_tie", "size"], "size", "_before")
    sizes = placed.groupBy("_none", "_src").agg(F.sum("size").alias("source_size"))
    with_target = placed.join(targets(cut(sizes), weights=weights, share=share, most=most), ["_none", "_src"])
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - F.col("epochs") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_before")))
    return with_target.withColumn("epochs", epochs).select(
        "id", "source", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size") + part).alias("taken"))
