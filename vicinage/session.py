"""Session defaults and the shared-folder helpers every iterative job uses."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Shuffle files of a finished action go at once, not when the driver next collects its garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str | int = 8, memory: str = "12g", **conf: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("vicinage")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it.

    Only a single-machine session without the setting gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="vicinage-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return os.path.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex}")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: bounds the lineage of an iterative job and survives lost executors."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def kept(df: DataFrame, *by: str) -> DataFrame:
    """The rows, written once below the shared folder in compressed columns, for what is read several times or by parts.

    `by`: columns of few values, each value's rows in files of their own. What was shuffled for the rows is gone afterwards.
    """
    spark = df.sparkSession
    path = fresh_path(spark, "kept")
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.select("*").write.option("compression", "zstd").partitionBy(*by).parquet(path)
    finally:
        spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def with_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Rows with costly columns, computed once per row whatever is asked of them afterwards.

    A filter on a projected column is pushed below the projection with the column's whole expression in place of its
    name, as often as it names it; it can't pass a generator. The generator itself only names finished columns: with a
    lambda in one of them it would work out all of them uncompiled.
    """
    kept = [c for c in df.columns if c not in columns]
    made = df.select(*kept, *[v.alias(f"_once_{k}") for k, v in columns.items()])
    return made.select(*kept, F.inline(F.array(F.struct(*[F.col(f"_once_{k}").alias(k) for k in columns]))))
